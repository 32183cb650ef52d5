"""Constants, field names and the task catalogue."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: names and numbers that decide results ---------------------
MEASUREMENT = "sensor_measurements"

ENV_FEATURES = ["air_temp", "humidity", "pressure", "water_temp", "tds", "soil_moisture", "light_lux"]
TARGET = "leaf_temp"
FIELDS = [*ENV_FEATURES, TARGET]
PRED_FIELDS = ["leaf_temp_pred", "air_temp_pred", "humidity_pred"]
# alternative spelling -> stored name
FIELD_ALIASES = {"tds_value": "tds", "leaf_temperature": "leaf_temp"}

# short key of the uplink JSON -> column
UPLINK_KEYS = {
    "sid": "star_id",
    "ts": "timestamp",
    "id": "node_id",
    "p": "pressure",
    "wt": "water_temp",
    "lux": "light_lux",
    "tds": "tds",
    "sm": "soil_moisture",
    "at": "air_temp",
    "h": "humidity",
    "lt": "leaf_temp",
}
# little-endian packet: two unsigned 32-bit integers, then eight 32-bit floats
PACKET_FIELDS = [
    "timestamp", "node_id", "water_temp", "tds_value", "soil_moisture",
    "light_lux", "air_temp", "humidity", "pressure", "leaf_temp",
]
PACKET_BYTES = 40

FREQ_MIN = 6
CLEAN_LOOKBACK_DAYS = 30
FORECAST_LOOKBACK_DAYS = 7
OVERLAP_MIN = 60
STALE_LOOKBACK_DAYS = 180
LOCAL_ZONE = "Europe/Rome"

FILL_CAP_MIN = 42
FILL_BEFORE = 5
FILL_AFTER = 2
FILL_SIGMA_MIN = 15.0
FILL_WEIGHT_FLOOR = 0.01
LEAF_BLOCK_GAP_MIN = 12
WATER_MIN = 10.0
TDS_MIN = 30.0
SPIKE_ROWS_BEFORE = 5
SPIKE_ROWS_AFTER = 4
SPIKE_RATIO = 1.3

LAG_SPAN_MIN = 180
HORIZON_MIN = 180
DEFAULT_LAGS = 6
GAP_FACTOR = 1.5
TRAIN_SHARE = 0.90
SEASON_DAYS = 14
SEASON_SPLIT = 0.8
SEASON_MIN_ROWS = 100
SEASON_MIN_TOTAL = 20

SOIL_LOW = 70.0
SOIL_PATIENCE = 5
PUMP = ("pump", 255, 60)
LEAF_MIN_VALID = 5.0
READING_USES = 14
ALERT_EVERY = 6
EXHAUSTED_ALERT = 5
COMMAND_VALUE_MAX = 255
COMMAND_DURATION_MAX = 300
COMMAND_ATTEMPTS = 3
COMMAND_RETRY_S = 3
RING_RECORDS = 16 * 1024 // PACKET_BYTES + 1
LEAF_PHYSICAL_MIN = -20.0
TOP_SHARE = 0.75
TOP_MAX = 10
BLEND_EPSILON = 1e-6
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Task:
    """One model task: what is predicted, from what, and how far back."""

    name: str
    features: tuple[str, ...]
    use_lags: bool
    lag_target: bool
    fixed_lags: int | None = None
    target: str = TARGET

    def lags(self, freq_min: float = FREQ_MIN) -> int:
        return self.fixed_lags or int(LAG_SPAN_MIN / freq_min)

    def steps(self, freq_min: float = FREQ_MIN) -> int:
        return int(HORIZON_MIN / freq_min) if self.use_lags else 1


_ALL = tuple(ENV_FEATURES)
_NO_TDS = tuple(f for f in ENV_FEATURES if f != "tds")

# fixed values: the tasks and the (soft, environmental, autoregressive) groups
TASKS = {
    t.name: t
    for t in (
        Task("t1", _ALL, False, False),
        Task("t2", _ALL, True, False),
        Task("t3", _ALL, True, True),
        Task("t4", _NO_TDS, False, False),
        Task("t5", _NO_TDS, True, False),
        Task("t6", _NO_TDS, True, True),
        Task("t8", _NO_TDS, True, False, 15),
        Task("t9", _NO_TDS, True, True, 15),
    )
}
GROUPS = {"A": ("t1", "t2", "t3"), "B": ("t4", "t5", "t6"), "C": ("t4", "t8", "t9")}


def soft_task(task_or_group: str) -> str:
    """The soft-sensor task that patches history for a task or a group."""
    return "t1" if task_or_group.upper() in ("T1", "T2", "T3", "A") else "t4"
