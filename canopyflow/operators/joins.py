"""Joins and as-of lookups.

As-of and interval joins are a union and a scan in time order inside slices: each side is shuffled once and no
pair is formed that is not in the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import slicing as sl
from canopyflow.operators.slicing import Slicing


def route_commands(cmds: DataFrame, topology: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commands with the hub of their node, and commands for nodes no hub has reported."""
    routed = cmds.join(topology, "node_id", "left")
    return routed.where(F.col("star_id").isNotNull()), routed.where(F.col("star_id").isNull()).drop("star_id")


def available_boards(points: DataFrame, topology: DataFrame | None) -> DataFrame:
    """Boards with data that are in the topology; all of them when the topology cannot be had."""
    boards = points.select("id_board").where(F.col("id_board").isNotNull()).distinct()
    if topology is not None:
        boards = boards.join(topology.select(F.col("node_id").alias("id_board")).distinct(), "id_board", "left_semi")
    return boards.orderBy("id_board")


def asof(left: DataFrame, right: DataFrame, slicing: Slicing, carry: Sequence[str], right_first: bool = True,
         tie: str = "seq") -> DataFrame:
    """Attach to each left row the newest right row of its key at or before it.

    ``left`` and ``right`` share the key, the time and the tie column.
    """
    key_time = [*slicing.key, slicing.time, tie]
    a = left.withColumn("_side", F.lit(1)).withColumn("_hit", F.lit(None).cast(right.select(F.struct(*carry)).schema[0].dataType))
    b = right.select(*key_time, F.lit(0 if right_first else 2).alias("_side"), F.struct(*carry).alias("_hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = sl.known(both, slicing, [slicing.time, "_side", tie], last={"_hit": F.col("_hit")})
    return seen.where(F.col("_side") == 1).select(*left.columns, *[F.col("_hit")[c].alias(c) for c in carry])


def fallback_lookup(tel: DataFrame, readings: DataFrame, slicing: Slicing) -> DataFrame:
    """The operator's reading in force when a packet came: temp and reading_id, null before the first one."""
    return asof(tel, readings, slicing, ["temp", "reading_id"])


def command_outcomes(cmds: DataFrame, acks: DataFrame, slicing: Slicing, timeout_us: int, tie: str = "seq") -> DataFrame:
    """How each command ended: acked, replaced by a newer one, or failed after ``timeout_us``; and when."""
    t = slicing.time
    key_time = [*slicing.key, t, tie]
    both = cmds.withColumn("_cmd", F.col(t)).withColumn("_ack", F.lit(None).cast("timestamp")).unionByName(
        acks.select(*key_time, F.lit(None).cast("timestamp").alias("_cmd"), F.col(t).alias("_ack")), allowMissingColumns=True)
    d = sl.known(both, slicing, [t, tie], after={"_next_cmd": F.col("_cmd"), "_next_ack": F.col("_ack")})
    d = d.where(F.col("_cmd").isNotNull())
    limit = F.timestamp_micros(F.unix_micros(t) + F.lit(timeout_us))
    end = F.least(limit, F.col("_next_cmd"))
    acked = F.col("_next_ack") < end
    status = F.when(acked, "acked").when(F.col("_next_cmd") < limit, "replaced").otherwise("failed")
    return d.select(*cmds.columns, F.when(acked, F.col("_next_ack")).otherwise(end).alias("end_time"), status.alias("status"))


def retry_events(outcomes: DataFrame, slicing: Slicing, retry_us: int, attempts: int = C.COMMAND_ATTEMPTS) -> DataFrame:
    """The sends of each command: at once, then every ``retry_us`` while it is open."""
    at = F.unix_micros(slicing.time)
    tries = F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt")
    sends = outcomes.select("*", tries).withColumn("send_time", F.timestamp_micros(at + (F.col("attempt").cast("long") - 1) * F.lit(retry_us)))
    return sends.where((F.col("attempt") == 1) | (F.col("send_time") < F.col("end_time")))


def dispatch(cmds: DataFrame, packets: DataFrame, slicing: Slicing, tie: str = "seq") -> DataFrame:
    """The first later packet of the node carries the pending command; a newer command takes its place.

    Adds ``sent_time`` and ``packet_seq``, null when the command was overwritten or no packet came.
    """
    t = slicing.time
    hit = F.struct(F.col(t).alias("t"), F.col(tie).alias("seq"))
    none = F.lit(None).cast(f"struct<t:timestamp,seq:{dict(packets.dtypes)[tie]}>")
    both = cmds.withColumn("_cmd", hit).withColumn("_pkt", none).unionByName(
        packets.select(*slicing.key, t, tie, none.alias("_cmd"), hit.alias("_pkt")), allowMissingColumns=True)
    both = both.withColumn("_side", F.when(F.col("_pkt").isNotNull(), 0).otherwise(1))
    d = sl.known(both, slicing, [t, "_side", tie], after={"_next_cmd": F.col("_cmd"), "_next_pkt": F.col("_pkt")})
    d = d.where(F.col("_cmd").isNotNull())
    # a packet leaves first when it and a newer command carry the same stamp
    lost = F.coalesce(F.col("_next_cmd.t") < F.col("_next_pkt.t"), F.lit(False))
    return d.select(*cmds.columns, F.when(~lost, F.col("_next_pkt.t")).alias("sent_time"), F.when(~lost, F.col("_next_pkt.seq")).alias("packet_seq"))


def routable(cmds: DataFrame, tel: DataFrame, hub: str = "star_id", time: str = "_time") -> DataFrame:
    """Commands for hubs that had been heard from when the command came."""
    first = tel.where(F.col(hub).isNotNull()).groupBy(hub).agg(F.min(time).alias("first_seen"))
    return cmds.join(first, hub).where(F.col("first_seen") <= F.col(time))


def align(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("id_board", "step")) -> DataFrame:
    """Two forecasts step by step; ends with the shorter one."""
    return a.join(b, list(keys))


def task_table(df: DataFrame) -> DataFrame:
    """The task catalogue as a frame of a dozen rows."""
    rows = [(t.name, t.target, list(t.features), t.use_lags, t.lag_target, t.lags()) for t in C.TASKS.values()]
    return df.sparkSession.createDataFrame(
        rows, "task string, target string, features array<string>, use_lags boolean, lag_target boolean, lags int")


def with_config(df: DataFrame) -> DataFrame:
    """Task settings next to each row; the catalogue is a fixed table of eight rows, so it is broadcast."""
    return df.join(F.broadcast(task_table(df)), "task", "left")


def missing_models(tasks: DataFrame, registry: DataFrame, freqs: Sequence[int]) -> DataFrame:
    """Expected (freq, task) pairs without a stored model."""
    expected = tasks.select("task").distinct().withColumn("freq", F.explode(F.array(*[F.lit(f) for f in freqs])))
    return expected.join(registry.select("freq", "task").distinct(), ["freq", "task"], "left_anti")


def write_back(df: DataFrame, prediction: Column, valid: Column, col: str = C.TARGET) -> DataFrame:
    """Predictions replace the column on the scored rows only."""
    return df.withColumn(col, F.when(valid, prediction).otherwise(F.col(col)))


def upsert_points(existing: DataFrame, incoming: DataFrame, key: Sequence[str] = ("measurement", "id_board", "model_source", "freq", "_field", "_time"),
                  seq: str = "seq") -> DataFrame:
    """Points of both, one per key: the incoming side wins over the existing one, then the greatest ``seq``.

    Null values are not written. An aggregate with map-side combine, so copies of a point collapse before the shuffle.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    have = both.where(F.col("_value").isNotNull())
    keys = [k for k in key if k in have.columns]
    rest = [c for c in have.columns if c not in keys and c != "_new"]
    best = F.max_by(F.struct(*rest), F.struct("_new", seq))
    return have.groupBy(*keys).agg(best.alias("_b")).select(
        *[F.col(c) if c in keys else F.col("_b")[c].alias(c) for c in have.columns if c != "_new"])


def merge_dumps(a: DataFrame, b: DataFrame, **kw) -> DataFrame:
    """Union of two dumps without duplicate points; ``b`` is imported into ``a``."""
    return upsert_points(a, b, **kw)


def reintegrate(archive: DataFrame, clean: DataFrame, freq: str, anchor: Column, fields: Sequence[str] = C.PRED_FIELDS) -> DataFrame:
    """Archived forecasts of one frequency that are newer than the last one in ``clean`` minus an hour: what has to be upserted there.

    The last one is looked for in the month before ``anchor``; without it the last week is copied. With a literal anchor both scans are
    bounded. The watermark is one row, computed in the plan.
    """
    month = F.expr(f"INTERVAL {C.CLEAN_LOOKBACK_DAYS} DAYS")
    stored = clean.where((F.col("_time") >= anchor - month) & F.col("_field").rlike("pred")).agg(F.max("_time").alias("_mark"))
    hour, week = F.expr(f"INTERVAL {C.OVERLAP_MIN} MINUTES"), F.expr(f"INTERVAL {C.FORECAST_LOOKBACK_DAYS} DAYS")
    since = stored.select(F.coalesce(F.col("_mark") - hour, anchor - week).alias("_since"))
    wanted = archive.where((F.col("_time") >= anchor - month - hour) & (F.col("freq") == freq) & F.col("_field").isin(list(fields)))
    fresh = wanted.crossJoin(F.broadcast(since)).where(F.col("_time") >= F.col("_since")).drop("_since")  # one row
    return fresh
