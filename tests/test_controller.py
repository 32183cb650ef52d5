"""The controller's stream against batch operators and plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopyflow import config as C
from canopyflow.operators import joins
from canopyflow.operators import sequence as seq
from canopyflow.operators import slicing as sl
from canopyflow.sources import tables
from canopyflow.streaming import controller, telemetry
from canopyflow.streaming.controller import Rule
from canopyflow.streaming.state import count_rule, count_uses

T0 = datetime(2024, 5, 1)
SLICES = sl.Slicing(("id_board",))
PACKETS = "id_board string, _time timestamp, seq long, leaf_temp double, soil_moisture double, star_id string"
READINGS = "id_board string, _time timestamp, seq long, temp double, reading_id string"


def made(seed, n=300):
    rnd = random.Random(seed)
    packets = [(f"b{rnd.randrange(3)}", T0 + timedelta(minutes=i // 2), i, rnd.choice([None, 3.0, 18.5]), rnd.choice([None, 20.0, 60.0, 69.0, 75.0]), f"h{i // 100}") for i in range(n)]
    readings = [(f"b{rnd.randrange(3)}", T0 + timedelta(minutes=rnd.randrange(n // 2)), 10_000 + i, rnd.choice([20.25, 21.5]), rnd.choice("AB")) for i in range(30)]
    return packets, readings


def as_stream(spark, rows, schema, path, n, jitter):
    """Rows in time order, each moved up to ``jitter`` rows away, as ``n`` files; one file is one micro-batch."""
    rnd = random.Random(7)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], i))
    order = [order[i] for i in sorted(range(len(order)), key=lambda i: i + rnd.uniform(0, jitter))]
    for part in np.array_split(np.asarray(order), n):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


FLUSH = [("end", T0 + timedelta(days=30), 0, None, None, None)]


def drained(spark, stream, path):
    stream.writeStream.format("parquet").option("checkpointLocation", path + "-c").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@pytest.mark.parametrize("files, jitter", [(1, 0), (5, 40)])
def test_readings_and_rules_do_not_depend_on_arrival(spark, tmp_path, files, jitter):
    packets, readings = made(3)
    a = as_stream(spark, packets + FLUSH, PACKETS, str(tmp_path / "p"), files, jitter)
    b = as_stream(spark, readings, READINGS, str(tmp_path / "r"), files, jitter / 10)
    got = drained(spark, controller.controlled(a, b, lateness="60 minutes"), str(tmp_path / "out"))
    tel, told = spark.createDataFrame(packets, PACKETS), spark.createDataFrame(readings, READINGS)
    want = seq.apply_fallback(joins.fallback_lookup(tel, told, SLICES), SLICES)
    columns = ["id_board", "seq", "leaf_temp", "use_no", "leaf_source", "alert_level"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    fired = {(r.id_board, r.seq) for r in got.where("size(fired) > 0").collect()}
    assert fired == {(r.id_board, r.seq) for r in seq.moisture_alerts(tel, SLICES).collect()} and fired


def test_a_failing_rule_is_left_out_alone(spark, tmp_path):
    packets, _ = made(5, 60)
    rules = [Rule("broken", ("soil_moisture",), lambda p: p["no such column"] > 1, 1, ("fan", 1, 1)),
             Rule("cold", ("leaf_temp",), lambda p: p["leaf_temp"] < 30, 2, ("lamp", 9, 5)), controller.LOW_MOISTURE]
    src = as_stream(spark, packets + FLUSH, PACKETS, str(tmp_path / "p"), 3, 0)
    rows = controller.controlled(src, rules=rules, lateness="0 seconds")
    q = controller.run_controller(rows, *[str(tmp_path / n) for n in ("points", "commands", "c", "topology")], rules=rules)
    q.awaitTermination()
    commands = controller.command_table(spark, str(tmp_path / "commands")).read()
    assert {r.rule for r in commands.collect()} == {"cold", "low_soil_moisture"}
    assert {(r.act, r.val, r.dur) for r in commands.where("rule = 'cold'").collect()} == {("lamp", 9, 5)}
    want = seq.moisture_alerts(spark.createDataFrame(packets, PACKETS), SLICES)
    assert {r.seq for r in commands.where("rule = 'low_soil_moisture'").collect()} == {r.seq for r in want.collect()}
    points = tables.read_table(spark, str(tmp_path / "points"))
    newest = {(b, t): (s, v) for b, t, s, _, v, _ in packets if v is not None}  # later packets of one time win
    assert {(r.id_board, r._time): (r.seq, r._value) for r in points.where("_field = 'soil_moisture'").collect()} == newest
    hubs = {r.node_id: r.star_id for r in telemetry.live_topology(spark, str(tmp_path / "topology")).collect()}
    assert hubs == {f"b{i}": "h0" for i in range(3)}


def test_counting_over_batches():
    rnd = random.Random(1)
    for patience in (1, 2, 5):
        holds = np.asarray([rnd.random() < 0.8 for _ in range(200)])
        n, want = 0, []
        for h in holds:
            n = n + 1 if h else 0
            want.append(n == patience)
            n %= patience
        got, count = [], 0
        for part in np.split(holds, sorted(rnd.sample(range(200), 20))):
            fires, count = count_rule(part, patience, count)
            got += fires.tolist()
        assert got == want
    names = np.asarray([rnd.choice("AB") for _ in range(100)], object)
    want, last, n = [], None, 0
    for x in names:
        last, n = x, n + 1 if x == last else 1
        want.append(n)
    got, state = [], (None, 0)
    for part in np.split(names, [0, 7, 7, 30, 99]):
        uses, state = count_uses(part, state)
        got += uses.tolist()
    assert got == want


def test_rule_frames_hold_only_packets_with_the_measure():
    seen = []
    rule = Rule("r", ("a",), lambda p: seen.append(p["a"].tolist()) or p["a"] > 0, 1, ("x", 1, 1))

    class Counts(dict):
        def containsKey(self, k): return k in self  # noqa: E704
        def getValue(self, k): return self[k]  # noqa: E704
        def updateValue(self, k, v): self[k] = v  # noqa: E704

    c = controller._Controller([], [], [rule], C.READING_USES)
    c.counts = Counts()
    out = c._ruled(pd.DataFrame({"a": [1.0, np.nan, -1.0, 2.0]}))
    assert seen == [[1.0, -1.0, 2.0]] and out["fired"].tolist() == [["r"], [], [], ["r"]]


class _Map(dict):
    def containsKey(self, k): return k in self
    def getValue(self, k): return self[k]
    def updateValue(self, k, v): self[k] = v
    def removeKey(self, k): self.pop(k, None)
    def iterator(self): return iter(self.items())


class _List(list):
    def get(self): return iter(self)
    def appendList(self, rows): self.extend(rows)
    def put(self, rows): self[:] = rows


class _Value:
    v = None
    def get(self): return self.v
    def exists(self): return self.v is not None
    def update(self, v): self.v = v


class _Handle:
    def __init__(self): self.timers = set()
    def getMapState(self, *a): return _Map()
    def getListState(self, *a): return _List()
    def getValueState(self, *a): return _Value()
    def listTimers(self): return iter(sorted(self.timers))
    def registerTimer(self, t): self.timers.add(t)
    def deleteTimer(self, t): self.timers.discard(t)


class _Now:
    def __init__(self, ms): self.ms = ms
    def getCurrentWatermarkInMs(self): return self.ms


def test_a_board_with_many_packets_is_worked_through_in_chunks(monkeypatch):
    """Neither the packets that wait nor those that are ready are in a task's memory all at once."""
    monkeypatch.setattr(controller, "CHUNK", 500, raising=False)
    columns = ["at_us", "seq", "leaf_temp", "soil_moisture"]
    op, handle = controller._Controller(columns, ["long", "long", "double", "double"], (controller.LOW_MOISTURE,), 14), _Handle()
    op.init(handle)
    rnd = np.random.default_rng(2)
    pdf = pd.DataFrame({"at_us": rnd.permutation(10_000) * 36_000_000, "seq": np.arange(10_000), "leaf_temp": 20.0, "soil_moisture": rnd.choice([np.nan, 60.0, 75.0], 10_000, p=[0.1, 0.7, 0.2]),
                        "is_reading": False, "temp": np.nan, "reading_id": None})  # a hundred an hour
    op.handleInputRows(("b",), iter([pdf[i:i + 1000] for i in range(0, 10_000, 1000)]), None)
    got = []
    for hours in (33, 33.5, 200):
        handle.timers = set()
        frames = list(op.handleExpiredTimer(("b",), _Now(int(hours * 3_600_000)), None))
        assert all(len(f) < 700 for f in frames)
        got += frames
        assert not handle.timers if hours == 200 else handle.timers == {int(hours * 3_600_000) + 36_000}
    out = pd.concat(got)
    assert out["at_us"].tolist() == [i * 36_000_000 for i in range(10_000)]
    told = pdf.sort_values("at_us")
    told = told[told["soil_moisture"].notna()]
    fires, _ = count_rule(told["soil_moisture"].to_numpy() < C.SOIL_LOW, C.SOIL_PATIENCE, 0)
    assert out[out["fired"].map(bool)]["seq"].tolist() == told[fires]["seq"].tolist()
