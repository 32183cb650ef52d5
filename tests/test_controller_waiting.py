"""What waits in the controller's stream: readings and packets travel and wait put together, and count as if they came one by one."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from canopyflow import config as C
from canopyflow.operators import joins
from canopyflow.operators import sequence as seq
from canopyflow.operators import slicing as sl
from canopyflow.streaming import controller
from checks import sequences, streams
from tests.test_controller import _Handle, _Map, _Now

COLUMNS, KINDS = ["at_us", "seq", "leaf_temp"], ["long", "long", "double"]
MINUTE = 60_000_000


class _Counted(_Map):
    calls = 0

    def updateValue(self, k, v):
        _Counted.calls += 1
        super().updateValue(k, v)

    def removeKey(self, k):
        _Counted.calls += 1
        super().removeKey(k)


class _CountedHandle(_Handle):
    def getMapState(self, *a): return _Counted()


def rows(seed, n, every, span):
    """``n`` rows of one board out of order, one in ``every`` a reading; many share a time."""
    rnd = np.random.default_rng(seed)
    told = rnd.random(n) < 1 / every
    return pd.DataFrame({"at_us": rnd.integers(0, span, n) * MINUTE, "is_reading": told, "seq": rnd.integers(0, n // 3, n), "leaf_temp": np.where(told, np.nan, rnd.choice([np.nan, 3.0, 18.0], n)),
                         "temp": np.where(told, np.arange(n) / 4, np.nan), "reading_id": pd.Series([f"R{i // 400}" if t else None for i, t in enumerate(told)], dtype=object)})


def plain(pdf):
    """Row by row: of readings of one time the greatest seq counts, of equal ones what came last; uses as ``count_uses`` has them."""
    told = {}
    for r in pdf[pdf["is_reading"]].itertuples():
        if r.at_us not in told or r.seq >= told[r.at_us][0]:
            told[r.at_us] = (r.seq, r.temp, r.reading_id)
    times, out, state = sorted(told), [], (None, 0)
    packets = pdf[~pdf["is_reading"]].sort_values(["at_us", "seq"], kind="stable")
    for r in packets.itertuples():
        i = np.searchsorted(times, r.at_us, side="right") - 1
        temp, reading = told[times[i]][1:] if i >= 0 else (np.nan, None)
        leaf, use = r.leaf_temp, None
        if not leaf >= C.LEAF_MIN_VALID:
            if reading is not None:
                state = (reading, state[1] + 1 if reading == state[0] else 1)
                use = state[1]
            leaf = temp if use is not None and use <= 14 else leaf if use is not None else np.nan
        out.append((r.at_us, r.seq, None if np.isnan(leaf) else float(leaf), use))
    return out


def frames(pdf, travels, size):
    for i in range(0, len(pdf), size):
        part = pdf[i:i + size]
        if not travels:
            yield part
            continue
        schema = pa.schema([("id_board", pa.string()), ("_time", pa.timestamp("us", "UTC")), ("is_reading", pa.bool_()), ("at_us", pa.int64()), ("seq", pa.int64()),
                            ("leaf_temp", pa.float64()), ("temp", pa.float64()), ("reading_id", pa.string())])
        batch = pa.RecordBatch.from_pandas(part.assign(id_board="b", _time=pd.to_datetime(part["at_us"], unit="us", utc=True)), schema, preserve_index=False)
        for b in controller.packed(iter([batch]), controller.wire_schema(COLUMNS, KINDS)):
            yield b.to_pandas()


@pytest.mark.parametrize("travels, chunk, span", [(False, 700, 6_000), (True, 700, 6_000), (True, 50_000, 6_000), (True, 700, 300), (True, 2_000, 60_000)])
def test_rows_that_wait_count_as_if_they_came_one_by_one(monkeypatch, travels, chunk, span):
    monkeypatch.setattr(controller, "CHUNK", chunk)
    pdf = rows(span, 9_000, 4, span)
    op, handle = controller._Controller(COLUMNS, KINDS, (), C.READING_USES), _Handle()
    op.init(handle)
    op.handleInputRows(("b",), frames(pdf, travels, 1_500), None)
    got = []
    for passed in (span * 0.31, span * 0.32, span * 0.8, span + 1):
        handle.timers = set()
        got += list(op.handleExpiredTimer(("b",), _Now(int(passed * 60_000) + 7), None))
    assert not handle.timers and not op.pending.state and not op.told.state
    out = pd.concat(got)
    leaf = [None if np.isnan(x) else x for x in out["leaf_temp"]]
    use = [None if x is pd.NA else int(x) for x in out["use_no"]]
    assert list(zip(out["at_us"], out["seq"], leaf, use)) == plain(pdf)


def test_readings_that_come_between_two_watermarks(monkeypatch):
    monkeypatch.setattr(controller, "CHUNK", 300)
    pdf = rows(5, 6_000, 3, 4_000)
    pdf = pdf.iloc[np.argsort(pdf["at_us"] + np.random.default_rng(1).integers(0, 900, 6_000) * MINUTE, kind="stable")].reset_index(drop=True)
    op, handle, got = controller._Controller(COLUMNS, KINDS, (), C.READING_USES), _Handle(), []
    op.init(handle)
    for i in range(0, 6_000, 500):
        part = pdf[i:i + 500]
        op.handleInputRows(("b",), frames(part, True, 250), None)
        rest = pdf[i + 500:]["at_us"]
        passed = (int(rest.min()) if len(rest) else 1 << 40) // 1000 - 1
        if handle.timers and min(handle.timers) <= passed:
            handle.timers = set()
            got += list(op.handleExpiredTimer(("b",), _Now(passed), None))
    out = pd.concat(got)
    assert list(zip(out["at_us"], out["seq"], [None if np.isnan(x) else x for x in out["leaf_temp"]], [None if x is pd.NA else int(x) for x in out["use_no"]])) == plain(pdf)


def test_state_is_not_called_for_every_reading():
    """A call of the state takes a fraction of a millisecond, and a board has millions of readings."""
    pdf = rows(9, 20_000, 2, 2_000)
    op, handle = controller._Controller(COLUMNS, KINDS, (), C.READING_USES), _CountedHandle()
    op.init(handle)
    _Counted.calls = 0
    op.handleInputRows(("b",), frames(pdf, False, 5_000), None)
    out = pd.concat(list(op.handleExpiredTimer(("b",), _Now(3_000 * 60_000), None)))
    assert len(out) == (~pdf["is_reading"]).sum() and _Counted.calls < 500


def test_many_rows_of_an_hour_travel_as_one_and_late_ones_are_left_out():
    schema = pa.schema([("id_board", pa.string()), ("_time", pa.timestamp("us", "UTC")), ("at_us", pa.int64()), ("is_reading", pa.bool_()), ("seq", pa.int64()),
                        ("leaf_temp", pa.float64()), ("temp", pa.float64()), ("reading_id", pa.string())])
    at = [*range(0, 50 * MINUTE, MINUTE), 90 * MINUTE, None]
    batch = pa.RecordBatch.from_pydict({"id_board": ["b"] * 52, "_time": pa.array(at, pa.int64()).cast(schema.field("_time").type), "at_us": at, "is_reading": [False] * 52, "seq": list(range(52)),
                                        "leaf_temp": [20.0] * 52, "temp": [None] * 52, "reading_id": [None] * 52}, schema)
    own = controller.wire_schema(COLUMNS, KINDS)
    out = next(controller.packed(iter([batch]), own))
    whole = [x is not None for x in out.column(controller.PACKED).to_pylist()]
    assert whole == [False, False, True] and out.column("_time").cast(pa.int64()).to_pylist() == [None, 90 * MINUTE, 49 * MINUTE]
    rows = controller._rows(out.column(controller.PACKED)[2].as_py(), own)
    assert rows.column("at_us").to_pylist() == at[:50]
    op = controller._Controller(COLUMNS, KINDS, (), C.READING_USES)
    assert op._late(rows, 39 * MINUTE).num_rows == 10 and op._late(rows, None).num_rows == 50


def test_arrivals_over_many_months_lose_no_rows(spark, tmp_path):
    """Lots of a long table are wider than the twenty days a row could be late before."""
    rnd = random.Random(4)
    made = [(i, datetime(2024, 1, 1) + timedelta(hours=18 * i), i % 7, rnd.choice(["signup", "error", "view"]), rnd.choice([2.0, 20.5, 31.0]), f'{{"k": {i % 5}}}') for i in range(400)]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = streams.stream_readings(spark, str(tmp_path))
    tel, told = sequences.leaf_packets(spark, str(tmp_path))
    slices = sl.Slicing(("id_board",))
    want = seq.apply_fallback(joins.fallback_lookup(tel, told, slices), slices).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 400
