"""The parallel fill against a plain loop over the rule."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.operators import gaussfill, slicing
from canopyflow.operators.gaussfill import gaussian_fill

T0 = datetime(2024, 3, 1)


def loop(rows, cap=42.0, sigma=15.0):
    """rows: [(minute, value or None, weight)] in order; returns the filled values."""
    vals = [v for _, v, _ in rows]
    for i, (t, v, _) in enumerate(rows):
        if v is not None:
            continue
        before = [j for j in range(i) if vals[j] is not None][-5:]
        after = [j for j in range(i + 1, len(rows)) if vals[j] is not None][:2]
        if before and after:
            gap = rows[after[0]][0] - rows[before[-1]][0]
        elif before:
            gap = t - rows[before[-1]][0]
        elif after:
            gap = rows[after[0]][0] - t
        else:
            continue
        if gap > cap:
            continue
        w = [math.exp(-((rows[j][0] - t) ** 2) / (2 * sigma**2)) * rows[j][2] for j in before + after]
        if sum(w) > 0.01:
            vals[i] = sum(a * vals[j] for a, j in zip(w, before + after)) / sum(w)
    return vals


def series(seed):
    rng = random.Random(seed)
    t, rows = 0.0, []
    missing = rng.choice([0.1, 0.5, 0.9])
    for _ in range(rng.choice([1, 6, 150])):
        t += rng.choice([1, 2, 2, 2, 5, 12, 41, 42, 43, 90])
        rows.append((t, None if rng.random() < missing else round(rng.uniform(0, 50), 2), rng.choice([1, 2])))
    return rows


@pytest.mark.parametrize("width", [slicing.RUNGS[0], 3600, 600])
def test_equals_loop(spark, width):
    want, data = {}, []
    for s in range(40):
        rows = series(s)
        for (t, v, w), f in zip(rows, loop(rows)):
            data.append((f"b{s}", T0 + timedelta(minutes=t), v, float(w), 7.0))
            want[(f"b{s}", T0 + timedelta(minutes=t))] = f
    df = spark.createDataFrame(data, "id_board string, _time timestamp, x double, w double, y double")
    out = gaussian_fill(df, slicing.Slicing(("id_board",), width_s=width), {"x": F.col("w")}).collect()
    assert len(out) == len(data)
    for r in out:
        f = want[(r.id_board, r._time)]
        assert (r.x is None) == (f is None), r
        assert f is None or r.x == pytest.approx(f, rel=1e-12)
        assert r.y == 7.0


@pytest.mark.parametrize("width", [slicing.RUNGS[0], 3600])
def test_a_slice_is_worked_through_in_chunks(spark, monkeypatch, width):
    """Whatever a slice holds, only a chunk of it and what lies between two known values is in a task's memory."""
    rows = [row for s in range(40) for row in series(s)]
    rows = [(3 * i, v, w) for i, (_, v, w) in enumerate(rows)]
    df = spark.createDataFrame([("b0", T0 + timedelta(minutes=t), v, float(w)) for t, v, w in rows], "id_board string, _time timestamp, x double, w double")

    def filled():
        return gaussfill.gaussian_fill(df, slicing.Slicing(("id_board",), width_s=width), {"x": F.col("w")}).orderBy("_time").collect()

    whole = loop(rows)
    for chunk in (7, 100):
        monkeypatch.setattr(gaussfill, "CHUNK", chunk)
        for r, f in zip(filled(), whole, strict=True):
            assert r.x is None if f is None else r.x == pytest.approx(f, rel=1e-12)

    held = []
    s = gaussfill._Slice(15.0, False)
    for i in range(3000):  # a known value in every fourth row
        v = 1.0 if i % 4 == 0 else np.nan
        part = [np.asarray([x]) for x in (i * 6e7, v, 1.0, i % 4 == 0, 0, i * 60_000_000)]
        held.append(s.n)
        list(s.add(part))
    assert max(held) <= 100  # rows held at once


def test_two_columns_and_a_condition(spark):
    rows = [(0, 1.0), (2, None), (4, 3.0)]
    df = spark.createDataFrame([(b, T0 + timedelta(minutes=t), v, v) for b in ("b0", "b1") for t, v in rows],
                               "id_board string, _time timestamp, x double, y double")
    out = gaussian_fill(df, slicing.Slicing(("id_board",)), {"x": None, "y": None}, when={"y": F.col("id_board") == "b0"})
    got = {(r.id_board, r._time.minute): (r.x, r.y) for r in out.collect()}
    assert got[("b0", 2)] == (2.0, 2.0) and got[("b1", 2)] == (2.0, None)


def test_cap_beyond_the_weights_is_refused(spark):
    df = spark.createDataFrame([("b", T0, 1.0)], "id_board string, _time timestamp, x double")
    with pytest.raises(ValueError):
        gaussian_fill(df, slicing.Slicing(("id_board",)), {"x": None}, cap_min=60)
