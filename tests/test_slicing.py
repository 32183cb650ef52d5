"""Slice widths."""

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopyflow.operators import slicing as sl

T0 = datetime(2024, 1, 1)


def skewed(spark):
    """One board sends every second for an hour, twenty send once a day."""
    rows = [("hot", T0 + timedelta(seconds=i), i) for i in range(3600)]
    rows += [(f"b{b}", T0 + timedelta(days=i), i) for b in range(20) for i in range(10)]
    return spark.createDataFrame(rows, "id_board string, _time timestamp, seq long")


def test_only_the_hot_board_is_narrowed(spark):
    s = sl.fit(skewed(spark), ["id_board"], max_rows=100)
    assert [(r.id_board, r._slice_width) for r in s.hot.collect()] == [("hot", 60_000_000)]
    sizes = s.assign(skewed(spark)).groupBy("id_board", sl.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 100


def test_no_join_without_hot_boards(spark):
    s = sl.fit(skewed(spark), ["id_board"])
    assert s.hot is None and s.width_s == sl.RUNGS[0]


def test_global_order_is_cut_too(spark):
    s = sl.fit(skewed(spark), [], max_rows=100)
    assert s.width_s == 60
    d = sl.ranked(skewed(spark), s, ["_time", "id_board"], "rank", "n")
    assert d.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.max("n")).first() == (1, 3800, 3800, 3800)


def test_halo_reaches_over_sparse_slices(spark):
    s = sl.Slicing(("id_board",), width_s=60)
    d = sl.row_halo(s.assign(skewed(spark).where("id_board = 'b1'")), s, ["_time"], before=3, after=2)
    per = {tuple(r)[0]: r["count"] for r in d.groupBy(sl.SLICE).count().collect()}
    assert sorted(per.values()) == [3, 4, 4, 5, 5, 6, 6, 6, 6, 6] or max(per.values()) == 6
    assert d.where(~F.col(sl.HALO)).count() == 10


def test_one_crowded_second(spark):
    """All rows in one second, most of them in one millisecond: ordered operators still cut them, and give what plain windows give."""
    rows = [("hot", T0 + timedelta(microseconds=int(i) if i % 4 else 997 * i), i, i % 7 if i % 3 else None) for i in range(900)] + [("b", T0, 0, 1)]
    d = spark.createDataFrame(rows, "id_board string, _time timestamp, seq long, x long").repartition(3).persist()
    for key in ([], ["id_board"]):
        s = sl.fit(d, key, max_rows=5)
        sizes = s.assign(d).groupBy(*key, sl.SLICE).count()
        assert sizes.agg(F.max("count")).first()[0] <= 5
        order = ["_time", "seq", "id_board"]
        w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
        w = w.orderBy(*order)
        known = F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        want = {(r.id_board, r.seq): (r.n, r.v) for r in d.select("id_board", "seq", F.row_number().over(w).alias("n"), known.alias("v")).collect()}
        got = sl.known(sl.ranked(d, s, order, "n"), s, order, last={"v": F.col("x")})
        assert {(r.id_board, r.seq): (r.n, r.v) for r in got.collect()} == want
