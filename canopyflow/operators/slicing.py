"""Ordered operators over series of any size.

A window partitioned by series alone puts a whole series in one task. Here each series is cut in time
slices of bounded row count, windows run inside (series, slice), and what a slice needs from its
neighbours comes in one of two ways:

* ``link``      - one summary row per slice, scanned in slice order, joined back (running sums, last and
                  next known values, run positions),
* ``row_halo``  - the few rows next to the slice are copied in (lags, row frames).

Both are exact for every slice width. Stamps have microseconds, and so has the narrowest width: a slice holds more than ``MAX_ROWS`` rows
only where a single stamp of a key does.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from canopyflow.session import materialise

SLICE = "_slice"
HALO = "_halo"
_WIDTH = "_slice_width"
DAY = 86_400
RUNGS = (28 * DAY, DAY, 3_600, 60, 1, 0.001, 0.000001)
MAX_ROWS = 2_000_000


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def slice_of(time: str, width_us: Column) -> Column:
    """Number of the slice a stamp falls in. Stamps stay below 2 ** 53 microseconds for centuries, so the quotient is exact enough."""
    return F.floor(F.unix_micros(time) / width_us)


@dataclass(frozen=True)
class Slicing:
    """How series are cut: key columns, time column, width in seconds, narrower widths of hot keys."""

    key: tuple[str, ...]
    time: str = "_time"
    width_s: float = RUNGS[0]
    hot: DataFrame | None = field(default=None, compare=False)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the slice number of each row."""
        if self.hot is None:
            return df.withColumn(SLICE, slice_of(self.time, F.lit(micros(self.width_s))))
        joined = df.join(self.hot, list(self.key), "left")  # a row per hot key; adaptive execution picks the join by its size
        width = F.coalesce(F.col(_WIDTH), F.lit(micros(self.width_s)))
        return joined.withColumn(SLICE, slice_of(self.time, width)).drop(_WIDTH)

    def window(self, *order: str | Column) -> WindowSpec:
        return Window.partitionBy(*self.key, SLICE).orderBy(*order)

    def across(self) -> WindowSpec:
        """All slices before this one."""
        return self._slices(F.col(SLICE).asc()).rowsBetween(Window.unboundedPreceding, -1)

    def across_back(self) -> WindowSpec:
        """All slices after this one, nearest last (a growing frame: one step per row)."""
        return self._slices(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)

    def _slices(self, order: Column) -> WindowSpec:
        return (Window.partitionBy(*self.key) if self.key else Window.partitionBy(F.lit(0))).orderBy(order)


def fit(df: DataFrame, key: Sequence[str], time: str = "_time", max_rows: int | None = None) -> Slicing:
    """Measure ``df`` and choose slice widths so that no slice holds more than ``max_rows`` (MAX_ROWS) rows.

    One hash aggregation on two columns. Keys that overflow a width get the next narrower one; they stay a stored table.
    """
    key, max_rows = tuple(key), max_rows or MAX_ROWS
    todo = df.select(*key, time)
    widths: list[DataFrame] = []
    narrowest = RUNGS[0]
    for i, width in enumerate(RUNGS[:-1]):
        full = (
            todo.groupBy(*key, slice_of(time, F.lit(micros(width))).alias(SLICE))
            .count().where(F.col("count") > max_rows).select(*key, F.lit(1).alias("_one")).distinct().drop("_one")
        )
        if full.isEmpty():
            break
        narrowest = RUNGS[i + 1]
        if key:
            full = materialise(full)
            widths.append(full.withColumn(_WIDTH, F.lit(micros(narrowest)).cast("long")))
            todo = todo.join(full, list(key), "left_semi")
    if not widths:
        return Slicing(key, time, narrowest)
    hot = widths[0]
    for w in widths[1:]:
        hot = hot.unionByName(w)
    return Slicing(key, time, hot=materialise(hot.groupBy(*key).agg(F.min(_WIDTH).alias(_WIDTH))))


def position(order: Sequence[str]) -> Column:
    """Sort position of a row. A single column stays as it is: aggregates over fixed-width values hash, structs sort."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def link(
    df: DataFrame,
    slicing: Slicing,
    summary: Mapping[str, Column],
    scan: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Aggregate each slice, scan the summaries in slice order, join the scanned columns back.

    ``df`` carries SLICE. ``scan`` gets the summary (key, SLICE, summary columns) and returns key, SLICE and
    the columns to add. Data rows are shuffled once, on (key, slice); the summaries are small.
    """
    on = [*slicing.key, SLICE]
    summed = df.groupBy(*on).agg(*[c.alias(n) for n, c in summary.items()])
    return df.join(scan(summed), on, "left")


def carry(
    df: DataFrame,
    slicing: Slicing,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    totals: Mapping[str, tuple[Column, Callable[[str], Column]]] | None = None,
) -> DataFrame:
    """Add, per name, what the slices before (``sums``, ``lasts``), after (``nexts``) or all (``totals``) hold.

    A total is a pair: the aggregate over a slice and the aggregate that folds the slices.
    """
    sums, lasts, nexts, totals = sums or {}, lasts or {}, nexts or {}, totals or {}
    at = position(order)
    summary = {n: F.sum(c) for n, c in sums.items()}
    summary |= {n: F.max_by(c, F.when(c.isNotNull(), at)) for n, c in lasts.items()}
    summary |= {n: F.min_by(c, F.when(c.isNotNull(), at)) for n, c in nexts.items()}
    summary |= {n: c for n, (c, _) in totals.items()}
    before, after = slicing.across(), slicing.across_back()
    whole = Window.partitionBy(*slicing.key) if slicing.key else Window.partitionBy(F.lit(0))

    def scan(s: DataFrame) -> DataFrame:
        return s.select(
            *slicing.key, SLICE,
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
            *[F.last(n, True).over(before).alias(n) for n in lasts],
            *[F.last(n, True).over(after).alias(n) for n in nexts],
            *[fold(n).over(whole).alias(n) for n, (_, fold) in totals.items()],
        )

    return link(df, slicing, summary, scan)


def edge_rows(df: DataFrame, slicing: Slicing, order: Sequence[str], n: int, tail: bool) -> DataFrame:
    """For every slice of ``df`` the ``n`` rows nearest to it in the slices before (``tail``) or after it.

    Per slice at most ``n`` rows are kept in an array, however many rows the slice holds.
    """
    cols = df.columns
    on = [*slicing.key, SLICE]
    row = F.struct(*[F.col(c) for c in cols if c not in on])

    def away(c: Column) -> Column:
        return c.desc() if tail else c.asc()

    kept = df.withColumn("_n", F.row_number().over(slicing.window(*[away(F.col(c)) for c in order]))).where(F.col("_n") <= n)
    near = kept.groupBy(*on).agg(F.collect_list(row).alias("_edge"))
    # each neighbour slice holds at least one row, so n neighbours are enough for n rows
    over = slicing._slices(F.col(SLICE).asc() if tail else F.col(SLICE).desc()).rowsBetween(-n, -1)
    rows = near.select(*on, F.flatten(F.collect_list("_edge").over(over)).alias("_rows")).select(*on, F.explode("_rows").alias("_r"))
    nearest = slicing.window(*[away(F.col("_r")[c]) for c in order])
    picked = rows.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= n)
    return picked.select(*[F.col(c) if c in on else F.col("_r")[c].alias(c) for c in cols])


def row_halo(df: DataFrame, slicing: Slicing, order: Sequence[str], before: int, after: int = 0) -> DataFrame:
    """Copy the ``before`` rows ahead of each slice and the ``after`` rows behind it into the slice.

    Copies have HALO true; drop them once the row-framed columns are computed.
    """
    out = df.withColumn(HALO, F.lit(False))
    for n, tail in ((before, True), (after, False)):
        if n:
            out = out.unionByName(edge_rows(df, slicing, order, n, tail).withColumn(HALO, F.lit(True)))
    return out


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO)


def ranked(df: DataFrame, slicing: Slicing, order: Sequence[str], rank: str = "rank", count: str | None = None) -> DataFrame:
    """1-based position of each row in its series (and the series' row count), without a whole-series window."""
    sliced = carry(slicing.assign(df), slicing, order, sums={"_before": F.lit(1)},
                   totals={"_total": (F.count(F.lit(1)), F.sum)} if count else None)
    out = sliced.withColumn(rank, F.col("_before") + F.row_number().over(slicing.window(*order)))
    if count:
        out = out.withColumn(count, F.col("_total"))
    return out.drop("_before", "_total", SLICE)


def known(
    df: DataFrame,
    slicing: Slicing,
    order: Sequence[str],
    last: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    totals: Mapping[str, tuple[Column, Callable[[str], Column]]] | None = None,
) -> DataFrame:
    """Nearest non-null values around each row of its series.

    ``last`` / ``following`` include the row itself, ``before`` / ``after`` do not. ``totals`` as in carry().
    """
    last, before, following, after = last or {}, before or {}, following or {}, after or {}
    d = slicing.assign(df) if SLICE not in df.columns else df
    d = carry(d, slicing, order,
              lasts={f"_in_{n}": c for n, c in {**last, **before}.items()},
              nexts={f"_in_{n}": c for n, c in {**following, **after}.items()}, totals=totals)
    up = slicing.window(*order)
    down = slicing.window(*[F.col(c).desc() for c in order])
    first, now = Window.unboundedPreceding, Window.currentRow
    frames = {"last": up.rowsBetween(first, now), "before": up.rowsBetween(first, -1),
              "following": down.rowsBetween(first, now), "after": down.rowsBetween(first, -1)}
    new = []
    for kind, cols in (("last", last), ("before", before), ("following", following), ("after", after)):
        new += [F.coalesce(F.last(c, True).over(frames[kind]), F.col(f"_in_{n}")).alias(n) for n, c in cols.items()]
    new += [F.col(n) for n in totals or {}]
    made = {*last, *before, *following, *after, *(totals or {})}
    keep = [F.col(c) for c in df.columns if c not in made and c != SLICE]
    return d.select(*keep, *([F.col(SLICE)] if SLICE in df.columns else []), *new)


def run_position(
    df: DataFrame,
    slicing: Slicing,
    order: Sequence[str],
    counted: Column,
    breaks: Column | None = None,
    changes: Column | None = None,
    out: str = "run_pos",
) -> DataFrame:
    """Number of ``counted`` rows since the run began, the row itself included.

    A run begins at a row where ``breaks`` holds, or where ``changes`` differs from the row before.
    """
    d = slicing.assign(df)
    w = slicing.window(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.when(counted, 1).otherwise(0)
    if changes is not None:
        d = d.withColumn("_val", changes)
        d = d.withColumn("_prev", F.lag(F.struct("_val")).over(w))
        cut = F.col("_prev").isNotNull() & ~F.col("_prev._val").eqNullSafe(F.col("_val"))
    else:
        d = d.withColumn("_val", F.lit(None).cast("string"))
        cut = F.coalesce(breaks, F.lit(False))
    d = d.withColumn("_c", F.sum(one).over(upto)).withColumn("_base", F.when(cut, F.col("_c") - one))
    at = position(order)

    def scan(s: DataFrame) -> DataFrame:
        before = slicing.across()
        s = s.withColumn("_n_in", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        if changes is not None:
            prior = F.lag("_ends").over(slicing._slices(F.col(SLICE).asc()))
            s = s.withColumn("_turn", prior.isNotNull() & ~prior["_val"].eqNullSafe(F.col("_begins._val")))
        else:
            s = s.withColumn("_turn", F.lit(False))
        s = s.withColumn("_own", F.coalesce(F.col("_n_in") + F.col("_last_base"), F.when(F.col("_turn"), F.col("_n_in"))))
        s = s.withColumn("_base_in", F.when(F.col("_turn"), F.col("_n_in")).otherwise(
            F.coalesce(F.last("_own", True).over(before), F.lit(0))))
        return s.select(*slicing.key, SLICE, "_n_in", "_base_in")

    val = F.struct("_val")
    d = link(d, slicing, {
        "_n": F.sum(one),
        "_last_base": F.max_by("_base", F.when(F.col("_base").isNotNull(), at)),
        "_begins": F.min_by(val, at),
        "_ends": F.max_by(val, at),
    }, scan)
    base = F.coalesce(F.col("_n_in") + F.last("_base", True).over(upto), F.col("_base_in"))
    return d.withColumn(out, F.col("_n_in") + F.col("_c") - base).drop(
        "_c", "_base", "_val", "_prev", "_n_in", "_base_in", SLICE)
