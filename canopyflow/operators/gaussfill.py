"""Gaussian-weighted fill of short gaps, exact and in parallel.

A missing value is the weighted mean of the 5 known values before it (earlier fills count) and the 2 original values after
it, so fills depend on fills. Which values get filled, and every weight, depend on times only. A fill is therefore an affine
function of the 5 values before it, and a whole slice is an affine map of the 5 values it begins with. Slices run in
parallel: first each gives its map, then the maps are applied in slice order (one short row per slice), then each slice is
filled from its true start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import replace
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow import config as C
from canopyflow.operators.slicing import SLICE, Slicing, edge_rows, link
from canopyflow.session import materialise

_COL = "_col"
MINUTE_US = 60_000_000.0
#: entries that a task works through at once
CHUNK = 50_000


def _weights(t: np.ndarray, w: np.ndarray, at: np.ndarray, ot: np.ndarray, ow: np.ndarray, sigma: float):
    """Normalised weights of the values before and after each position ``at``; indices of the latter."""
    b = at[:, None] - C.FILL_BEFORE + np.arange(C.FILL_BEFORE)
    has_b, b = b >= 0, np.maximum(b, 0)
    a = np.searchsorted(ot, t[at], side="right")[:, None] + np.arange(C.FILL_AFTER)
    has_a = a < len(ot)
    a = np.minimum(a, max(len(ot) - 1, 0))

    def bell(dt: np.ndarray) -> np.ndarray:
        return np.exp(-((dt / MINUTE_US) ** 2) / (2 * sigma**2))

    wb = np.where(has_b, bell(t[b] - t[at][:, None]) * w[b], 0.0)
    wa = np.where(has_a, bell(ot[a] - t[at][:, None]) * ow[a], 0.0) if len(ot) else np.zeros(a.shape)
    total = wb.sum(1) + wa.sum(1)
    return wb / total[:, None], wa / total[:, None], a


class _Slice:
    """A slice's entries as they come in time order, filled some at a time; or their affine maps when the start is not known yet.

    An entry can be filled once two original values after it are there, and leaves when it is: what is held is a chunk, the values of the
    five entries before it, and what lies between two known values.
    """

    def __init__(self, sigma: float, as_map: bool):
        self.sigma, self.as_map, self.width = sigma, as_map, C.FILL_BEFORE + 1 if as_map else 1
        self.held, self.n, self.room = [], 0, CHUNK
        self.lead = np.zeros(0), np.zeros(0), np.zeros((0, self.width))  # times, weights and values of the last entries

    def add(self, part: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take entries (t, v, w, original, part, t as a whole number); times and values of those that are filled by now."""
        self.held.append(part)
        self.n += len(part[0])
        if self.n >= self.room:
            rows = [np.concatenate(x) for x in zip(*self.held)]
            known = rows[0][rows[3] & ~np.isnan(rows[1])]
            cut = int(np.searchsorted(rows[0], known[-2])) if len(known) > 1 else 0  # before two known values
            if cut:
                yield self._solve(rows, cut)
            self.held, self.n = [[x[cut:].copy() for x in rows]], len(rows[0]) - cut
            self.room = max(CHUNK, 2 * self.n)

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.n:
            rows = [np.concatenate(x) for x in zip(*self.held)]
            yield self._solve(rows, self.n)

    def _solve(self, rows: list[np.ndarray], cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Work the first ``cut`` entries through; the others are what follows them."""
        t, v, w, original, part, stamp = rows
        known = original & ~np.isnan(v)
        ot, ov, ow = t[known], v[known], w[known]
        mine = np.flatnonzero(part[:cut] <= 0)
        t, v, w, original, own, stamp = t[mine], v[mine], w[mine], original[mine], part[mine] == 0, stamp[mine]
        lead_t, lead_w, lead_x = self.lead
        first = len(lead_t)
        x = np.zeros((first + len(v), self.width))
        x[:first], x[first:, -1] = lead_x, np.nan_to_num(v)
        t, w = np.concatenate([lead_t, t]), np.concatenate([lead_w, w])
        if self.as_map:  # unknown starting values are the inputs of the map
            start = np.flatnonzero(np.isnan(v) & ~own) + first
            x[start, start] = 1.0
        at = np.flatnonzero(np.isnan(v) & own) + first
        if len(at):
            wb, wa, a = _weights(t, w, at, ot, ow, self.sigma)
            const = (wa * (ov[a] if len(ov) else 0.0)).sum(1)
            # a fill with none among the values before it begins an island: the first fills of all islands are made together, then the second ones
            begins = np.append(True, np.diff(at) > C.FILL_BEFORE)
            rank = np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            for k in np.split(np.argsort(rank, kind="stable"), np.cumsum(np.bincount(rank))[:-1]):
                i = at[k]
                x[i] = np.einsum("kb,kbw->kw", wb[k], x[np.maximum(i[:, None] - C.FILL_BEFORE + np.arange(C.FILL_BEFORE), 0)])
                x[i, -1] += const[k]
        self.lead = tuple(y[-C.FILL_BEFORE:].copy() for y in (t, w, x))
        made = ~original & own
        return stamp[made], x[first:][made, -1]


def _worked(batches: Iterator[pa.RecordBatch], on: list[str], sigma: float, as_map: bool) -> Iterator[tuple[list[pa.Scalar], _Slice, Iterator]]:
    """Each slice's key, its state and what ``add`` and ``close`` give, out of a task's rows ordered by slice and time; the last has to be used up."""
    def runs():
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = False
            for c in on:
                new[1:] |= np.diff(pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy()) != 0
            number = [pc.cast(batch.column(c), pa.float64()).to_numpy(zero_copy_only=False) for c in ("t", "v", "w")]
            number += [batch.column("original").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(), pc.fill_null(batch.column("t"), 0).to_numpy()]
            edges = np.append(np.flatnonzero(new), batch.num_rows).tolist()
            for i, j in zip(edges[:-1], edges[1:]):
                yield [batch.column(c)[i] for c in on], [x[i:j] for x in number]

    for _, parts in groupby(runs(), key=lambda x: [k.as_py() for k in x[0]]):
        s, first = _Slice(sigma, as_map), next(parts)

        def solved(s=s, parts=chain([first], parts)):
            for _, part in parts:
                yield from s.add(part)
            yield from s.close()
        yield first[0], s, solved()


def _entries(df: DataFrame, slicing: Slicing, cols: Mapping[str, Column | None], cap_us: int, when: Mapping[str, Column]) -> tuple[DataFrame, Slicing]:
    """Original values and gaps that will be filled, one row per column and time."""
    key = slicing.key
    cells = F.array(*[
        F.struct(F.lit(c).alias(_COL), F.col(c).alias("v"), (F.lit(1.0) if w is None else w.cast("double")).alias("w"),
                 when.get(c, F.lit(True)).alias("on")) for c, w in cols.items()])
    d = slicing.assign(df).select(*key, SLICE, F.unix_micros(slicing.time).alias("t"), F.inline(cells).alias(_COL, "v", "w", "on"))
    per = replace(slicing, key=(*key, _COL), hot=None)
    w = per.window("t")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = per.window(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_seen", F.when(F.col("v").isNotNull(), F.col("t")))
    d = d.withColumn("_break", F.when(F.col("t") - F.lag("t").over(w) > cap_us, F.col("t")))

    def scan(s: DataFrame) -> DataFrame:
        before, after = per.across(), per.across_back()
        turn = F.when(F.col("_first") - F.lag("_end").over(per._slices(F.col(SLICE).asc())) > cap_us, F.col("_first"))
        s = s.withColumn("_turn", turn)
        return s.select(*per.key, SLICE, F.max("_a").over(before).alias("_a_in"), F.min("_b").over(after).alias("_b_in"),
                        F.greatest(F.max(F.greatest("_brk", "_turn")).over(before), F.col("_turn")).alias("_brk_in"))

    d = link(d, per, {"_first": F.min("t"), "_end": F.max("t"), "_a": F.max("_seen"), "_b": F.min("_seen"), "_brk": F.max("_break")}, scan)
    a = F.coalesce(F.max("_seen").over(upto), F.col("_a_in"))
    b = F.coalesce(F.min("_seen").over(down), F.col("_b_in"))
    broken = F.greatest(F.max("_break").over(upto), F.col("_brk_in"))
    d = d.select(*per.key, SLICE, "t", "v", "w", "on", a.alias("_prev"), b.alias("_next"), broken.alias("_broken"))
    fills = (
        F.when(F.col("_prev").isNotNull() & F.col("_next").isNotNull(), F.col("_next") - F.col("_prev") <= cap_us)
        .when(F.col("_next").isNotNull(), F.col("_next") - F.col("t") <= cap_us)
        .when(F.col("_prev").isNotNull(), F.col("_broken").isNull() | (F.col("_broken") <= F.col("_prev")))
        .otherwise(F.lit(False))
    )
    e = d.where(F.col("v").isNotNull() | (fills & F.col("on")))
    return e.select(*per.key, SLICE, "t", "v", "w", F.col("v").isNotNull().alias("original")), per


def _following(e: DataFrame, per: Slicing) -> DataFrame:
    """The two originals after each slice."""
    one = F.struct("t", "v", "w")
    rank = F.sum(F.col("original").cast("int")).over(per.window("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = e.withColumn("_rank", F.when(F.col("original"), rank)).groupBy(*per.key, SLICE).agg(
        F.max(F.when(F.col("_rank") == 1, one)).alias("_f1"), F.max(F.when(F.col("_rank") == 2, one)).alias("_f2"))
    after = per.across_back()
    s = s.withColumn("_c1", F.last("_f1", True).over(after))
    s = s.withColumn("_pair", F.when(F.col("_f1").isNotNull(), F.array("_f1", F.coalesce("_f2", "_c1"))))
    s = s.withColumn("_two", F.last("_pair", True).over(after))
    s = s.select(*per.key, SLICE, F.explode("_two").alias("_o")).where(F.col("_o").isNotNull())
    return s.select(*per.key, SLICE, "_o.*", F.lit(True).alias("original"), F.lit(1).alias("part"))


def gaussian_fill(df: DataFrame, slicing: Slicing, cols: Mapping[str, Column | None], cap_min: float = C.FILL_CAP_MIN,
                  sigma_min: float = C.FILL_SIGMA_MIN, when: Mapping[str, Column] | None = None) -> DataFrame:
    """Fill the gaps of ``cols`` (column -> weight of its values, or None) that span at most ``cap_min`` minutes.

    Leading gaps need a value within the cap after them; trailing ones chain as long as rows follow within the cap.
    ``when`` limits a column's fills to rows where its condition holds for the whole series. ``df`` is read more than once:
    give it a table or a short plan.
    """
    if math.exp(-(cap_min**2) / (2 * sigma_min**2)) <= C.FILL_WEIGHT_FLOOR:
        raise ValueError("the cap reaches beyond the weights that still count")
    e, per = _entries(df, slicing, cols, int(cap_min * MINUTE_US), when or {})
    e = materialise(e)
    on = [*per.key, SLICE]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in e.select(*on).schema)
    before = edge_rows(e, per, ["t"], C.FILL_BEFORE, True).withColumn("part", F.lit(-1))
    rows = e.withColumn("part", F.lit(0)).unionByName(_following(e, per))
    if not before.where(~F.col("original")).isEmpty():
        before = _with_starts(before, rows, per, key_ddl, sigma_min)

    fields = [*e.select(*per.key, "t").schema, T.StructField("filled", T.DoubleType())]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0

        def flush():
            return pa.Table.from_batches(out).combine_chunks().to_batches()

        for key, _, parts in _worked(batches, on, sigma_min, False):
            for t, filled in parts:
                if len(t):
                    own = [pa.repeat(k, len(t)) for k in key[:-1]]
                    out.append(pa.RecordBatch.from_arrays([*own, pa.array(t), pa.array(filled, from_pandas=True)], [*per.key, "t", "filled"]))
                    n += len(t)
                if n >= CHUNK:
                    yield from flush()
                    out, n = [], 0
        if out:
            yield from flush()

    fills = _in_order(rows.unionByName(before), on).mapInArrow(finish, T.StructType(fields))
    wide = fills.groupBy(*slicing.key, "t").agg(*[F.max(F.when(F.col(_COL) == c, F.col("filled"))).alias(f"_g_{c}") for c in cols])
    wide = wide.withColumn(slicing.time, F.timestamp_micros("t")).drop("t")
    j = df.join(wide, [*slicing.key, slicing.time], "left")
    return j.select(*[F.coalesce(F.col(c), F.col(f"_g_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def _in_order(rows: DataFrame, on: list[str]) -> DataFrame:
    """Each slice in one task, its rows in time order; those without a time last."""
    return rows.repartition(*on).sortWithinPartitions(*on, F.col("t").asc_nulls_last())


def _with_starts(before: DataFrame, rows: DataFrame, per: Slicing, key_ddl: str, sigma: float) -> DataFrame:
    """Give the fills among the rows ahead of each slice their values."""
    on = [*per.key, SLICE]
    fields = [*rows.select(*on).schema, T.StructField("m", T.ArrayType(T.DoubleType()))]

    def to_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, s, parts in _worked(batches, on, sigma, True):
            for _ in parts:
                pass
            m = pa.array([s.lead[2].ravel()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(pa.repeat(k, 1) for k in key), m], [*on, "m"])

    maps = _in_order(rows.unionByName(before), on).mapInArrow(to_map, T.StructType(fields))

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        state, starts = np.zeros(0), []
        pdf = pdf.sort_values(SLICE)
        for m in pdf["m"]:
            starts.append(state.tolist())
            step = np.asarray(m, float).reshape(-1, C.FILL_BEFORE + 1)
            full = np.zeros(C.FILL_BEFORE + 1)
            full[:len(state)], full[-1] = state, 1.0
            state = step @ full
        return pdf[on].assign(start=starts)

    starts = maps.groupBy(*per.key).applyInPandas(chained, f"{key_ddl}, start array<double>")  # one row per slice
    ranked = before.withColumn("_k", F.row_number().over(per.window("t")))
    j = ranked.join(starts, on)
    return j.withColumn("v", F.coalesce("v", F.get("start", F.col("_k") - 1))).drop("_k", "start").select(before.columns)
