"""Every ridge penalty of every time fold from one set of normal equations.

Expanding time folds share their rows: fold k trains on blocks 0 to k and is tested on block k + 1. So each task adds up the products of all
model terms per block, the sums of the blocks are added one after the other, and each penalty, and each subset of the terms, is solved
from them. Three passes over the rows (ends of the terms, products, errors) take the place of a fit for each fold and penalty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.operators import sequence as seq
from canopyflow.operators import slicing as sl
from canopyflow.session import materialise

#: a product of columns
Term = tuple[str, ...]
_BLOCK = "_block"
#: partial sums of a block meet in so many groups first
_GROUPS = 16
#: rows whose terms a task holds at once
_ROWS = 8192


def linear(cols: Sequence[str]) -> list[Term]:
    return [(c,) for c in cols]


def cubic(cols: Sequence[str], base: Sequence[str]) -> list[Term]:
    """Products of up to three base columns, then the other columns."""
    own = [c for c in cols if c in base]
    return [t for d in (1, 2, 3) for t in combinations_with_replacement(own, d)] + [(c,) for c in cols if c not in base]


def _matrix(batch: pa.RecordBatch, terms: Sequence[Term]) -> np.ndarray:
    column = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in {c for t in terms for c in t}}
    return np.stack([np.prod([column[c] for c in t], axis=0) for t in terms], axis=1)


def _summed(blocks: DataFrame, make, add) -> dict[int, np.ndarray]:
    """What ``make`` gives for the rows of each block, put together by ``add``: in tasks, then in two rounds of groups. The driver gets
    one array for each block."""
    def parts(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in (batch.slice(i, _ROWS) for i in range(0, batch.num_rows, _ROWS)):
                at = part.column(_BLOCK).to_numpy()
                for b in np.unique(at).tolist():
                    new = make(part.filter(pa.array(at == b)), b)
                    held[b] = add(held[b], new) if b in held else new
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], [_BLOCK, "sums"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for raw in pdf["sums"]:
            x = np.frombuffer(raw)
            total = x if total is None else add(total, x)
        return pd.DataFrame({_BLOCK: pdf[_BLOCK].iloc[:1], "sums": [total.tobytes()]})

    out = T.StructType([T.StructField(_BLOCK, T.LongType()), T.StructField("sums", T.BinaryType())])
    some = blocks.mapInArrow(parts, out).withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(_GROUPS)))
    some = some.groupBy(_BLOCK, "_group").applyInPandas(together, out)
    rows = some.groupBy(_BLOCK).applyInPandas(together, out).collect()  # a row for each block
    return {r[_BLOCK]: np.frombuffer(r["sums"]) for r in rows}


@dataclass(frozen=True)
class Equations:
    """Ends, and centred products with the target, of the terms of some rows; terms are scaled by ``low`` and ``span`` of all rows."""

    n: float
    least: np.ndarray
    most: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def solve(self, penalty: float, use: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients and constant, for terms scaled by all rows, of the ridge fit on terms scaled by these rows' own ends."""
        span = (self.most - self.least)[use]
        scale = np.where(span > 0, 1 / np.where(span > 0, span, 1), 0.0)  # a constant term has no say
        at = np.append(use, len(self.sums) - 1)
        mean = self.sums[at] / self.n
        centred = self.products[np.ix_(at, at)] - self.n * np.outer(mean, mean)
        left = centred[:-1, :-1] * np.outer(scale, scale)
        coef = np.linalg.solve(left + penalty * np.eye(len(use)), centred[:-1, -1] * scale) * scale
        return coef, float(mean[-1] - coef @ mean[:-1])


def time_blocks(df: DataFrame, slicing: sl.Slicing, folds: int, order: Sequence[str] = ("_time", "id_board")) -> DataFrame:
    """Rows with the number of their block: fold k of ``ts_folds`` trains on blocks 0 to k and is tested on block k + 1."""
    d = sl.ranked(df, slicing, order, "_rank", "_count")
    block = F.floor(F.col("_count") / (folds + 1))
    after = F.col("_rank") - (F.col("_count") - block * folds)
    return d.withColumn(_BLOCK, F.when(after <= 0, 0).otherwise(F.ceil(after / block)).cast("long")).drop("_rank", "_count")


def equations(blocks: DataFrame, terms: Sequence[Term], target: str) -> tuple[dict[int, Equations], np.ndarray, np.ndarray]:
    """The equations of the rows up to each block, and the scale (low, span) their terms are in."""
    def ends(batch, _):
        x = _matrix(batch, terms)
        return np.concatenate([x.min(axis=0), x.max(axis=0)])

    k = len(terms)
    found = _summed(blocks, ends, lambda a, b: np.concatenate([np.minimum(a[:k], b[:k]), np.maximum(a[k:], b[k:])]))
    if not found:
        return {}, np.zeros(k), np.ones(k)
    low = np.min([x[:k] for x in found.values()], axis=0)
    span = np.max([x[k:] for x in found.values()], axis=0) - low
    span = np.where(span > 0, span, 1.0)

    def products(batch, _):
        y = batch.column(target).to_numpy(zero_copy_only=False).astype(float)
        x = np.column_stack([(_matrix(batch, terms) - low) / span, y])
        return np.concatenate([[len(y)], x.sum(axis=0), (x.T @ x).ravel()])

    sums = _summed(blocks, products, np.add)
    out, total, least, most = {}, 0.0, np.full(k, np.inf), np.full(k, -np.inf)
    for b in sorted(sums):
        total = total + sums[b]
        least, most = np.minimum(least, (found[b][:k] - low) / span), np.maximum(most, (found[b][k:] - low) / span)
        out[b] = Equations(total[0], least, most, total[1:k + 2], total[k + 2:].reshape(k + 1, k + 1))
    return out, low, span


@dataclass(frozen=True)
class Solution:
    """A fit of one variant and penalty on the rows of one fold, for terms as they are."""

    variant: str
    penalty: float
    fold: int
    terms: list[Term]
    coef: np.ndarray
    constant: float
    mae: float


def grid(train: DataFrame, variants: Mapping[str, Sequence[Term]], penalties: Mapping[str, Sequence[float]], target: str, folds: int) -> list[Solution]:
    """Each variant's fit with each of its penalties on each fold, and its mean absolute error on the fold's test rows.

    ``train`` has _time and id_board, the columns of the terms, and the target, none of them null. Variants may share terms: products are made
    once for all of them. What the driver holds grows with the square of the number of terms, not with the rows.
    """
    terms = list(dict.fromkeys(t for v in variants.values() for t in v))
    place = {t: i for i, t in enumerate(terms)}
    blocks = materialise(time_blocks(train.select("_time", "id_board", *dict.fromkeys(c for t in terms for c in t), target), sl.fit(train, []), folds))
    upto, low, span = equations(blocks, terms, target)
    jobs = [(v, p, k) for k in range(folds) for v in variants for p in penalties[v] if k in upto and k + 1 in upto]
    weights, constants = np.zeros((len(terms), len(jobs))), np.zeros(len(jobs))
    for i, (v, p, k) in enumerate(jobs):
        use = np.asarray([place[t] for t in variants[v]])
        weights[use, i], constants[i] = upto[k].solve(p, use)
    of_fold = {k: np.flatnonzero([j[2] == k for j in jobs]) for k in range(folds)}

    def errors(batch, b):
        mine = of_fold.get(b - 1, np.zeros(0, int))
        y = batch.column(target).to_numpy(zero_copy_only=False).astype(float)
        x = (_matrix(batch, terms) - low) / span
        out = np.zeros(len(jobs) + 1)
        out[-1] = len(y)
        out[mine] = np.abs(y[:, None] - x @ weights[:, mine] - constants[mine]).sum(axis=0)
        return out

    missed = _summed(blocks.where(F.col(_BLOCK) > 0), errors, np.add) if jobs else {}
    solved = []
    for i, (v, p, k) in enumerate(jobs):
        use = np.asarray([place[t] for t in variants[v]])
        coef = weights[use, i] / span[use]
        solved.append(Solution(v, p, k, list(variants[v]), coef, float(constants[i] - coef @ low[use]), float(missed[k + 1][i] / missed[k + 1][-1])))
    return solved
