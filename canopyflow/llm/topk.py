"""Exact top-k by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import map_arrow, shuffle_partitions, stored

_BINS = 1024
#: vectors of one block: a task holds two blocks, their scores and one histogram
_BLOCK = 1024
#: bytes of query vectors that are sent to the candidates at once
_SENT = 32 << 20
_LONGS = {"query_id": T.LongType(), "bin": T.LongType(), "n": T.LongType()}


def _packed(rows: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """Rows in blocks of at most ``_BLOCK`` of one dimension: each column as bytes, ``v`` as all components one after the other."""
    def run(batches):
        for batch in batches:
            size = pc.list_value_length(batch.column("v"))
            for part in (alike.slice(i, _BLOCK) for d in pc.unique(size) for alike in [batch.filter(pc.equal(size, d))] for i in range(0, alike.num_rows, _BLOCK)):
                arrays = [part.column(c).flatten() if c == "v" else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([a.to_numpy().astype("<i8").tobytes()], pa.binary()) for a in arrays],
                                                 [prefix + c for c in columns])

    return map_arrow(rows.select(*columns), run, *(T.StructField(prefix + c, T.BinaryType()) for c in columns))


def _scored(batches):
    """For each pair of blocks: query ids, ``low``, ``want``, candidate ids, exact scores, and whether a score counts (not a row's own)."""
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("q_id", "q_low", "q_want", "q_v", "c_id", "c_v"))):
            q_id, low, want, q, c_id, c = (np.frombuffer(x.as_buffer(), "<i8") for x in row)
            q, c = q.reshape(len(q_id), -1), c.reshape(len(c_id), -1)
            if q.shape[1] != c.shape[1]:
                continue  # vectors of different dimensions have no product
            small = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0**53
            scores = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if small else q @ c.T  # whole numbers: exact either way
            yield q_id, low, want, c_id, scores, q_id[:, None] != c_id[None, :]


def _histograms(pairs: DataFrame, width: int) -> DataFrame:
    """Counts of scores in ``_BINS`` bins of ``width`` from each query's ``low`` on; of a block only from the top down to its ``want``-th."""
    def run(batches):
        for q_id, low, want, _, scores, counts in _scored(batches):
            at = (scores - low[:, None]) // width
            counts &= (at >= 0) & (at < _BINS)
            flat = np.bincount((np.arange(len(q_id))[:, None] * _BINS + at)[counts], minlength=len(q_id) * _BINS)
            down = flat.reshape(len(q_id), _BINS)[:, ::-1]
            above = np.cumsum(down, axis=1) - down
            i, j = np.nonzero((down > 0) & (above < want[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q_id[i]), pa.array(_BINS - 1 - j), pa.array(down[i, j])], list(_LONGS))

    return map_arrow(pairs, run, *(T.StructField(c, t) for c, t in _LONGS.items()))


def _winners(pairs: DataFrame) -> DataFrame:
    """Scores above each query's kth, and of those equal to it the ``want`` smallest ids of a block."""
    def run(batches):
        for q_id, low, want, c_id, scores, counts in _scored(batches):
            order = np.argsort(c_id, kind="stable")
            c_id, scores, counts = c_id[order], scores[:, order], counts[:, order]
            tie = counts & (scores == low[:, None])
            i, j = np.nonzero(counts & (scores > low[:, None]) | tie & (np.cumsum(tie, axis=1) <= want[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q_id[i]), pa.array(c_id[j]), pa.array(scores[i, j])], ["query_id", "vec_id", "score"])

    return map_arrow(pairs, run, *(T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")))


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, query_step: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` highest integer inner products of every query (ids divisible
    by ``query_step``) with all other rows, ties to the smaller id.

    Components become floor(scale * x). Each pass scores all pairs, block by block, and sends counts: of a query's scores in a block
    only the bins from the top down to the kth score. Their global sums locate the bin of the kth score; the next pass divides that
    bin, until a bin is one score wide. Then scores above it are kept, and of those equal to it the smallest ids, of which each block
    sends no more than are wanted.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id. Rows that repeat an
    id are each a candidate, but not of the query with that id, which is answered once, from its least vector. Vectors of different
    dimensions have no score with each other; other columns are not read; an empty table gives no rows. A vector is never cut, however long;
    components whose products pass 64 bits raise a ValueError.

    Candidates stay where they are; queries are sent to all of them, at most about ``_SENT`` bytes at a time.
    """
    x = F.col("v")
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(x.isNotNull() & (F.size(x) > 0) & F.col("id").isNotNull())
    rows = rows.where(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))))
    rows = stored(rows.select("id", F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v")))
    asked = rows.where(F.col("id") % query_step == 0).groupBy("id").agg(F.min("v").alias("v"))
    candidates = stored(_packed(rows.repartition(shuffle_partitions(vectors)), "c_", "id", "v"))

    squared = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    reach = int(rows.agg(F.max(squared)).first()[0] or 0) + 1  # one number: no inner product is larger
    if reach >= 1 << 61:
        raise ValueError("components are too large for 64-bit inner products")
    width = 1
    while width * _BINS < 2 * reach + 1:
        width *= _BINS
    asked = stored(asked.select("id", "v", F.lit(-reach).cast("long").alias("low"), F.lit(k).cast("long").alias("want")))

    def met(queries: DataFrame, pass_: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The pass over blocks of the stated queries against all rows, for so many queries at a time as may be broadcast."""
        blocks = stored(_packed(queries, "q_", "id", "low", "want", "v"))
        size = blocks.agg(F.sum(F.octet_length("q_v"))).first()[0] or 0
        n = -(-size // _SENT) or 1
        parts = [pass_(candidates.crossJoin(F.broadcast(blocks.where(F.pmod(F.xxhash64("q_id"), F.lit(n)) == i)))) for i in range(n)]
        return reduce(DataFrame.union, parts if n == 1 else map(stored, parts))

    while True:
        counts = met(asked, partial(_histograms, width=width)).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))  # at most _BINS rows of a query
        above = counts.withColumn("above", F.sum("n").over(down) - F.col("n")).join(asked.select(F.col("id").alias("query_id"), "want"), "query_id")
        found = above.where("above < want").groupBy("query_id").agg(F.min("bin").alias("bin"), F.max_by(F.col("want") - F.col("above"), F.col("above")).alias("left"))
        asked = stored(asked.join(stored(found), F.col("id") == F.col("query_id")).select(
            "id", "v", (F.col("low") + F.col("bin") * width).alias("low"), F.col("left").alias("want")))
        if width == 1:
            break
        width //= _BINS
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met(asked, _winners).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
