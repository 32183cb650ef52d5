"""Near-duplicate vectors by random hyperplanes and exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import keyed_chunks, local_labels, map_arrow, shuffle_partitions, split_hot, stored
from canopyflow.llm.components import connected_components

_SHARD = 256
#: others of the largest label that a vector shares a bucket of a table with, if they lie anywhere: rows that are alone stay where they are
_BUCKET = 0.25


def usable(vector: Column) -> Column:
    """Not null, with finite components of which at least one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows by dimension: (places, double matrix)."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = array.offsets.to_numpy()
    size = np.diff(ends)
    flat = array.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = []
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out.append((at, flat[ends[at][:, None] + np.arange(d)]))
    return out


def signatures(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``node`` and ``signature``: for each table the signs of ``bits`` products with random vectors, as a long."""
    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, tables), np.int64)
            for at, x in _matrix(batch.column("vector")):
                planes = np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1], tables * bits))
                signs = (x / np.abs(x).max(axis=1, keepdims=True) @ planes > 0).reshape(len(at), tables, bits)
                out[at] = signs @ (1 << np.arange(bits))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * tables, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "signature"])

    return map_arrow(classes.select("node", "vector"), run, T.StructField("node", T.LongType()), T.StructField("signature", T.ArrayType(T.LongType())))


def _pairs(meet, left, right, sign, x, limit):
    """Pairs of rows of one meeting with a cosine of at least ``limit``, each only in the first table that both share."""
    for a, b in zip(*(np.flatnonzero(np.diff(meet, prepend=meet[0] - 1, append=meet[-1] + 1))[s] for s in (slice(None, -1), slice(1, None)))):
        l, r = a + np.flatnonzero(left[a:b]), a + np.flatnonzero(right[a:b])
        near = x[l] @ x[r].T >= limit
        same = left[a:b].all() and right[a:b].all()
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        i, j = l[i], r[j]
        table = sign[i, -1]
        for s in range(0, len(i), 1 << 16):
            p, q = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
            first = np.argmax(sign[p, :-1] == sign[q, :-1], axis=1) == table[s:s + (1 << 16)]
            yield p[first], q[first]


def hyperplanes(largest: int, limit: float, missed: float = 3e-5) -> tuple[int, int]:
    """Bits of a table, and tables: vectors of the largest label that lie anywhere share a bucket with ``_BUCKET`` others of a table on average,
    whatever their number; two just at the limit share none in all tables with probability ``missed`` at most."""
    bits = min(max(4, math.ceil(math.log2(max(largest, 1) / _BUCKET))), 62)
    alike = (1 - math.acos(min(max(limit, -1.0), 1.0)) / math.pi) ** bits
    return bits, 1 if alike >= 1 else math.ceil(math.log(missed) / math.log1p(-alike))


def near_vectors(vectors: DataFrame, limit: float = 0.98, missed: float = 3e-5, seed: int = 7, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Id, ``n_links`` (other vectors with the same label and a cosine of at least ``limit``), ``component_id``, ``kept``.

    Equal vectors of a label are one class, linked to each other and looked at once. Two classes are compared where they share the
    signs of all hyperplanes of a table. Their number grows with the logarithm of the largest label, so that buckets do not, and that of the
    tables with it, so that a pair just at the limit is missed in all of them with probability ``missed``; nearer ones are missed less often.
    Found pairs are counted per class and returned as stars, never as pairs. Vectors that are null, zero or hold null or
    non-finite components, and those without a label, link with nothing; repeated rows link with each other; a null id counts in
    its links and names no component; vectors of different dimension do not link; other columns are not read; an
    empty table gives no rows.
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("vector"), vectors[label_col].alias("label"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("label").isNotNull())
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    good = rows.where("ok")
    classes = good.groupBy("label", "h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0  # one number
    signs = stored(signatures(classes, *hyperplanes(largest, limit, missed), seed))
    keyed = signs.join(classes.select(F.col("node").alias("_n"), "label"), F.col("node") == F.col("_n"))
    keyed = keyed.select("node", "label", F.posexplode("signature").alias("table", "s"))
    dealt = stored(split_hot(keyed.select("node", "table", F.xxhash64("label", "table", "s").alias("bucket")), _SHARD).drop("bucket"))
    whole = classes.join(signs.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select(F.col("node").alias("_node"), "label", "n", "vector", "signature")
    dealt = dealt.join(stored(whole), F.col("node") == F.col("_node")).drop("_node")
    dealt = dealt.repartition(shuffle_partitions(vectors), "meet").sortWithinPartitions("meet")

    def run(batches):
        for chunk in keyed_chunks(batches, "meet", 20_000):
            chunk = chunk.combine_chunks()
            node, n, meet, table = (chunk.column(c).to_numpy() for c in ("node", "n", "meet", "table"))
            left, right = (chunk.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
            sign = np.column_stack([np.stack(chunk.column("signature").to_numpy(zero_copy_only=False)), table])
            names, at = np.unique(node, return_inverse=True)
            links, ends = np.zeros(len(names), np.int64), []
            for places, x in _matrix(chunk.column("vector")):
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                for p, q in _pairs(*(v[places] for v in (meet, left, right, sign)), x, limit):
                    p, q = places[p], places[q]
                    np.add.at(links, at[p], n[q])
                    np.add.at(links, at[q], n[p])
                    label = local_labels(at[p], at[q], len(names))
                    away = np.flatnonzero(label != np.arange(len(names)))
                    ends.append((away, label[away]))
            a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (zip(*ends) if ends else ((), ())))
            label = local_labels(a, b, len(names))
            met = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(names[met], pa.int64()), pa.array(names[label[met]], pa.int64()), pa.array(links[met])], ["a", "b", "links"])

    found = stored(map_arrow(dealt, run, *(T.StructField(c, T.LongType()) for c in ("a", "b", "links"))))
    labels = connected_components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    members = classes.select("label", "h1", "h2", "node", "first", "n").join(stored(counts), F.col("node") == F.col("a"), "left")
    members = members.join(stored(labels).select(F.col("node").alias("_n"), F.col("label").alias("comp")), F.col("node") == F.col("_n"), "left")
    members = stored(members.withColumn("comp", F.coalesce("comp", "node")))
    smallest = stored(members.groupBy("comp").agg(F.min("first").alias("component_id")))
    members = stored(members.join(smallest, "comp").select(F.col("label").alias("_label"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component_id",
                                                   (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    linked = good.join(members, (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.select("id", "n_links", "component_id").union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
