"""SimHash near-duplicates by BK-trees over shards of fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import field, keyed_chunks, local_labels, map_arrow, shuffle_partitions, split_hot, stored, text_slices
from canopyflow.llm.components import connected_components

#: members of one shard tree of a crowded bucket
_SHARD = 512
_FRONTIER = 2_000_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits, signed: a bit is set if more than half of the shingles' XXH64 values have it; no words: zero."""
    import xxhash
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    if not parts:
        return 0
    whole = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[:max(1, len(parts) - words + 1)].tolist()
    ends = ends[min(words, len(parts)) - 1:].tolist()
    h = np.asarray([xxhash.xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts, ends)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``print`` (the fingerprint as a signed long) of every row; a null text has no words."""
    def run(batches):
        for part in text_slices(batches, "text"):
            prints = [fingerprint(t, words, seed) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints, pa.int64())], ["id", "print"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return map_arrow(rows, run, field(rows, "id"), T.StructField("print", T.LongType()))


def _masks(radius: int) -> list[int]:
    """Fingerprints at most ``radius`` bits apart agree on two of ``radius + 2`` blocks: the masks of all pairs of blocks."""
    edges = np.linspace(0, 64, radius + 3).astype(int).tolist()
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


class Trees:
    """BK-trees of many shards at once: a child hangs under its parent by their Hamming distance, one child for a distance.

    Nodes are places in ``prints``; ``shard`` is ascending. All trees grow by one level in a step.
    """

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        self.prints = prints = prints.view(np.uint64)  # of signed numbers, numpy counts the bits of the absolute value
        first = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1 if len(shard) else 0))
        self.root_of = {int(s): int(i) for s, i in zip(shard[first], first)}
        parent = first[np.searchsorted(first, np.arange(len(prints)), side="right") - 1]
        loose = np.setdiff1d(np.arange(len(prints)), first)
        keys, nodes = [], []
        while len(loose):
            key = parent[loose] * 65 + np.bitwise_count(prints[loose] ^ prints[parent[loose]])
            _, at, group = np.unique(key, return_index=True, return_inverse=True)
            keys.append(key[at])
            nodes.append(loose[at])
            parent[loose] = loose[at][group]
            loose = np.delete(loose, at)
        key, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nodes))
        order = np.argsort(key)
        self.edge, self.child = key[order], node[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of (query, node) at most ``radius`` apart; only edges within ``radius`` of the distance to the parent are followed."""
        queries, found = queries.view(np.uint64), []
        work = [(np.arange(len(queries)), roots)]
        while work:
            q, node = work.pop()
            while len(q):
                if len(q) > _FRONTIER:
                    work.append((q[_FRONTIER:], node[_FRONTIER:]))
                    q, node = q[:_FRONTIER], node[:_FRONTIER]
                d = np.bitwise_count(queries[q] ^ self.prints[node]).astype(np.int64)
                near = d <= radius
                found.append((q[near], node[near]))
                lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 1))
                hi = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), side="right")
                n = hi - lo
                ends = np.cumsum(n)
                node = self.child[np.repeat(lo - ends + n, n) + np.arange(ends[-1])]
                q = np.repeat(q, n)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def link_prints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links (``a``, ``b``) that connect exactly the distinct ``print`` values that chains of steps of at most ``radius`` bits connect.

    Any two within the radius share a bucket: the same bits under one of ten masks. Each bucket is a shard, or several if it is
    crowded, and every shard's tree goes to the tasks that hold queries for it. The trees of all data have no size bound, so they are
    dealt out with their queries and not broadcast. Links found in a task are returned as stars, at most one link for each print.
    """
    masks = _masks(radius)
    n = shuffle_partitions(prints)
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("print").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)]))
    rows = prints.select(F.col("print").alias("node"), bucket.alias("bucket"))
    dealt = split_hot(rows, _SHARD).select("meet", "node", "left", "right").repartition(n, "meet").sortWithinPartitions("meet")

    def run(batches):
        for chunk in keyed_chunks(batches, "meet"):
            meet, node = (chunk.column(c).to_numpy() for c in ("meet", "node"))
            left, right = (chunk.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
            trees = Trees(node[left], meet[left])
            asks = np.flatnonzero(right & np.isin(meet, meet[left]))
            roots = np.asarray([trees.root_of[m] for m in meet[asks].tolist()], np.int64)
            q, hit = trees.search(node[asks], roots, radius)
            names, at = np.unique(np.concatenate([node[asks][q], node[left][hit]]), return_inverse=True)
            label = local_labels(at[:len(q)], at[len(q):], len(names))
            away = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[away], pa.int64()), pa.array(names[label[away]], pa.int64())], ["a", "b"])

    return map_arrow(dealt, run, T.StructField("a", T.LongType()), T.StructField("b", T.LongType()))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id reachable by links of at most ``radius`` bits.

    Copies share a fingerprint and are looked at once. One row per input row; a null text has no words (fingerprint zero); very long texts
    are read whole; null ids count as no id, so a component of null ids has none; other columns are not read; an empty table gives none.
    """
    rows = stored(fingerprints(docs, words, seed, id_col, text_col))
    prints = stored(rows.groupBy("print").agg(F.min("id").alias("first")))
    labels = connected_components(stored(link_prints(prints.select("print"), radius)))
    labelled = stored(prints.join(labels, prints["print"] == labels["node"], "left").select("print", "first", F.coalesce("label", "print").alias("label")))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    members = stored(labelled.select("print", "label").join(stored(smallest), "label").select(F.col("print").alias("_print"), "component_id"))
    out = rows.join(members, rows["print"] == members["_print"])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
