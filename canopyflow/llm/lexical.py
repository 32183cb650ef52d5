"""Ranked lexical search, term at a time, with a limited number of accumulators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import field, first_rows, map_arrow, stored, text_slices, word_blocks

#: every ASCII character but digits and letters parts terms; A-Z become a-z
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: bytes of query texts that are answered together; more are answered in several rounds over the documents
_QUERY_BYTES = 8 << 20
#: postings that a task holds at once
_POSTINGS = 4_000_000
#: fixed values of the score
_SCALE, _TF, _LENGTH, _MEAN, _PART = 1_000_000_000, 1000, 20, 100, 50
_U4 = np.dtype("<u4")
_HIT = (T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or "").encode().translate(_TERMS).split()


@dataclass
class Queries:
    """Items of one round: their ids as an Arrow array, and the places of each item's different terms in ``vocabulary``."""

    ids: pa.Array
    vocabulary: dict[bytes, int]
    items: list[list[int]]


def _rounds(queries: DataFrame, id_col: str, text_col: str) -> Iterator[Queries]:
    """Items in rounds of about ``_QUERY_BYTES`` of text, so that what is sent along with tasks stays bounded; null texts have no terms."""
    rows = queries.select(queries[id_col].alias("id"), F.coalesce(queries[text_col], F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // _QUERY_BYTES) or 1
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        vocabulary: dict[bytes, int] = {}
        items = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms(text))] for text in part.column("text").to_pylist()]
        yield Queries(part.column("id").combine_chunks(), vocabulary, items)


def _index(spark: SparkSession, rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``id``, ``n`` (all terms of the text) and the text's postings: ``term`` (place in the vocabulary) and ``tf``, little-endian."""
    held = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        places = _Places(held.value)
        for part in text_slices(batches, "text"):
            ns, term, tf = [], [], []
            for t in part.column("text").to_pylist():
                n, hits = 0, [np.zeros(0, np.int64)]
                for words in word_blocks((t or "").encode().translate(_TERMS)):
                    at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                    n += np.count_nonzero(at <= places.other)
                    hits.append(at[at < places.other])
                at, found = np.unique(np.concatenate(hits), return_counts=True)
                ns.append(n)
                term.append(at.astype(_U4).tobytes())
                tf.append(found.astype(_U4).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ns, pa.int64()), pa.array(term, pa.binary()), pa.array(tf, pa.binary())], ["id", "n", "term", "tf"])

    kinds = (T.StructField("n", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("tf", T.BinaryType()))
    return map_arrow(rows, run, field(rows, "id"), *kinds)


class _Places(dict):
    """Place of a term in the vocabulary; unknown terms share one place, empty strings another."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__(vocabulary)
        self.other = len(vocabulary)
        self[b""] = self.other + 1

    def __missing__(self, term: bytes) -> int:
        return self.other


def _document_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is."""
    def run(batches):
        found = np.zeros(n_terms, np.int64)
        for batch in batches:
            for term in batch.column("term"):
                found[np.frombuffer(term.as_buffer(), _U4)] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at])], ["term", "df"])

    parts = map_arrow(index.select("term"), run, T.StructField("term", T.LongType()), T.StructField("df", T.LongType()))
    got = parts.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the queries at most
    out = np.zeros(n_terms, np.int64)
    out[got.column("term").to_numpy()] = got.column("df").to_numpy()
    return out


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A document's m: one part of it is fixed, the other goes by its length against the mean length."""
    if _PART * int(n.max(initial=0)) * documents < 1 << 63:
        return _MEAN - _PART + _PART * n * documents // total
    return np.asarray([_MEAN - _PART + _PART * x * documents // total for x in n.tolist()], np.int64)


def _id_ranks(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order, null before all others."""
    rank = np.empty(len(ids), np.int64)
    rank[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    return rank


class Block:
    """Postings of some documents, by term."""

    def __init__(self, ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int, total: int):
        self.ids, self.size = ids, len(ids)
        order = np.argsort(term, kind="stable")
        tf = tf[order].astype(np.int64)
        self.doc = doc[order]
        self.impact = _SCALE * tf // (_TF * tf + _LENGTH * lengths(n, documents, total)[self.doc])
        self.terms, first = np.unique(term[order], return_index=True)
        self.edge = np.append(first, len(order))
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, np.int64)
        self.at = {t: i for i, t in enumerate(self.terms.tolist())}
        self.rank = _id_ranks(ids)

    def search(self, wanted: list[int], weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places) that can be among the ``k`` best, and their scores. ``wanted``: terms, the rarest first.

        While the terms still to come could lift a document that has no accumulator yet to the kth partial score, a term's postings make
        accumulators; from then on they only add to those that exist. ``floor`` is a score that k documents are known to reach. A bound
        that equals the kth score may still win by its id, so accumulators end only below it.
        """
        here = [(self.at[t], int(weight[t])) for t in wanted if t in self.at and weight[t] > 0]
        bounds = [w * int(self.most[i]) for i, w in here]
        left = sum(bounds)
        score = np.zeros(self.size, np.int64)
        held = 0
        for done, ((i, w), bound) in enumerate(zip(here, bounds)):
            if held >= k and left < score.max():
                floor = max(floor, int(np.partition(score, self.size - k)[self.size - k]))
            if left < floor:
                break
            docs = self.doc[self.edge[i]:self.edge[i + 1]]
            score[docs] += w * self.impact[self.edge[i]:self.edge[i + 1]]  # impacts are above zero, so zero means no accumulator
            held = np.count_nonzero(score)
            left -= bound
        else:
            done = len(here)
        alive = np.flatnonzero(score)
        if done < len(here) and len(alive):  # only those that can still be among the best go on
            for (i, w), bound in zip(here[done:], bounds[done:]):
                alive = alive[score[alive] + left >= floor]
                goes_on = np.zeros(self.size, bool)
                goes_on[alive] = True
                docs = self.doc[self.edge[i]:self.edge[i + 1]]
                on = goes_on[docs]
                score[docs[on]] += w * self.impact[self.edge[i]:self.edge[i + 1]][on]
                left -= bound
                if len(alive) > k:
                    floor = max(floor, int(np.partition(score[alive], len(alive) - k)[len(alive) - k]))
        alive = alive[score[alive] > 0]
        best = np.lexsort((self.rank[alive], -score[alive]))[:k]
        return alive[best], score[alive[best]]


def _blocks(batches: Iterator[pa.RecordBatch], documents: int, total: int) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []
    size = 0

    def made() -> Block:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, n = t.column("id").combine_chunks(), t.column("n").to_numpy()
        raw = [np.frombuffer(x.as_buffer(), _U4) for x in t.column("term")]
        tf = [np.frombuffer(x.as_buffer(), _U4) for x in t.column("tf")]
        doc = np.repeat(np.arange(len(n)), [len(x) for x in raw])
        return Block(ids, n, doc, np.concatenate(raw), np.concatenate(tf), documents, total)

    for batch in batches:
        for part in text_slices([batch], "term", limit=_POSTINGS * 2):
            held.append(part)
            size += sum(len(x.as_buffer()) // 4 for x in part.column("term"))
            if size >= _POSTINGS:
                yield made()
                held, size = [], 0
    if any(b.num_rows for b in held):
        yield made()


def _best(index: DataFrame, items: list[list[int]], weight: np.ndarray, df: np.ndarray, k: int, documents: int, total: int) -> DataFrame:
    """``item`` (place), ``id`` and ``score`` of the best ``k`` documents of each item in each task."""
    held = index.sparkSession.sparkContext.broadcast(([sorted((t for t in x if df[t]), key=lambda t: (df[t], t)) for x in items], weight))

    def run(batches):
        wanted, w = held.value
        best: list[tuple[pa.Array, np.ndarray] | None] = [None] * len(wanted)
        for block in _blocks(batches, documents, total):
            for q, x in enumerate(wanted):
                known = best[q]
                floor = int(known[1][-1]) if known and len(known[1]) == k else 0
                at, score = block.search(x, w, k, floor)
                if not len(at):
                    continue
                ids = block.ids.take(pa.array(at))
                if known:  # this block's and those before
                    ids, score = pa.concat_arrays([known[0], ids]), np.concatenate([known[1], score])
                    first = np.lexsort((_id_ranks(ids), -score))[:k]
                    ids, score = ids.take(pa.array(first)), score[first]
                best[q] = ids, score
        for q, found in enumerate(best):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[1]), q, np.int32)), found[0], pa.array(found[1])], ["item", "id", "score"])

    return map_arrow(index, run, _HIT[0], field(index, "id"), _HIT[1])


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """Item id, ``rank``, document id and ``score`` of the ``k`` best documents (score above 0) for each item, all documents being ranked.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. The documents' postings of query terms are
    stored once; N, L and the document counts come from them. Each task then goes through its documents in blocks of bounded size and
    takes an item's terms one by one, the rarest first. It stops making accumulators when the bounds of the terms still to come do not
    reach the kth partial score (of this block, or of the task's blocks before), and goes on updating the accumulators that are left
    exactly; one whose score and bounds cannot reach the kth score any more is given up. A task hands on at most ``k`` rows an item.

    Equal scores go by ascending document id, a null id first; rows with equal ids are documents of their own. Null and empty texts have
    no terms and are not counted in N; a null or empty item, and an empty table, give no rows; a very long text is counted block by
    block; other columns are not read. Items are sent to the tasks, at most 8 MB of text at a time; beyond that there are several rounds.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = None
    for asked in _rounds(queries, item_col, item_text_col):
        index = stored(_index(spark, rows, asked.vocabulary))
        documents, total = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents or not asked.vocabulary:
            continue
        df = _document_counts(index, len(asked.vocabulary))
        weight = np.asarray([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        hits = _best(index, asked.items, weight, df, k, documents, total)
        names = spark.createDataFrame(pa.table([pa.array(np.arange(len(asked.items), dtype=np.int32)), asked.ids], ["_item", "_item_id"]))
        hits = first_rows(hits, k, ["item"], [F.desc("score"), F.asc("id")], by="id")
        hits = hits.join(F.broadcast(names), F.col("item") == F.col("_item"))  # an id for each item of the round
        hits = hits.select(F.col("_item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = hits if out is None else out.union(hits)
    if out is not None:
        return out
    return spark.createDataFrame([], T.StructType([field(queries, item_col), T.StructField("rank", T.IntegerType()), field(docs, id_col), T.StructField("score", T.LongType())]))
