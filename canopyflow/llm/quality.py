"""Quality scores by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import field, map_arrow, stored, text_slices

#: hashed n-grams and marks, hashed words, and a text's length beyond which its n-grams are read piece by piece
_SHAPES, _WORDS, _PIECE = 2048, 1024, 1 << 20
_TERMS = _SHAPES + _WORDS
#: rows of a product of matrices: always so many, because a row's rounding may depend on their number
_ROWS = 256
_MARKS = ("again", "again after one", "again after two", "words", "distinct words")


def _classes() -> bytes:
    """Bytes as character classes: upper case, lower case and bytes beyond ASCII, digit, space, line end, and each other character."""
    out = bytearray(range(256))
    for b in range(256):
        c = chr(b)
        out[b] = ord("A") if b < 128 and c.isupper() else ord("a") if b >= 128 or c.islower() else ord("0") if c.isdigit() else b
    return bytes(out)


_CLASS = _classes()


def terms(text: str) -> np.ndarray:
    """Counts of hashed terms of a whole text: character-class n-grams of 1 to 4, words that come again, and words (A-Z in lower case)."""
    raw = text.encode()
    counts = np.zeros(_SHAPES, np.float64)
    kinds = raw.translate(_CLASS)
    for start in range(0, len(kinds), _PIECE):
        x = np.frombuffer(kinds, np.uint8)[start:start + _PIECE + 3].astype(np.uint32)
        code = np.zeros(len(x), np.uint32)
        for n in range(1, 5):
            code = code[:len(x) - n + 1] * np.uint32(257) + x[n - 1:]
            mixed = (code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            counts += np.bincount((mixed[:_PIECE] >> np.uint32(16)) % np.uint32(_SHAPES - len(_MARKS)), minlength=_SHAPES)
    words = raw.split()
    for lag in (1, 2, 3):
        counts[-lag] = sum(map(bytes.__eq__, words, words[lag:]))
    counts[-4], counts[-5] = len(words), len(set(words))
    told = Counter(raw.lower().split())
    place = np.fromiter((zlib.crc32(w) % _WORDS for w in told), np.int64, len(told))
    return np.append(counts, np.bincount(place, np.fromiter(told.values(), np.float64, len(told)), minlength=_WORDS))


def weigh(counts: np.ndarray) -> np.ndarray:
    """Damped shares: a text's length does not decide."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.log1p(counts / total * 1000)


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows times a matrix, in blocks of one size: equal rows give equal results, whatever stands beside them."""
    out = [np.concatenate([x[i:i + _ROWS], np.zeros((max(0, i + _ROWS - len(x)), x.shape[1]), x.dtype)]) @ y for i in range(0, len(x), _ROWS)]
    return np.concatenate(out)[:len(x)] if out else np.zeros((0, y.shape[1]), np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class Space:
    """Labelled texts as unit vectors of a latent-semantic space."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(_product(weigh(counts) * self.idf, self.basis))

    def vote(self, x: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
        """Mean label of the nearest labelled vectors, each weighted by its cosine; of equally near ones those with the smallest ids count."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cos = _product(x, self.vectors.T)
        k = min(neighbours, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(cos, near, axis=1).min(axis=1)
        for i in np.flatnonzero((cos >= last[:, None]).sum(axis=1) > k).tolist():  # more are as near as the last one
            above = np.flatnonzero(cos[i] > last[i])
            near[i] = np.append(above, np.flatnonzero(cos[i] == last[i])[:k - len(above)])
        near.sort(axis=1)
        weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** sharpness
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), self.prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 8192, dimensions: int = 64, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", seed: int = 5) -> Space:
    """Learn from at most ``bound`` labelled documents (the smallest hashes of their ids) that are not held out.

    Documents with several different labels, and null labels, are left out; of documents that share an id the least text counts.
    The driver gets ``bound`` vectors of hashed terms at most, compressed, and holds them once, 12 kB each.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most")
    sample = known.select("id", "label").orderBy(F.xxhash64("id"), "id").limit(bound)  # at most `bound` rows: may be broadcast
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(stored(sample)), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for part in text_slices(batches, "text"):
            x = [zlib.compress(terms(t).astype(np.float32).tobytes(), 1) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(x, pa.binary())], ["id", "label", "x"])

    got = map_arrow(rows, run, field(rows, "id"), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())).toArrow()
    got = got.sort_by("id")
    x = np.empty((got.num_rows, _TERMS), np.float32)
    for i, raw in enumerate(got.column("x")):
        x[i] = np.frombuffer(zlib.decompress(raw.as_buffer()), np.float32)
    y = got.column("label").to_numpy().astype(np.float64)
    if not len(x):
        return Space(np.ones(_TERMS), np.zeros((_TERMS, 1)), np.zeros((0, 1), np.float32), y)
    idf = (np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))) + 1).astype(np.float32)
    for i in range(0, len(x), 256):  # in place
        x[i:i + 256] = weigh(x[i:i + 256]) * idf
    # the leading right singular vectors, by subspace iteration
    basis = np.random.default_rng(seed).standard_normal((_TERMS, min(dimensions, *x.shape))).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    return Space(idf, basis, unit(x @ basis), y)


def score(docs: DataFrame, space: Space, neighbours: int = 15, sharpness: float = 16.0, threshold: float = 0.7, id_col: str = "doc_id",
          text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) of every whole text, and the columns in ``keep``.

    The labelled vectors go along with the tasks: their number is bounded by ``fit``. A text without characters has no neighbours and
    takes the share of label 1, as all do if nothing is labelled (then 0.5). A null text is empty, a null id stays null and is not held
    out, equal texts have equal scores; very long texts are counted whole; an empty table gives none. No shuffle.
    """
    def run(batches):
        for part in text_slices(batches, "_text"):
            x = space.project(np.stack([terms(t or "") for t in part.column("_text").to_pylist()]))
            s = np.concatenate([space.vote(x[i:i + 256], neighbours, sharpness) for i in range(0, len(x), 256)])
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(s)], [*(f.name for f in kept), "_score"])

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"), *(docs[c].alias(f"_keep_{c}") for c in keep))
    kept = [field(rows, c) for c in rows.columns if c != "_text"]
    out = map_arrow(rows, run, *kept, T.StructField("_score", T.DoubleType()))
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"),
                      (F.col("_score") >= threshold).cast("int").alias("predicted"), *(F.col(f"_keep_{c}").alias(c) for c in keep if c != id_col))
