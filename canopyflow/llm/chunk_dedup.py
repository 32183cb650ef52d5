"""Exact copies by recipes: texts are cut where their content says so, and compared as lists of verified chunk identifiers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import field, map_arrow, stored, text_slices

#: bytes of a chunk: least, most, and mean distance of places to cut as a power of two
_LEAST, _MOST, _MEAN_BITS = 256, 8192, 10
_WINDOW = 16
_BLOCK = 1 << 20
#: bytes of an identifier at first
_DIGEST = 16
#: slots of the sieve that tells candidates from the rest; bounds what the driver gets and tasks are sent (4 MB of ints, 512 kB of bits)
_SLOTS = 1 << 22
#: bytes of chunks that a task remembers, so as to hand a chunk on once
_REMEMBERED = 32 << 20
_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, np.uint32, endpoint=False)


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z, and nothing else, in lower case."""
    return (text or "").encode().lower()


def _places(data: bytes) -> Iterator[int]:
    """Ends of windows whose rolling hash has its top bits clear; they depend on the window's bytes only."""
    for lo in range(0, len(data), _BLOCK):
        start = max(0, lo - _WINDOW + 1)
        h = _GEAR[np.frombuffer(data, np.uint8, min(len(data), lo + _BLOCK) - start, start)]
        width = 1
        while width < _WINDOW:  # sums over twice as many bytes
            h[width:] += h[:-width] << np.uint32(width)
            width *= 2
        yield from (np.flatnonzero(h[lo - start:] >> np.uint32(32 - _MEAN_BITS) == 0) + lo + 1).tolist()


def chunks(data: bytes) -> Iterator[bytes]:
    """The chunks of a text in order; an empty one has none."""
    at = 0
    if len(data) > _LEAST:
        for end in _places(data):
            while end - at > _MOST:
                yield data[at:at + _MOST]
                at += _MOST
            if end - at >= _LEAST:
                yield data[at:end]
                at = end
    while at < len(data):
        yield data[at:at + _MOST]
        at += _MOST


def _digest(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _slot(recipe: bytes) -> int:
    return int.from_bytes(_digest(recipe, 4), "little") % _SLOTS


def _recipes(rows: DataFrame, size: int) -> DataFrame:
    """``id``, ``sha`` of the whole text, ``recipe`` (its chunks' identifiers in order) and the recipe's slot."""
    def run(batches):
        for part in text_slices(batches, "text"):
            sha, recipe = [], []
            for t in part.column("text").to_pylist():
                data = normalised(t)
                sha.append(hashlib.sha256(data).hexdigest())
                recipe.append(b"".join(_digest(c, size) for c in chunks(data)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sha), pa.array(recipe, pa.binary()), pa.array(map(_slot, recipe), pa.int32())],
                                             ["id", "sha", "recipe", "slot"])

    return map_arrow(rows, run, field(rows, "id"), T.StructField("sha", T.StringType()), T.StructField("recipe", T.BinaryType()), T.StructField("slot", T.IntegerType()))


def _chunks_of_copies(rows: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """``name`` (identifier) and ``bytes`` of the chunks of the texts whose recipe falls in a wanted slot, mostly once a task."""
    held = rows.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        bits, seen, room = held.value, set(), _REMEMBERED
        for part in text_slices(batches, "text"):
            out = []
            for t in part.column("text").to_pylist():
                parts = list(chunks(normalised(t)))
                names = [_digest(c, size) for c in parts]
                slot = _slot(b"".join(names))
                if not bits[slot >> 3] >> (7 - (slot & 7)) & 1:
                    continue
                for pair in zip(names, parts):
                    if pair not in seen:  # bytes are compared, not names alone
                        seen.add(pair)
                        room -= len(pair[1])
                        out.append(pair)
                if room < 0:
                    seen, room = set(), _REMEMBERED
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([c for _, c in out], pa.binary())], ["name", "bytes"])

    return map_arrow(rows, run, T.StructField("name", T.BinaryType()), T.StructField("bytes", T.BinaryType()))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row; texts are equal if they differ in the case of A-Z at most.

    Texts are cut in content-defined chunks, and a text's recipe is the list of its chunks' digests. Equal texts have equal recipes, so
    only recipes that occur twice are candidates. The chunks of those texts are collected, each once a task, and Spark compares their
    bytes: a digest is a chunk's identifier only when it stands for one content. If one stands for two, all is done again with digests
    twice as long. Then equal lists of identifiers are equal texts. No text leaves its task whole, and no chunk of a text without a
    candidate does, but for those in a candidate's slot of the sieve, which costs time only.

    The row with the largest id stays. A null text is empty, and empty texts are copies of each other; a null id is smaller than all
    others; of rows with the largest id and one text one stays, any of them; very long texts are cut block by block; an empty table
    gives none; other columns are not read. One row per input row.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    size = _DIGEST
    while True:
        recipes = stored(_recipes(rows, size).withColumn("row", F.monotonically_increasing_id()))
        groups = recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("last"), F.first("slot").alias("slot"))
        groups = stored(groups.where("group_size > 1"))
        slots = groups.select("slot").distinct().toArrow().column("slot").to_numpy()
        wanted = np.zeros(_SLOTS, bool)
        wanted[slots] = True
        contents = _chunks_of_copies(rows, size, wanted).distinct()
        if contents.groupBy("name").count().where("count > 1").isEmpty():
            break
        size *= 2
        if size > hashlib.blake2b.MAX_DIGEST_SIZE:
            raise ArithmeticError("two chunks share a digest of full length")
    members = groups.select(F.col("recipe").alias("_recipe"), "group_size", "last")
    out = recipes.join(members, F.col("recipe") == F.col("_recipe"), "left")
    alone = F.col("last").isNull()
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      (alone | (F.col("row") == F.col("last.row"))).alias("kept"), F.col("sha").alias("text_sha256"))
