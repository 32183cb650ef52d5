"""Best-fit packing of token pieces under several capacities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import field, map_arrow, stored, text_slices
from canopyflow.llm.encode import ID, encoder

NORM, DOT = "norm", "dot"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: tokens, documents (pieces), attention cost (the sum of squared lengths).

    ``rule`` picks the open sequence for a piece: ``norm`` the one whose weighted residual after it is shortest, ``dot`` the one
    whose weighted residual has the largest product with the piece's demand.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = NORM

    @property
    def longest(self) -> int:
        return min(self.tokens, int(np.sqrt(self.attention)))


def cut(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each whole text and ``end_id``; documents of more than ``longest`` ids are cut in pieces of so many, the first being
    what is left over. Per piece: id, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), and ``task`` and
    ``nth``: the piece is the nth of its length in its task. A null or empty text is one piece with the end id; a very long
    text gives many pieces; null ids stay null, repeated rows are documents of their own; an empty table gives none. No shuffle."""
    def run(batches):
        lib, seen, task = encoder(tokenizer), np.zeros(longest + 1, np.int64), TaskContext.get().partitionId()
        end = np.asarray([end_id], ID)
        for part in text_slices(batches, "text"):
            owner, piece, start, length, raw, nth = [], [], [], [], [], []
            for i, ids in enumerate(lib.encode(part.column("text").to_pylist())):
                ids = np.concatenate([ids, end])
                first = len(ids) % longest or longest
                edges = [0, *range(first, len(ids) + 1, longest)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    owner.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    raw.append(ids[a:b].tobytes())
                    nth.append(int(seen[b - a]))
                    seen[b - a] += 1
            n = len(owner)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(raw, pa.binary()), pa.array([task] * n, pa.int32()), pa.array(nth, pa.int64())],
                ["id", "piece", "start", "length", "ids", "task", "nth"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    long = T.LongType()
    out = map_arrow(rows, run, field(rows, "id"), T.StructField("piece", T.IntegerType()), T.StructField("start", long),
                    T.StructField("length", long), T.StructField("ids", T.BinaryType()), T.StructField("task", T.IntegerType()),
                    T.StructField("nth", long))
    return out.withColumnRenamed("id", id_col)


def plan(counts: dict[int, int], capacity: Capacity) -> np.ndarray:
    """Vector best-fit, longest pieces first, over lengths and their counts.

    Pieces of one length are alike, and so are sequences with equal residuals, so whole groups of them are placed at a time and the
    work depends on the number of lengths, not of pieces. Rows: length, first rank, pieces, first sequence, pieces in each sequence,
    offset of the first one. Pieces of one length are ranked from 0.
    """
    full = np.asarray([capacity.tokens, capacity.documents, capacity.attention], np.int64)
    weight = np.asarray(capacity.weights) / full
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual -> ranges of sequences (first, number)
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.asarray([length, 1, length * length], np.int64)
        while left:
            states = np.asarray(list(groups), np.int64).reshape(-1, 3)
            fits = np.flatnonzero((states >= need).all(axis=1))
            if len(fits):
                after = (states[fits] - need) * weight
                score = np.linalg.norm(after, axis=1) if capacity.rule == NORM else -(states[fits] * weight) @ (need * weight)
                state = tuple(states[fits[int(np.argmin(score))]].tolist())
                first, number = groups[state].pop()
                if not groups[state]:
                    del groups[state]
            else:
                state = tuple(full.tolist())
                number = -(-left // int((full // need).min()))
                first, opened = opened, opened + number
            each = min(left, int((np.asarray(state) // need).min()))
            used = min(number, left // each)  # sequences that get `each` pieces; what is left goes on with the next round
            runs.append((length, rank, used * each, first, each, capacity.tokens - state[0]))
            after = tuple((np.asarray(state) - each * need).tolist())
            if after[0] and after[1] and after[2]:
                groups.setdefault(after, []).append((first, used))
            if used < number:
                groups.setdefault(state, []).append((first + used, number - used))
            left, rank = left - used * each, rank + used * each
    return np.asarray(runs, np.int64).reshape(-1, 6)


def place(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (``length``, ``task``, ``nth`` as of ``cut``; other columns are carried).

    The driver gets one count per length, at most ``capacity.tokens`` rows, and plans on them. A piece's rank among those of its
    length is the number in earlier tasks, from counts per task and length, plus ``nth``; the rank gives its place in the plan.
    ``pieces`` has to be stored, so that ranks stay the same when a task runs again.
    """
    counted = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select(F.col("task").alias("_task"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    totals = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(totals, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    key = (runs[:, 0] << 44) + runs[:, 1]
    ranked = pieces.join(base, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length"))).drop("_task", "_length")
    kept = [f for f in pieces.schema if f.name not in ("task", "nth")]

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("_base").to_numpy()
            r = runs[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            inside, slot = np.divmod(rank - r[:, 1], r[:, 4]) if len(r) else (rank, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(r[:, 3] + inside), pa.array(r[:, 5] + slot * length)],
                                             [*(f.name for f in kept), "sequence_id", "offset"])

    return map_arrow(ranked, run, *kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ids and their places in as few sequences as the method finds.

    Repeated rows are packed as often as they stand there; null ids stay null; an empty table gives an empty one; columns other than
    id and text are not read.
    """
    return place(stored(cut(docs, tokenizer, end_id, capacity.longest, id_col, text_col)), capacity)
