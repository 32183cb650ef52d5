"""Repeated passages by suffix sorting.

A string of ``length`` bytes is a window. Windows that are equal have equal shingles at equal places, so the shingle with the smallest
hash, its anchor, is the same in all of them. Neighbouring windows mostly have one anchor: such a run is a context. Contexts travel to
their anchor's bucket as hashes. Equal contexts are settled there; where an anchor has several different contexts, their bytes are
fetched and the suffixes that begin at their windows are sorted, deep-shallow: multikey quicksort to a shallow depth, blind tries for
what has a longer common prefix. So all text is hashed, but only suffixes that may repeat are sorted. An anchor with very many different
contexts would crowd one bucket, or one sort: its windows are told apart by hashes of all their bytes, which spreads them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import keyed_chunks, map_arrow, shuffle_partitions, stored

_ANCHOR = 32
#: bytes that a task hashes at once; 24 bits of an anchor's key are its place among them
_FLUSH, _PIECE = 1 << 21, 1 << 22
#: windows that a task tells apart at once
_HELD = 500_000
#: contexts of one anchor that are sorted together; those of a more frequent anchor are told apart window by window
_CROWD = 256
_SHALLOW = 32
_CONTEXT = np.dtype([("h", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("lo", "<i8"), ("n", "<i4"), ("off", "<i4")])
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: one document in so many, by the hash of its number, tells which anchors are very frequent; least number of their contexts there
_SAMPLE, _FREQUENT = 64, 32
_LONG = T.LongType()
_SPAN = [T.StructField(c, _LONG) for c in ("doc", "lo", "n")]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _content(letters: np.ndarray, base: int, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of ``size`` bytes from each place on."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(letters * _powers(base, len(letters)))])
    return _mix((total[at + size] - total[at]) * _powers(pow(base, -1, 1 << 64), len(letters))[at])


def contexts(texts: list[bytes], docs: list[int], starts: list[int], length: int = 100, frequent: np.ndarray | None = None) -> np.ndarray:
    """The contexts of all windows of the texts; ``starts``: where each text begins in its document.

    Fields: hash of the anchor, hash of the content, document, first window, number of windows, place of the anchor from the first.
    A window of a ``frequent`` anchor is a context of its own, with a hash of its content in place of the anchor's.
    """
    size = np.asarray([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    x = np.frombuffer(b"".join(texts), np.uint8)
    if not len(x) or size.max() < length:
        return np.zeros(0, _CONTEXT)
    letters = _TABLE[x]
    h, n, power = letters, 1, _BASE
    while n < _ANCHOR:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % (1 << 64), 2 * n
    h = _mix(h)
    place = np.uint64((1 << 24) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    width, step = length - _ANCHOR + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[:len(low) - (width - step)], low[width - step:])
    inside = np.zeros(len(x) + 1, np.int32)
    long = size >= length
    np.add.at(inside, (end - size)[long], 1)
    np.add.at(inside, (end - length + 1)[long], -1)
    windows = np.flatnonzero(np.cumsum(inside)[:len(low)])
    anchor = (low[windows] & place).astype(np.int64)
    owner = np.searchsorted(end, windows, side="right")
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    lo, owner, anchor = windows[first], owner[first], anchor[first]
    count = np.diff(np.append(first, len(windows)))
    out = np.zeros(len(first), _CONTEXT)
    out["h"], out["content"], out["n"], out["off"] = h[anchor], _content(letters, _BASE, lo, count + length - 1), count, anchor - lo
    out["doc"] = np.asarray(docs, np.int64)[owner]
    out["lo"] = lo - (end - size)[owner] + np.asarray(starts, np.int64)[owner]
    often = np.isin(out["h"], frequent) if frequent is not None and len(frequent) else np.zeros(len(out), bool)
    if not often.any():
        return out
    some, count = out[often], count[often]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, single = np.repeat(lo[often], count) + step, np.repeat(some, count)
    single["h"], single["content"] = _content(letters, _BASE_2, at, length), _content(letters, _BASE, at, length)
    single["lo"] += step
    single["n"], single["off"] = 1, 0
    return np.concatenate([out[~often], single])


def split_copies(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal contexts the earliest one, and the others: all their windows have started before."""
    c = c[np.lexsort((c["lo"], c["doc"], c["n"], c["content"], c["h"]))]
    again = np.zeros(len(c), bool)
    again[1:] = (c["h"][1:] == c["h"][:-1]) & (c["content"][1:] == c["content"][:-1]) & (c["n"][1:] == c["n"][:-1])
    return c[~again], c[again]


def merge_spans(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that touch or overlap, as one."""
    order = np.lexsort((lo, doc))
    doc, lo, n = doc[order], lo[order], n[order]
    if not len(doc):
        return doc, lo, n
    doc_at = np.cumsum(np.diff(doc, prepend=doc[0]) != 0)
    reach = np.maximum.accumulate(lo + n + doc_at * (1 << 40)) - doc_at * (1 << 40)
    new = np.flatnonzero(np.append(True, (doc_at[1:] != doc_at[:-1]) | (lo[1:] > reach[:-1])))
    return doc[new], lo[new], reach[np.append(new[1:], len(doc)) - 1] - lo[new]


def _packed(c: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Contexts by bucket, columns one after the other, compressed."""
    at = (c["h"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    c, at = c[order], at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    blobs = [b"".join(part[f].tobytes() for f in _CONTEXT.names) for part in np.split(c, first[1:])] if len(c) else []
    return at[first].tolist(), [len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True) for b in blobs]


def _unpacked(blob: bytes) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = np.zeros(len(raw) // _CONTEXT.itemsize, _CONTEXT), 0
    for f in _CONTEXT.names:
        kind = _CONTEXT[f]
        out[f] = np.frombuffer(raw, kind, len(out), at)
        at += kind.itemsize * len(out)
    return out


_BLOB = (T.StructField("bucket", _LONG), T.StructField("copies", T.BooleanType()), T.StructField("blob", T.BinaryType()))


def _emit(c: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Contexts for their buckets, after those that the same task has seen before; these go anywhere, as merged spans."""
    c, copies = split_copies(c)
    where, blobs = _packed(c, buckets)
    if len(copies):
        doc, lo, n = merge_spans(copies["doc"], copies["lo"], copies["n"])
        spans = np.zeros(len(doc), _CONTEXT)
        spans["doc"], spans["lo"], spans["n"] = doc, lo, n
        spans["h"] = doc.view(np.uint64) * np.uint64(_BASE) >> np.uint64(20)
        extra, more = _packed(spans, buckets)
    else:
        extra, more = [], []
    return pa.RecordBatch.from_arrays([pa.array(where + extra, pa.int64()), pa.array([False] * len(where) + [True] * len(extra), pa.bool_()),
                                       pa.array(blobs + more, pa.binary())], ["bucket", "copies", "blob"])


def _flushes(batches, length: int):
    """A task's texts as lists of bytes, documents and starts, about ``_FLUSH`` bytes at a time; long texts in pieces."""
    held, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
            view = memoryview(text.as_buffer() or b"") if text.is_valid else b""
            for start in range(0, max(1, len(view) - length + 1), _PIECE):  # pieces share length - 1 bytes: each window is in one
                part = bytes(view[start:start + _PIECE + length - 1])
                held.append((part, doc, start))
                size += len(part)
                if size >= _FLUSH:
                    yield tuple(map(list, zip(*held)))
                    held, size = [], 0
    if held:
        yield tuple(map(list, zip(*held)))


def _hashed(rows: DataFrame, length: int, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Each task's contexts, packed by bucket. ``rows``: doc, text."""
    def run(batches):
        for flush in _flushes(batches, length):
            yield _emit(contexts(*flush, length, frequent), buckets)

    return map_arrow(rows, run, *_BLOB)


def frequent_anchors(rows: DataFrame, length: int, buckets: int) -> np.ndarray:
    """Anchors with more different contexts than a bucket has room for, judged by a sample of documents: at most ``buckets`` of them.

    This decides only by which way windows travel, not which are found.
    """
    def run(batches):
        for flush in _flushes(batches, length):
            h, n = np.unique(split_copies(contexts(*flush, length))[0]["h"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    sample = rows.where(F.pmod(F.xxhash64("doc"), F.lit(_SAMPLE)) == 0)
    counts = stored(map_arrow(sample, run, T.StructField("h", _LONG), T.StructField("n", _LONG)).groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0  # one number
    often = counts.where(F.col("n") > max(_FREQUENT, total // buckets)).select("h").toArrow().column("h").to_numpy()
    return often.astype(np.int64).view(np.uint64)


def _settled(blobs: DataFrame) -> DataFrame:
    """Per bucket: ``kind`` 0, spans of windows that have started before; 1, contexts to be compared byte by byte; 2, contexts of an
    anchor that has very many."""
    def run(batches):
        for chunk in keyed_chunks(batches, "bucket", 1):
            copies = chunk.column("copies").to_numpy(zero_copy_only=False)
            blobs = chunk.column("blob").to_pylist()
            known = [_unpacked(b) for b, k in zip(blobs, copies) if k]
            met = [_unpacked(b) for b, k in zip(blobs, copies) if not k]
            first, again = split_copies(np.concatenate(met)) if met else (np.zeros(0, _CONTEXT),) * 2
            new = np.flatnonzero(np.diff(first["h"], prepend=first["h"][:1] - np.uint64(1)))
            crowd = np.repeat(np.diff(np.append(new, len(first))), np.diff(np.append(new, len(first))))
            parts = [(0, *merge_spans(*(np.concatenate([again[f], *(k[f] for k in known)]) for f in ("doc", "lo", "n"))))]
            for kind, rows in ((1, first[(crowd > 1) & (crowd <= _CROWD)]), (2, first[crowd > _CROWD])):
                parts.append((kind, rows["doc"], rows["lo"], rows["n"], rows["off"], rows["h"].view(np.int64)))
            for kind, doc, lo, n, *more in parts:
                off, h = more or (np.zeros(len(doc), np.int64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in (np.full(len(doc), kind), doc, lo, n, off, h)],
                                                 ["kind", "doc", "lo", "n", "off", "h"])

    return map_arrow(blobs, run, *(T.StructField(c, _LONG) for c in ("kind", "doc", "lo", "n", "off", "h")))


def _dealt(blobs: DataFrame, n: int) -> DataFrame:
    return blobs.repartition(n, "bucket").sortWithinPartitions("bucket")


def _fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents with the list of their contexts that are wanted."""
    lists = wanted.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("lo", "n", "off", "h")).alias("want"))
    return rows.join(stored(lists), F.col("doc") == F.col("_doc")).select("doc", "text", "want")


def _numbers(want: pa.Scalar) -> tuple[np.ndarray, ...]:
    values = want.values
    return tuple(values.field(c).to_numpy() for c in ("lo", "n", "off", "h"))


def _windows(fetched: DataFrame, length: int, buckets: int) -> DataFrame:
    """Each window of the wanted contexts as a context of its own; a task hands on many documents' windows at a time."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                lo, n, _, _ = _numbers(batch.column("want")[i])
                x = np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)
                for s in range(0, len(lo), 512):
                    count = n[s:s + 512]
                    at = np.repeat(lo[s:s + 512], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    letters = _TABLE[x[at[:, None] + np.arange(length)]]
                    out = np.zeros(len(at), _CONTEXT)
                    out["h"] = _mix((letters * _powers(_BASE, length)).sum(axis=1, dtype=np.uint64))
                    out["content"] = _mix((letters * _powers(_BASE_2, length)).sum(axis=1, dtype=np.uint64))
                    out["doc"], out["lo"], out["n"] = batch.column("doc")[i].as_py(), at, 1
                    held.append(out)
                    size += len(out)
                    if size >= _HELD:
                        yield _emit(np.concatenate(held), buckets)
                        held, size = [], 0
        if held:
            yield _emit(np.concatenate(held), buckets)

    return map_arrow(fetched, run, *_BLOB)


def _context_bytes(fetched: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for doc, text, want in zip(batch.column("doc"), batch.column("text"), batch.column("want")):
                lo, n, off, h = _numbers(want)
                view = memoryview(text.as_buffer())
                raw = [bytes(view[a:a + k + length - 1]) for a, k in zip(lo.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(lo), doc.as_py(), np.int64)), pa.array(lo), pa.array(n), pa.array(off),
                                                  pa.array(raw, pa.binary())], ["h", "doc", "lo", "n", "off", "raw"])

    return map_arrow(fetched, run, *(T.StructField(c, _LONG) for c in ("h", "doc", "lo", "n", "off")), T.StructField("raw", T.BinaryType()))


def sort_suffixes(x: np.ndarray, suffixes: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of ``x`` the place of the first one of its group that has the same first ``depth`` bytes.

    Suffixes are given in the order that decides which one is the first, and only those of one group are compared. All groups
    are sorted together. Shallow: groups are split by 8 bytes after 8 bytes, to ``_SHALLOW``. Deep: the first suffix of a group is a
    blind trie's spine; every other one is compared with it alone, and either equals it or branches off at the length of the common
    prefix with some byte; those that branch off alike are a trie of their own, until none is left.
    """
    x = np.concatenate([x, np.zeros(8, np.uint8)])
    word = np.ndarray((len(x) - 7,), ">u8", x.tobytes(), strides=(1,))
    same = np.arange(len(suffixes))
    live = np.argsort(group, kind="stable")
    live, key = live, group[live]

    def alone(live, key):
        """Without groups of one; keys numbered anew."""
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        keep = np.repeat(size, size) > 1
        return live[keep], np.cumsum(new)[keep]

    live, key = alone(live, key)
    for at in range(0, _SHALLOW, 8):
        w = word[suffixes[live] + at].astype(np.uint64)
        order = np.lexsort((live, w, key))
        live, key, w = live[order], key[order], w[order]
        live, key = alone(live, np.cumsum(np.append(True, (key[1:] != key[:-1]) | (w[1:] != w[:-1]))) if len(key) else key)
    while len(live):
        new = np.append(True, key[1:] != key[:-1])
        spine = np.flatnonzero(new)
        mine = np.cumsum(new) - 1
        rest = np.flatnonzero(~new)
        a, b = suffixes[live[rest]], suffixes[live[spine[mine[rest]]]]
        common = np.full(len(rest), depth)
        open_ = np.arange(len(rest))
        for at in range(_SHALLOW, depth, 8):
            differs = word[a[open_] + at].astype(np.uint64) ^ word[b[open_] + at].astype(np.uint64)
            if depth - at < 8:
                differs &= np.uint64(((1 << 64) - 1) ^ ((1 << 8 * (8 - depth + at)) - 1))
            hit = differs != 0
            bits = np.frexp((differs[hit] >> np.uint64(32)).astype(np.float64))[1]
            low = np.frexp((differs[hit] & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
            common[open_[hit]] = at + np.where(bits > 0, 32 - bits, 64 - low) // 8
            open_ = open_[~hit]
        equal = common == depth
        same[live[rest[equal]]] = live[spine[mine[rest[equal]]]]
        rest, common, a = rest[~equal], common[~equal], a[~equal]
        branch = (mine[rest] * (depth + 1) + common) * 256 + x[a + common]
        order = np.lexsort((live[rest], branch))
        live, key = alone(live[rest][order], branch[order])
    return same


def _sorted(parts: DataFrame, length: int) -> DataFrame:
    """Spans of windows that have started before, from the bytes of contexts dealt by anchor."""
    def run(batches):
        for chunk in keyed_chunks(batches, "h", 20_000):
            h, doc, lo, n, off = (chunk.column(c).to_numpy() for c in ("h", "doc", "lo", "n", "off"))
            order = np.lexsort((lo, doc))  # what comes first has started before
            h, doc, lo, n, off = (v[order] for v in (h, doc, lo, n, off))
            raw = chunk.column("raw").to_pylist()
            raw = [raw[i] for i in order.tolist()]
            begin = np.cumsum([0, *map(len, raw)])[:-1]
            owner = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            # equal windows have their anchor at the same place
            _, group = np.unique(np.unique(h, return_inverse=True)[1][owner] * (4 * length) + off[owner] - at, return_inverse=True)
            same = sort_suffixes(np.frombuffer(b"".join(raw), np.uint8), begin[owner] + at, group, length)
            again = np.flatnonzero(same != np.arange(len(same)))
            spans = merge_spans(doc[owner[again]], lo[owner[again]] + at[again], np.ones(len(again), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in spans], ["doc", "lo", "n"])

    return map_arrow(parts, run, *_SPAN)


def repeated_windows(rows: DataFrame, length: int = 100) -> DataFrame:
    """``doc``, ``lo``, ``n``: runs of windows that also start earlier. ``rows``: ``doc`` (long, unique, gives the order), ``text``."""
    tasks = shuffle_partitions(rows)
    buckets = 4 * tasks
    found = stored(_settled(_dealt(_hashed(rows, length, buckets, frequent_anchors(rows, length, buckets)), tasks)))
    near = _context_bytes(_fetched(rows, found.where("kind = 1")), length).repartition(tasks, "h").sortWithinPartitions("h")
    crowded = _settled(_dealt(_windows(_fetched(rows, found.where("kind = 2")), length, buckets), tasks))
    return found.where("kind = 0").select("doc", "lo", "n").union(_sorted(near, length)).union(crowded.where("kind = 0").select("doc", "lo", "n"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Add ``doc``, a number that gives the order of the rows: the id itself where it is a whole number, never null and never repeated;
    else rows are sorted by id (null first) and the text's hash, and numbered."""
    whole = isinstance(rows.schema["id"].dataType, (T.LongType, T.IntegerType, T.ShortType))
    if whole and (c := rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).first()).n == c.d:
        return rows.withColumn("doc", F.col("id").cast("long"))
    rows = rows.repartitionByRange(shuffle_partitions(rows), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    return stored(rows.withColumn("doc", F.monotonically_increasing_id()))


def _cover(lo: np.ndarray, n: np.ndarray, length: int, x: np.ndarray, whole_characters: bool) -> list[tuple[int, int]]:
    """The bytes that runs of windows cover, as maximal spans."""
    zero = np.zeros(len(lo), np.int64)
    out = []
    for a, k in zip(*(v.tolist() for v in merge_spans(zero, lo, n + length - 1)[1:])):
        b = a + k
        while whole_characters and a < b and x[a] & 0xC0 == 0x80:
            a += 1
        while whole_characters and a < b < len(x) and x[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def cut_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                whole_characters: bool = False) -> DataFrame:
    """Id, ``kept`` (the bytes that stay), ``spans`` (removed runs of bytes: start, end), ``n_bytes``, and the columns in ``keep``.

    Removed is each byte covered by a string of ``length`` bytes that also starts earlier: in a document before (smaller id; rows
    with one id, and rows without an id, which come first, in the order of their texts' hashes) or earlier in the same one. Matches never cross
    documents; strings are judged on the input. ``whole_characters`` leaves a character that a span would cut. A null text is empty;
    very long texts are cut like others, in windows. One row per input row, none for an empty table; of equal rows the first one keeps its text.
    Contexts that are equal, or around very frequent or crowded anchors, are told apart by 128 bits of hashes; the others by their bytes.
    """
    if length <= _ANCHOR:
        raise ValueError(f"strings must be longer than {_ANCHOR} bytes")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *(docs[c].alias(f"keep_{c}") for c in keep))
    rows = _in_order(rows)
    lists = repeated_windows(rows.select("doc", "text"), length).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    joined = rows.join(stored(lists), F.col("doc") == F.col("_doc"), "left").drop("_doc", "doc")
    carried = [f for f in rows.schema if f.name not in ("text", "doc")]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                kept, spans, sizes = [], [], []
                for text, runs in zip(part.column("text"), part.column("runs")):
                    x = np.frombuffer(text.as_buffer(), np.uint8)
                    cut = _cover(*(runs.values.field(c).to_numpy() for c in ("lo", "n")), length, x, whole_characters) if runs.is_valid else []
                    edges = [0, *(e for s in cut for e in s), len(x)]
                    kept.append(b"".join(x[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
                    spans.append([{"start": a, "end": b} for a, b in cut])
                    sizes.append(len(x))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in carried), pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array(sizes, pa.int64())],
                                                 [*(f.name for f in carried), "kept", "spans", "n_bytes"])

    span = T.ArrayType(T.StructType([T.StructField("start", _LONG), T.StructField("end", _LONG)]))
    out = map_arrow(joined, run, *carried, T.StructField("kept", T.BinaryType()), T.StructField("spans", span), T.StructField("n_bytes", _LONG))
    return out.select(F.col("id").alias(id_col), "kept", "spans", "n_bytes", *(F.col(f"keep_{c}").alias(c) for c in keep))
