"""Phrase collocations: Misra-Gries summaries keep every frequent phrase, a second pass counts those exactly."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import first_rows, map_arrow, shuffle_partitions, stored, text_slices, word_blocks

#: A-Z become a-z; what parts pieces becomes a line feed, a tab a space
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_PART, _SKIP, _RARE = 0, 1, 2  # numbers of the word "\n", which parts pieces, of the empty word, and of all that ``Frequent`` keeps no number for
#: phrases that a task gathers before it sends them on; in the second pass equal ones become one first, and are sent if over half are left
_FLUSH, _FLUSH_EXACT = 12_000_000, 3_000_000
#: text that a task of the second pass reads at most, if it can be left whole: each task sends nearly every frequent phrase once
_COUNTED_BYTES = 128 << 20
#: words that a task gives numbers to before it starts anew
_WORDS = 300_000
#: phrases in a batch that a task of the second pass sends
_SENT_ROWS = 50_000
#: bytes of packed counters that a task sends on at once
_SENT = 4 << 20
#: text of one hash partition, and ranges that its summaries are made for, one by one
_PART_BYTES, _RANGES = 64 << 20, 16
#: bits of a hash by which the second pass tells survivors: a bitmap of so many bits (8 MB) goes to the tasks at any size of the input
_SIEVE_BITS = 26
_ODD = np.random.default_rng(11).integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD_0, _ODD_1, _MOD = int(_ODD[0]), int(_ODD[1]), (1 << 64) - 1
_U4 = np.dtype("<u4")


class Numbers(dict):
    """Words numbered as they come, with a 64-bit hash of each."""

    def __init__(self):
        import xxhash
        super().__init__({b"\n": _PART, b"": _SKIP, b" ": _RARE})
        self.hashes, self.digest = array("Q", [0, 0, 0]), xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        return self.add(word, self.digest(word))

    def add(self, word: bytes, h: int) -> int:
        self[word] = n = len(self)
        self.hashes.append(h)
        return n


class Frequent(Numbers):
    """Numbers of the words that pass the sieve in a language they were met in, whose ``seed`` is set before. A word that does not is
    ``_RARE`` and is not held: most words of a text are rare, and no phrase that has one is frequent."""

    def __init__(self, sieve: np.ndarray):
        super().__init__()
        self.seed, self.sieve = 0, memoryview(sieve.astype("<u8", copy=False).view(np.uint8))

    def __missing__(self, word: bytes) -> int:
        h = self.digest(word)
        x = self.seed + h * _ODD_1 & _MOD  # as in ``mixed``
        x = (x ^ x >> 32) * _ODD_0 & _MOD
        slot = (x ^ x >> 29) >> 64 - _SIEVE_BITS
        return self.add(word, h) if self.sieve[slot >> 3] >> (slot & 7) & 1 else _RARE


def word_numbers(texts: list[bytes], numbers: Numbers, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """The words of the texts, with ``_PART`` between pieces and texts, block by block. A block begins with the ``longest - 1`` words
    before it; the place where its own begin is the second value."""
    data = b"\n".join(texts).translate(_LETTERS).replace(b"\n", b" \n ")
    before = np.zeros(0, np.int32)
    for words in word_blocks(data):
        at = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        at = np.concatenate([before, at[at != _SKIP]])
        yield at, len(before)
        before = at[len(at) - longest + 1:] if len(at) >= longest else at


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _ODD[0]
    return x ^ (x >> np.uint64(29))


def hashes(words: np.ndarray, own: int, table: np.ndarray, seed: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: places where a phrase begins that lies in a piece and ends among the block's own words, and the phrases' hashes."""
    real, h = words != _PART, table[words]
    total, fits = np.full(len(words), seed, np.uint64), np.ones(len(words), bool)
    for n in range(1, longest + 1):
        if len(words) < n:
            return
        total = total[:len(words) - n + 1] + h[n - 1:] * _ODD[n]
        fits = fits[:len(words) - n + 1] & real[n - 1:]
        at = np.flatnonzero(fits)
        at = at[np.searchsorted(at, own - n + 1):] if own else at
        yield n, at, mixed(total[at])


def passing(words: np.ndarray, own: int, table: np.ndarray, seed: int, longest: int, sieve: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length: places as ``hashes`` gives them, of the phrases that pass the sieve with all their parts. A part is as frequent as
    the phrase or more, so no frequent phrase is left out."""
    h, total, fits = table[words], np.full(len(words), seed, np.uint64), words > _RARE
    for n in range(1, longest + 1):
        if len(words) < n:
            return
        total = total[:len(words) - n + 1] + h[n - 1:] * _ODD[n]
        fits = fits[:-1] & fits[1:] if n > 1 else fits
        at = np.flatnonzero(fits)
        slot = mixed(total[at]) >> np.uint64(64 - _SIEVE_BITS)
        on = (sieve[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        fits[at] = on
        at = at[on]
        yield n, at[np.searchsorted(at, own - n + 1):] if own else at


def _seed(lang: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(lang.encode(), 11)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for part in text_slices(batches, "text"):
        pairs = zip(part.column("lang").to_pylist(), pc.cast(part.column("text"), pa.binary()).to_pylist())
        for lang, rows in groupby(sorted(pairs, key=lambda x: x[0]), key=lambda x: x[0]):
            yield lang, [text for _, text in rows]


# -- summaries ---------------------------------------------------------------------------------------------------------------------

def _planes(numbers: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits, a multiple of four: their bytes from the lowest on, one plane after the other, then half bytes."""
    out = [(numbers >> np.uint32(8 * i)).astype(np.uint8).tobytes() for i in range(width // 8)]
    if width % 8:
        half = np.append(numbers >> np.uint32(width - 4), np.zeros(len(numbers) % 2, np.uint32)).astype(np.uint8) & 15
        out.append((half[::2] | half[1::2] << 4).tobytes())
    return b"".join(out)


def _planes_bytes(n: int, width: int) -> int:
    return n * (width // 8) + (n + 1) // 2 * (width % 8 > 0)


def _numbers(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for i in range(width // 8):
        out |= np.frombuffer(data, np.uint8, n, i * n).astype(np.uint32) << np.uint32(8 * i)
    if width % 8:
        half = np.frombuffer(data, np.uint8, (n + 1) // 2, n * (width // 8))
        out |= np.stack([half & 15, half >> 4], axis=1).ravel()[:n].astype(np.uint32) << np.uint32(width - 4)
    return out


def pack(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """Ascending keys as differences of ``width`` bits, and their counts: of half a byte, or, from 15 on, of eight more."""
    full = np.uint64((1 << width) - 1)
    steps = np.diff(keys, prepend=np.uint64(0))
    jumps = (steps // full).astype(np.int64)  # each adds ``full`` and stands for no key
    stream = np.full(len(keys) + int(jumps.sum()), full, np.uint32)
    stream[np.arange(len(keys)) + np.cumsum(jumps)] = steps % full
    large = counts >= 15
    sizes = np.asarray([len(keys), len(stream)], _U4)
    return b"".join([sizes.tobytes(), _planes(stream, width), _planes(np.where(large, 15, counts).astype(np.uint32), 4), counts[large].astype("<i8").tobytes()])


def unpack(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, _U4, 2).tolist()
    at = 8 + _planes_bytes(m, width)
    stream = _numbers(data[8:at], m, width)
    keys = np.cumsum(stream, dtype=np.uint64)[stream != (1 << width) - 1]
    counts = _numbers(data[at:], n, 4).astype(np.int64)
    counts[counts == 15] = np.frombuffer(data, "<i8", offset=at + _planes_bytes(n, 4))
    return keys, counts


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters that others can be merged into.

    A key's counter is below its true count by ``lost`` at most. As each unit of ``lost`` took ``capacity + 1`` from the mass, a
    capacity of more than mass / threshold keeps ``lost`` below the threshold, and every key that reaches the threshold has a counter.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in parts)])
        counts = np.concatenate([self.counts, *(c for _, c in parts)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > self.capacity:
            least = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            stay = counts > least
            keys, counts, self.lost = keys[stay], counts[stay] - least, self.lost + least
        self.keys, self.counts = keys, counts


def _edges(bits: int, parts: int) -> np.ndarray:
    """Where each range of keys begins."""
    return np.asarray([(i << bits) // (parts * _RANGES) for i in range(parts * _RANGES)], np.uint64)


def _summaries(rows: DataFrame, longest: int, bits: int, parts: int) -> DataFrame:
    """A task's phrases as counters: for each hash partition (``part``) the mass and the packed counters of its ranges.

    A summary holds no more counters than phrases were gathered. That is far below its share of the capacity, so none is dropped here.
    """
    width, kind = _width(bits), np.uint32 if bits <= 32 else np.uint64
    edges = _edges(bits, parts)

    def summary(keys):
        """Sorts ``keys`` in place; what else is made is made for a partition at a time."""
        keys.sort()
        cut = np.append(np.searchsorted(keys, edges.astype(kind)), len(keys))
        part, mass, packed, size = [], [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(mass, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.binary()))], ["part", "mass", "packed"])

        for p in range(parts):
            ranges = range(p * _RANGES, (p + 1) * _RANGES)
            if cut[ranges[0]] == cut[ranges[-1] + 1]:
                continue
            row = []
            for r in ranges:
                own = keys[cut[r]:cut[r + 1]]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[:len(own)])
                row.append(pack(own[first].astype(np.uint64) - edges[r], np.diff(first, append=len(own)), width))
            part.append(p)
            mass.append([int(cut[r + 1] - cut[r]) for r in ranges])
            packed.append(row)
            size += sum(map(len, row))
            if size >= _SENT:
                yield batch()
                part, mass, packed, size = [], [], [], 0
        if part:
            yield batch()

    def run(batches):
        numbers, table = Numbers(), np.zeros(0, np.uint64)
        gathered, n = np.empty(1 << 16, kind), 0  # grows to what a task gathers, and is filled in place
        for lang, texts in _by_lang(batches):
            if len(numbers) > _WORDS:
                numbers, table = Numbers(), np.zeros(0, np.uint64)
            seed = _seed(lang)
            for words, own in word_numbers(texts, numbers, longest):
                table = np.append(table, np.asarray(numbers.hashes[len(table):], np.uint64))
                for _, _, x in hashes(words, own, table, seed, longest):
                    if n + len(x) > len(gathered):
                        gathered.resize(max(n + len(x), min(2 * len(gathered), _FLUSH + len(x))), refcheck=False)
                    x >>= np.uint64(64 - bits)
                    gathered[n:n + len(x)] = x
                    n += len(x)
                if n >= _FLUSH:
                    yield from summary(gathered[:n])
                    n = 0
        if n:
            yield from summary(gathered[:n])

    return map_arrow(rows, run, T.StructField("part", T.IntegerType()), T.StructField("mass", T.ArrayType(T.LongType())), T.StructField("packed", T.ArrayType(T.BinaryType())))


def _width(bits: int) -> int:
    """Bits, a multiple of four, that nearly all differences of neighbours fit in, if half of what a task gathers are different keys."""
    mean = (1 << bits) // (_FLUSH // 2)
    return min(max(-(-((8 * mean).bit_length()) // 4) * 4, 8), 32)


def _survivors(summaries: DataFrame, threshold: int, bits: int, parts: int) -> DataFrame:
    """Merge the summaries of each hash partition: ``key`` of all that may reach the threshold. A task holds its partition packed, and
    unpacks a range at a time."""
    width = _width(bits)

    def merged(part, mass, packed):
        edges = _edges(bits, parts)[part * _RANGES:]
        for r in range(_RANGES):
            summary = Summary(sum(int(m[r]) for m in mass) // threshold + 1)
            room = max(4 * summary.capacity, 1 << 16)
            held, n = [], 0
            for p in packed:
                held.append(unpack(p[r], width))
                n += len(held[-1][0])
                if n >= room:
                    summary.merge(held)
                    held, n = [], 0
            summary.merge(held)
            yield summary.keys[summary.counts + summary.lost >= threshold] + edges[r]

    def run(batches):
        now, mass, packed = None, [], []

        def keys():
            found = np.concatenate(list(merged(now, mass, packed)))
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["key"])

        for batch in batches:
            for p, m, x in zip(batch.column("part").to_pylist(), batch.column("mass"), batch.column("packed")):
                if p != now:
                    if packed:
                        yield keys()
                    now, mass, packed = p, [], []
                mass.append(m.values.to_numpy())
                packed.append(x.as_py())
        if packed:
            yield keys()

    dealt = summaries.repartition(parts, "part").sortWithinPartitions("part")
    return map_arrow(dealt, run, T.StructField("key", T.LongType()))


def _sieve(survivors: DataFrame, bits: int) -> np.ndarray:
    """A bitmap over the leading bits of the survivors' keys; the driver gets a word for each 64 of its bits at most."""
    slot = F.shiftright("key", bits - _SIEVE_BITS)
    words = survivors.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("w"))
    got = words.agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(1 << (_SIEVE_BITS - 6), np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


# -- exact counts --------------------------------------------------------------------------------------------------------------------

def _counted(rows: DataFrame, longest: int, sieve: np.ndarray) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and a task's ``count`` of each phrase that passes the sieve; ``words`` 0: all words of the language."""
    held = rows.sparkSession.sparkContext.broadcast(sieve)

    def together(n, parts, seeds, table):
        """Equal phrases once, with their counts. They are told by the numbers of their words; hashes only bring them together."""
        words, at = np.concatenate([w for w, _, _ in parts]), np.concatenate([p for _, p, _ in parts])
        sums = np.concatenate([np.ones(len(w), np.int64) if c is None else c for w, _, c in parts])
        parts.clear()
        h = np.asarray(seeds, np.uint64)[at]
        for i in range(n):
            h += table[words[:, i]] * _ODD[i + 1]
        order = np.argsort(h)
        del h
        words, at = words[order], at[order]
        new = np.ones(len(order), bool)
        new[1:] = (at[1:] != at[:-1]) | (words[1:] != words[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        return words[first], at[first], np.add.reduceat(sums[order], first)

    def counts(n, words, at, sums, langs, numbers):
        names = list(numbers)
        blocks = np.array_split(words, len(words) // 50_000 + 1)  # few words are Python objects at once
        phrases = pa.concat_arrays([pa.array([b" ".join([names[i] for i in row]) for row in x.tolist()], pa.binary()) for x in blocks]).cast(pa.string())
        langs = pa.array(langs, pa.string())
        beside = pc.array_sort_indices(phrases).to_numpy()  # what begins alike stands side by side, and is shuffled in fewer bytes
        for i in range(0, len(beside), _SENT_ROWS):
            some = beside[i:i + _SENT_ROWS]
            yield _rows(langs.take(pa.array(at[some])), phrases.take(pa.array(some)), n, sums[some])

    def run(batches):
        bitmap, table, totals, langs, seeds = held.value, np.zeros(0, np.uint64), {}, {}, []
        numbers, found, size = Frequent(bitmap), {n: [] for n in range(1, longest + 1)}, 0

        def flush():
            for n, parts in found.items():
                if parts:
                    yield from counts(n, *together(n, parts, seeds, table), list(langs), numbers)

        for lang, texts in _by_lang(batches):
            if lang not in langs:
                langs[lang] = len(langs)
                seeds.append(_seed(lang))
            place = langs[lang]
            numbers.seed = seeds[place]
            for words, own in word_numbers(texts, numbers, longest):
                if len(words):
                    totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(words[own:] != _PART))
                table = np.append(table, np.asarray(numbers.hashes[len(table):], np.uint64))
                for n, at in passing(words, own, table, seeds[place], longest, bitmap):
                    if len(at):
                        found[n].append((words[at[:, None] + np.arange(n)], np.full(len(at), place, np.int32), None))
                        size += len(at) * (n + 3) // 4
                if size >= _FLUSH_EXACT:
                    for n, parts in found.items():
                        found[n] = [together(n, parts, seeds, table)] if parts else []
                    size = sum(len(part[0]) * (n + 3) // 4 for n, parts in found.items() for part in parts)
                    if 2 * size > _FLUSH_EXACT:
                        yield from flush()
                        size = 0
            if len(numbers) > _WORDS:
                yield from flush()
                numbers, table, size = Frequent(bitmap), np.zeros(0, np.uint64), 0
        yield from flush()
        if totals:
            yield _rows(pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), 0, list(totals.values()))

    return map_arrow(rows, run, T.StructField("lang", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("count", T.LongType()))


def _rows(lang: pa.Array, phrase: pa.Array, words: int, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(lang), words, np.int32)), pa.array(count, pa.int64())], ["lang", "phrase", "words", "count"])


def frequent_phrases(docs: DataFrame, threshold: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``count`` of each phrase of at most ``longest`` words that a language has ``threshold`` times or
    more, stored; and with ``words`` 0 and no phrase the number of all words of each language."""
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about a key for each phrase of the corpus: two rare ones that share one seldom reach the threshold, and are told apart later
    bits = min(max((longest * size // 6).bit_length(), _SIEVE_BITS), 62)
    parts = max(shuffle_partitions(docs), size // _PART_BYTES)
    survivors = _survivors(_summaries(rows, longest, bits, parts), threshold, bits, parts)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    counted = _counted(rows.coalesce(cores * max(-(-size // (cores * _COUNTED_BYTES)), 1)), longest, _sieve(survivors, bits))
    total = counted.groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count"))
    return stored(total.where((F.col("count") >= threshold) | (F.col("words") == 0)))


def collocations(docs: DataFrame, threshold: int = 30, longest: int = 4, first: int = 2000, scale: int = 2_000_000, inside: int = 80,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of its parts), ``n`` (words of the language) and ``score``.

    Words are what lies between spaces and tabs in a piece, pieces what lies between . , ; : ! ? and line ends, with A-Z in lower case. A
    phrase of 2 to ``longest`` words in one piece is a candidate if its language has it ``threshold`` times. Its score is the least
    scale * a / (l + r), rounded down, over the cuts in two parts; of equal scores the first cut counts. A candidate inside a longer one
    that has at least ``inside`` hundredths of its count is left out. A language's ``first`` phrases by score, count and bytes are returned.

    Tasks summarise the phrases of their texts by hash; the summaries of each hash partition are merged into a Misra-Gries summary whose
    capacity exceeds mass / threshold, so no frequent phrase is lost. The second pass counts, by their words, all phrases whose hash and
    whose parts' hashes fall in survivors' slots of a bitmap of fixed size; what else falls there is counted too and left out by its
    exact count.

    A null text is empty, a null language is ``und``; empty texts have no words; a very long text goes block by block; repeated rows
    count each; an empty table gives no rows; other columns are not read.
    """
    counts = frequent_phrases(docs, threshold, longest, text_col, lang_col)
    phrases = counts.where("words > 0").select("lang", "phrase", "words", F.col("count").alias("a"))
    candidates = phrases.where("words > 1")

    part = F.split("phrase", " ")
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(part, i, m), " "))))
    longer = candidates.where("words > 2").select("lang", F.explode(within).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = stored(candidates.join(longer, ["lang", "phrase"], "left").where(f"most is null or 100 * most < {inside} * a").drop("most"))

    cut = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    l, r = (phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    cut = cut.join(l, ["lang", "left"]).join(r, ["lang", "right"])
    score = F.expr(f"(cast({scale} as decimal(18, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    cut = cut.withColumn("score", score.cast("long"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    best = first_rows(best, first, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], by="phrase")
    totals = counts.where("words = 0").select("lang", F.col("count").alias("n"))  # a row for each language
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
