import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from canopyflow.llm import common, phrases
from canopyflow.llm.phrases import Summary, collocations, pack, unpack
from canopyflow.llm.queries import QUERIES, SQL
from checks.compare import compare, duck

KINDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, threshold, first, longest=4):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= threshold and len(p) > 1}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, b" ".join(p), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def made(seed):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "été", "日本", "x\x00y", "\x1c", "w1", "w2", "w3"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "! "]) for _ in range(n))
    return [(rnd.choice(["en", "de", None, "und"]), text(rnd.randrange(80))) for _ in range(150)] + [("en", None), (None, ""), ("fr", "one two")] + [("en", "same row same row")] * 9


@pytest.mark.parametrize("threshold, first, flush, block", [(5, 2000, 6_000_000, 1 << 20), (3, 20, 500, 64), (30, 2000, 2000, 7)])
def test_as_brute_force(spark, docs_of, monkeypatch, threshold, first, flush, block):
    for name in ("_FLUSH", "_FLUSH_EXACT"):
        monkeypatch.setattr(phrases, name, flush)
    monkeypatch.setattr(phrases, "_WORDS", 7 if block == 7 else 1_000_000)
    monkeypatch.setattr(phrases, "word_blocks", lambda data: common.word_blocks(data, block))
    rows = made(threshold)
    docs = spark.createDataFrame([(i, lang, t, "a", "b", 1, 2) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, words string, count long, a long").repartition(3)
    got = collocations(docs, threshold=threshold, first=first)
    assert got.columns == KINDS and sorted(map(tuple, got.collect())) == brute(rows, threshold, first)


def test_empty_and_none(spark, docs_of):
    for docs in (docs_of([(1, "a b")]).limit(0), docs_of([(1, None), (2, " ")]), docs_of([(1, "a b c")])):
        assert collocations(docs).count() == 0


@pytest.mark.parametrize("width", [8, 12, 16, 20, 32])
def test_pack_and_unpack(width):
    rnd = np.random.default_rng(1)
    for keys in (np.zeros(0, np.uint64), np.asarray([0], np.uint64), np.asarray([65535, 65536, 2**20, 2**20 + 1], np.uint64), np.unique(rnd.integers(0, 2**33, 5000).astype(np.uint64))):
        counts = rnd.choice([1, 2, 14, 15, 16, 10**12], len(keys))
        got = unpack(pack(keys, counts, width), width)
        assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts.tolist()


def test_summaries_keep_every_frequent_key():
    rnd = np.random.default_rng(3)
    for seed in range(20):
        keys = np.concatenate([rnd.integers(0, 5000, 20_000), np.repeat(rnd.integers(0, 5000, 30), 30)]).astype(np.uint64)
        rnd.shuffle(keys)
        true = Counter(keys.tolist())
        summary = Summary(len(keys) // 30 + 1)
        for part in np.array_split(keys, 40):
            k, c = np.unique(part, return_counts=True)
            summary.merge([(k, c)])
            assert len(summary.keys) <= summary.capacity
        held = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        assert summary.lost < 30 and all(c in held.values() or held[k] <= c <= held[k] + summary.lost for k, c in true.items() if c >= 30)
        assert all(k in held for k, c in true.items() if c >= 30)


def test_registered_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), QUERIES["op11_collocations"], SQL["op11_collocations"], sf)[0] == "ok"


def test_memory_of_a_task(monkeypatch):
    """Beside the keys themselves, what a task makes of them is small; three million phrases took 74 MB."""
    import tracemalloc

    import pyarrow as pa
    monkeypatch.setattr(phrases, "map_arrow", lambda rows, run, *fields: run)
    monkeypatch.setattr(phrases, "_FLUSH", 3_000_000)
    run = phrases._summaries(None, 4, 30, 8)
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(1000)}" for _ in range(5000)) for _ in range(160)]
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"], "text": [t]}) for t in texts]
    tracemalloc.start()
    mass = sum(sum(map(sum, b.column("mass").to_pylist())) for b in run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert mass == 160 * (4 * 5000 - 6) and peak < 45e6  # 13 MB of keys


def test_task_counts_equal_phrases_together(monkeypatch):
    """A task sends a phrase once, not once for each time it has gathered its fill."""
    import pyarrow as pa
    monkeypatch.setattr(phrases, "map_arrow", lambda rows, run, *fields: run)
    monkeypatch.setattr(phrases, "_FLUSH_EXACT", 5_000)

    sieve = np.full(1 << (phrases._SIEVE_BITS - 6), np.iinfo(np.uint64).max, np.uint64)  # lets every phrase through
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    run = phrases._counted(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)), 4, sieve)
    rnd = random.Random(5)
    rows = [("en" if i % 2 else "de", " ".join(rnd.choice("abcd") for _ in range(400))) for i in range(40)]
    got = [r for b in run(iter([pa.RecordBatch.from_pydict({"lang": [lang], "text": [t]}) for lang, t in rows])) for r in b.to_pylist()]
    want = Counter()
    for lang, t in rows:
        w = t.split(" ")
        want.update((lang, " ".join(w[i:i + k]), k) for k in range(1, 5) for i in range(len(w) - k + 1))
        want[lang, None, 0] += len(w)
    assert {(r["lang"], r["phrase"], r["words"]): r["count"] for r in got} == want and len(got) == len(want)


def counting(monkeypatch, text, longest=4):
    """A task of the second pass without Spark, whose sieve lets the phrases of an English text through, and nearly nothing else."""
    monkeypatch.setattr(phrases, "map_arrow", lambda rows, run, *fields: run)
    sieve, numbers = np.zeros(1 << (phrases._SIEVE_BITS - 6), np.uint64), phrases.Numbers()
    for words, own in phrases.word_numbers([text.encode()], numbers, longest):
        for _, _, x in phrases.hashes(words, own, np.asarray(numbers.hashes, np.uint64), phrases._seed("en"), longest):
            slot = x >> np.uint64(64 - phrases._SIEVE_BITS)
            np.bitwise_or.at(sieve, slot >> np.uint64(6), np.uint64(1) << (slot & np.uint64(63)))
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    return phrases._counted(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)), longest, sieve)


def test_memory_of_a_counting_task(monkeypatch):
    """Words that are rare everywhere, most of a text's different ones, are not held; these 400,000 took 99 MB."""
    import tracemalloc

    import pyarrow as pa
    run = counting(monkeypatch, " ".join(f"w{i}" for i in range(1000)), 1)
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(f"w{j % 1000} rare{i * 2000 + j}" for j in range(2000))]}) for i in range(200)]
    tracemalloc.start()
    got = {r["phrase"]: r["count"] for b in run(iter(batches)) for r in b.to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[None] == 800_000 and all(got[f"w{i}"] == 400 for i in range(1000)) and peak < 40e6


def test_only_phrases_whose_parts_may_be_frequent_are_sent(monkeypatch):
    import pyarrow as pa
    run = counting(monkeypatch, "a b, b c, d")
    monkeypatch.setattr(phrases, "_SENT_ROWS", 2, raising=False)
    rows = {"lang": ["de", "en", "en"], "text": ["a b c", "a b c d e. a b", "e a"]}
    batches = list(run(iter([pa.RecordBatch.from_pydict(rows)])))
    sent = sorted((r["phrase"], r["count"]) for b in batches for r in b.to_pylist() if r["words"])
    assert sent == [("a", 3), ("a b", 2), ("b", 2), ("b c", 1), ("c", 1), ("d", 1)] and all(b.num_rows <= 2 for b in batches)
    # hashes of "x y z" alone, not of its words: let through, and yet not frequent
    sieve = np.zeros(1 << (phrases._SIEVE_BITS - 6), np.uint64)
    numbers = phrases.Numbers()
    for words, own in phrases.word_numbers([b"x y z"], numbers, 4):
        for n, _, x in phrases.hashes(words, own, np.asarray(numbers.hashes, np.uint64), phrases._seed("en"), 4):
            if n == 3:
                slot = int(x[0]) >> 64 - phrases._SIEVE_BITS
                sieve[slot >> 6] |= np.uint64(1 << (slot & 63))
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    run = phrases._counted(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)), 4, sieve)
    got = [r for b in run(iter([pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["x y z"]})])) for r in b.to_pylist()]
    assert got == [{"lang": "en", "phrase": None, "words": 0, "count": 3}]


def test_words_rare_in_one_language_and_frequent_in_another(spark):
    rows = [("de", "only there"), ("en", "here only, there")] * 5 + [("en", "only here only")] * 40 + [("de", "here there Here")] * 40 + [("fr", "only there")] * 29
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = sorted(map(tuple, collocations(docs).collect()))
    assert got == brute(rows, 30, 2000) and {r[0] for r in got} == {"en", "de"}
