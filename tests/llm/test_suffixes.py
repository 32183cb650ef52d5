import hashlib
import random

import numpy as np
import pytest
import xxhash

from canopyflow.llm import suffix_dedup
from canopyflow.llm.suffix_dedup import cut_repeats, sort_suffixes


def brute(rows, length=100):
    """What is kept of each row, in order."""
    seen, out = set(), []
    for _, text in rows:
        b = (text or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                covered[i:i + length] = b"\1" * length
            seen.add(b[i:i + length])
        out.append(bytes(x for x, c in zip(b, covered) if not c))
    return out


def texts(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rnd.choice([18, 25, 30, 60, 200]))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    return rows + [(n, "a" * 400), (n + 1, "ab" * 300), (n + 2, None), (n + 3, ""), (n + 4, "x" * 99), (n + 5, rows[3][1]), (n + 6, rows[3][1][1:])]


def got(df):
    return sorted(repr((r.doc_id, hashlib.sha256(r.kept).hexdigest(), r.n_bytes)) for r in df.collect())


def want(rows):
    return sorted(repr((r[0], hashlib.sha256(k).hexdigest(), len((r[1] or "").encode()))) for r, k in zip(rows, brute(rows)))


@pytest.mark.parametrize("crowd, flush, sample, frequent", [(256, 1 << 21, 64, 32), (1, 2000, 64, 32), (3, 500, 64, 32), (256, 2000, 1, 0), (4, 1 << 21, 2, 1)])
def test_kept_bytes(docs_of, monkeypatch, crowd, flush, sample, frequent):
    monkeypatch.setattr(suffix_dedup, "_SAMPLE", sample)
    monkeypatch.setattr(suffix_dedup, "_FREQUENT", frequent)  # 0: every anchor's windows travel alone
    monkeypatch.setattr(suffix_dedup, "_CROWD", crowd)  # 1: all windows one by one
    monkeypatch.setattr(suffix_dedup, "_FLUSH", flush)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 300 if flush < 1000 else 1 << 22)
    rows = texts(crowd)
    df = cut_repeats(docs_of(rows))
    assert got(df) == want(rows)
    assert any(r.spans for r in df.collect())


def test_repeated_and_missing_ids(docs_of):
    rows = [(None, t) for _, t in texts(5, 8)] + [(7, t) for _, t in texts(5, 8)] + texts(5, 8)
    place = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + 2**63) % 2**64  # noqa: E731  in the order of signed numbers
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, place(r[1])))
    frame = cut_repeats(docs_of(rows), keep=("lang", "id", "keep_lang"))
    assert got(frame) == want(order) and {r.id for r in frame.collect()} == {"x"}


def test_whole_characters(docs_of):
    rows = [(0, "é" * 80 + "abc"), (1, "x" + "é" * 80), (2, "日本" * 40), (3, "本日" * 40)]
    for r in cut_repeats(docs_of(rows), whole_characters=True).collect():
        r.kept.decode("utf-8")


def test_other_lengths_and_empty(docs_of):
    rows = texts(8, 20)
    df = cut_repeats(docs_of(rows), length=37)
    assert sorted(hashlib.sha256(r.kept).hexdigest() for r in df.collect()) == sorted(hashlib.sha256(k).hexdigest() for k in brute(rows, 37))
    assert cut_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("depth", [40, 64, 100])
def test_sorting(depth):
    rnd = np.random.default_rng(depth)
    stem = rnd.integers(97, 99, 300)
    x = np.concatenate([stem, rnd.integers(97, 99, 200), stem, stem[5:200], np.zeros(200, np.int64) + 97, stem]).astype(np.uint8)
    x[rnd.integers(0, len(x), 12)] = 250
    suffixes = np.arange(len(x) - depth)
    group = np.where(suffixes % 7 == 0, 1, 0)
    first = {}
    want = [first.setdefault((group[i], x[s:s + depth].tobytes()), i) for i, s in enumerate(suffixes)]
    assert sort_suffixes(x, suffixes, group, depth).tolist() == want
