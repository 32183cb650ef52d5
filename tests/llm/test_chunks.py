import hashlib
import random

import pytest

from canopyflow.llm import chunk_dedup
from canopyflow.llm.chunk_dedup import chunks, exact_copies, normalised
from canopyflow.llm.queries import QUERIES, SQL
from checks.compare import compare, duck

SMALLEST = float("-inf")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normalised(t), []).append(i)
    out = []
    for text, ids in groups.items():
        top = max(ids, key=lambda i: SMALLEST if i is None else i)
        sha = hashlib.sha256(text).hexdigest()
        one = ids.index(top)
        out += [(i, top, len(ids), n == one, sha) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [1, 16])
def test_as_whole_texts(spark, docs_of, odd, monkeypatch, digest):
    monkeypatch.setattr(chunk_dedup, "_DIGEST", digest)  # one byte: many chunks share it, so it has to grow
    rnd = random.Random(1)
    word = lambda: rnd.choice(["Alpha", "beta", "É", "日本", "x" * 50, "\n"])
    base = [" ".join(word() for _ in range(rnd.randrange(2000))) for _ in range(60)]
    rows = odd + [(100 + i, t) for i, t in enumerate(base)] + [(1000 + i, rnd.choice(base).swapcase() if i % 3 else rnd.choice(base)) for i in range(120)]
    rows += [(2000 + i, base[0] + c) for i, c in enumerate("abA")] + [(3000 + i, "a" * 100_000) for i in range(3)]
    got = sorted(map(tuple, exact_copies(docs_of(rows, 5)).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(docs_of):
    assert exact_copies(docs_of([(1, "a")]).limit(0)).count() == 0


def test_chunks_join_to_the_text_and_move_with_it():
    rnd = random.Random(2)
    for n in (0, 1, 256, 257, 5000, 3_000_000):
        data = rnd.randbytes(n)
        parts = list(chunks(data))
        assert b"".join(parts) == data and all(256 <= len(c) <= 8192 for c in parts[:-1]) and all(len(c) <= 8192 for c in parts)
    moved = list(chunks(b"some words before" + data))
    assert len(set(moved) & set(parts)) > 0.99 * len(parts)  # a cut depends on the bytes around it only
    assert max(map(len, chunks(b"a" * 50_000))) == 8192


def test_registered_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), QUERIES["op13_exact_dedup"], SQL["op13_exact_dedup"], sf)[0] == "ok"
