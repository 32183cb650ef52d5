import random
import re

import numpy as np
import pytest

from canopyflow.llm import simhash
from canopyflow.llm.components import connected_components
from canopyflow.llm.simhash import Trees, fingerprint, near_duplicates


def slow_print(text):
    import xxhash
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint(spark):
    texts = ["", "a", "A b", "one Two three four", "É é x\x1cy z\x0bq", "w " * 100, "1 2 3 4 5 6 7 8 9"]
    assert [fingerprint(t) % (1 << 64) for t in texts] == [slow_print(t) for t in texts]
    assert fingerprint(None) == 0
    one = spark.sql("SELECT xxhash64('one two three')").first()[0]
    assert fingerprint("one two THREE") == one


def test_trees_find_all_within_the_radius(monkeypatch):
    monkeypatch.setattr(simhash, "_FRONTIER", 500)
    rnd = np.random.default_rng(3)
    base = rnd.integers(-2**63, 2**63, 40)
    prints = np.unique(np.concatenate([base, *(base ^ (1 << int(rnd.integers(0, 63))) for _ in range(6)), base ^ 7]))
    shard = np.sort(rnd.integers(0, 4, len(prints)))
    trees = Trees(prints, shard)
    roots = np.asarray([trees.root_of[s] for s in shard.tolist()])
    q, node = trees.search(prints, roots, 3)
    want = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if shard[i] == shard[j] and bin((int(prints[i]) ^ int(prints[j])) % 2**64).count("1") <= 3}
    assert set(zip(q.tolist(), node.tolist())) == want and len(q) == len(want)


@pytest.mark.parametrize("shard", [512, 4])
def test_near_duplicates(docs_of, monkeypatch, shard):
    monkeypatch.setattr(simhash, "_SHARD", shard)
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 99)) for _ in range(300)) for _ in range(5)]
    rows = [(i, None if i == 7 else "" if i % 50 == 9 else " ".join("new" if rnd.random() < 0.01 else w for w in base[i % 5].split())) for i in range(120)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, "alone")]
    got = near_duplicates(docs_of(rows)).collect()
    prints = np.asarray([slow_print(t) for _, t in rows], np.uint64)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]) <= 3]
    label = components(len(rows), links)
    smallest = {c: min((r[0] for r, x in zip(rows, label) if x == c and r[0] is not None), default=None) for c in label}
    want = sorted(repr((r[0], f"{p:016x}", smallest[c])) for r, p, c in zip(rows, prints.tolist(), label))
    assert sorted(repr(tuple(r)) for r in got) == want and 5 < len(set(label)) < 110


def test_empty(docs_of):
    assert near_duplicates(docs_of([])).count() == 0


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(rnd.randint(2000, 2300), rnd.randint(2000, 2300)) for _ in range(250)] + [(5000, 5000)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    names = sorted({x for a, b in links for x in (a, b) if a != b})
    at = {x: i for i, x in enumerate(names)}
    want = components(len(names), [(at[a], at[b]) for a, b in links if a != b])
    assert got == {x: names[c] for x, c in zip(names, want)}
