import math
import random
from collections import Counter

import pytest

from canopyflow.llm import lexical
from canopyflow.llm.lexical import search, terms
from canopyflow.llm.queries import QUERIES, SQL
from checks.compare import compare, duck


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, total = sum(map(bool, sizes)), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, c), n in zip(counted, sizes):
            m = 100 - 50 + 50 * n * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is not None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def made(seed, n=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["été", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda size: rnd.choice([" ", ", ", "\n"]).join(rnd.choices(words, weights, k=rnd.randrange(size)))
    return [(i, text(60)) for i in range(n)], [(i, text(25)) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, "W3 w3 w150"), (93, "w3"), (None, "w5")]


@pytest.mark.parametrize("k, postings, query_bytes", [(50, 4_000_000, 8 << 20), (3, 500, 300), (1, 50, 8 << 20)])
def test_as_brute_force(spark, docs_of, odd, monkeypatch, k, postings, query_bytes):
    monkeypatch.setattr(lexical, "_POSTINGS", postings)
    monkeypatch.setattr(lexical, "_QUERY_BYTES", query_bytes)
    docs, items = made(k)
    docs = docs + odd + [(500 + i, "w3 w150 w7") for i in range(60)]  # ties
    queries = spark.createDataFrame([(*x, "a", 1) for x in items], "item_id long, text string, rank string, score int")
    got = search(docs_of(docs, 4), queries, k=k)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def test_empty_tables(spark, docs_of):
    docs, queries = docs_of([(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, q in ((docs.limit(0), queries), (docs, queries.limit(0)), (docs_of([(1, None)]), queries), (docs, queries.where("item_id = 2"))):
        got = search(d, q)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_accumulators_are_limited(monkeypatch):
    """With one rare term and a frequent one, documents with the frequent one alone get none."""
    import numpy as np
    import pyarrow as pa
    n = 1000
    doc = np.concatenate([np.arange(10), np.arange(n)])
    block = lexical.Block(pa.array(np.arange(n)), np.full(n, 5), doc, np.repeat([0, 1], [10, n]), np.ones(len(doc), int), n, 5 * n)
    seen = []
    real = np.flatnonzero
    monkeypatch.setattr(lexical.np, "flatnonzero", lambda x: seen.append(len(real(x))) or real(x))
    at, score = block.search([0, 1], np.asarray([5000, 1]), 5, 0)
    assert at.tolist() == [0, 1, 2, 3, 4] and seen == [10] and len(set(score.tolist())) == 1


def test_registered_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, duck(sf), QUERIES["op12_ranked_search"], SQL["op12_ranked_search"], sf)[0] == "ok"
