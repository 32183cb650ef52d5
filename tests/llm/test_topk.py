import math

import numpy as np
import pytest

from canopyflow.llm import topk
from canopyflow.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, v string, low string, rank string"


def brute(rows, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        v = min(v for i, v in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("block, bins, scale", [(1024, 1024, 1), (16, 8, 1), (16, 1024, 1000)])
def test_exact_with_ties(spark, monkeypatch, block, bins, scale):
    monkeypatch.setattr(topk, "_BLOCK", block)
    monkeypatch.setattr(topk, "_BINS", bins)
    rnd = np.random.default_rng(2)
    rows = [(i, (rnd.integers(-3, 4, 8) * scale / 3).tolist()) for i in range(260)] + [(300 + i, rows_i) for i, rows_i in enumerate([[1.0 * scale] * 8] * 12)]
    monkeypatch.setattr(topk, "_SENT", 200 if bins == 8 else 32 << 20)  # some queries at a time
    rows += [(1000 + i, rnd.integers(-3, 4, 5).astype(float).tolist()) for i in range(120)]  # another dimension
    rows += [(350, None), (400, [float("nan")] * 8), (401, [float("inf")] * 8), (402, [None] * 8), (403, []), (None, [9.0] * 8), (50, [0.5] * 8), (7, [1.0] * 8), (450, [-0.001] * 8)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df).collect())) == brute([(0, [1.0]), (50, [2.0]), (3, [-1.0])])
    assert top_k(df.limit(0)).count() == 0 and top_k(df.where("vec_id = 0")).count() == 0
