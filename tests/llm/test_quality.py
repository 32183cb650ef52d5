import zlib

import numpy as np
from pyspark.sql import functions as F

from canopyflow.llm.quality import fit, score, terms


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), fit(docs, labels, bound=2000)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 800 and np.mean([r.predicted == r.quality for r in held]) > 0.98


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, "Plain words here. " * 9 if i % 2 else "JUNK!! $$$ " * 9) for i in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit(docs, labels), fit(docs, flipped)
    assert np.array_equal(a.labels, b.labels) and np.array_equal(a.vectors, b.vectors) and len(a.labels) < 80
    assert all(r.predicted == r.doc_id % 2 for r in score(docs, a).collect())


def test_odd_rows(docs_of, odd, spark):
    docs = docs_of(odd)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 1), (4, 1), (6, 0), (99, 1)], "doc_id long, quality int")
    rows = score(docs, fit(docs, labels), keep=("lang", "text", "id", "score")).collect()
    assert sorted(str((r[0], r.text)) for r in rows) == sorted(str(x) for x in odd) and all(0 <= r[2] <= 1 for r in rows)
    empty = score(docs, fit(docs, labels.limit(0)))
    assert {r.score for r in empty.collect()} == {0.5}
    assert score(docs.limit(0), fit(docs, labels)).count() == 0


def test_votes_are_exact():
    rnd = np.random.default_rng(1)
    from canopyflow.llm.quality import Space
    v = rnd.standard_normal((50, 6)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    space = Space(np.ones(1), np.zeros((1, 1)), v, (rnd.random(50) > 0.5).astype(float))
    x = v[:7] + 0.01
    for got, q in zip(space.vote(x, 9, 4.0), x):
        near = np.argsort(-(v @ q))[:9]
        w = np.maximum(v[near] @ q, 0) ** 4
        assert abs(got - (w * space.labels[near]).sum() / w.sum()) < 1e-5
    assert terms("").sum() == 0


def test_equal_texts_have_equal_scores_wherever_they_stand():
    """Whatever stands beside a text, and of equally near labelled texts those with the smallest ids vote."""
    from canopyflow.llm.quality import Space, unit
    rnd = np.random.default_rng(2)
    counts = np.stack([terms(" ".join(rnd.choice(["Alpha", "beta,", "GAMMA!", "12", "delta"], 40))) for _ in range(700)])
    basis = rnd.standard_normal((counts.shape[1], 16)).astype(np.float32)
    vectors = unit(counts[:90] @ basis)
    vectors[30:60] = vectors[5]  # thirty-one that are equally near
    labels = np.zeros(90)
    labels[[5, *range(30, 38)]] = 1
    space = Space(np.ones(counts.shape[1]), basis, vectors, labels)
    alone = np.concatenate([space.vote(space.project(counts[i:i + 1]), 9, 16.0) for i in range(0, 700, 7)])
    together = space.vote(space.project(counts), 9, 16.0)[::7]
    assert np.array_equal(alone, together)
    assert space.vote(vectors[5:6], 9, 16.0)[0] == 1.0


def test_words_are_among_the_terms():
    a, b = terms("the red house"), terms("the big horse")
    shapes = a[:2048], b[:2048]
    assert np.array_equal(*shapes) and not np.array_equal(a, b) and np.array_equal(a[2048:], terms("The  RED\nhouse")[2048:]) and a[2048:].sum() == 3
