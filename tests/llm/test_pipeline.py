"""Each stage, and the whole, against versions that hold everything in memory."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from canopyflow.llm.encode import Encoder
from canopyflow.llm.quality import fit, terms

from .test_simhash import components, slow_print
from .test_suffixes import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows that go into each stage, and come out of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, out[-1], SF)
        rows = df.collect()
        out.append(spark.createDataFrame(rows, df.schema))
    return [sorted(d.collect(), key=lambda r: (r.doc_id, r[1])) for d in out]


def test_columns(steps):
    assert all(s[0].__fields__ == steps[0][0].__fields__ for s in steps[1:4])


def test_quality(steps, spark):
    space = fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    x = space.project(np.stack([terms(r.text) for r in steps[0]]))
    votes = []
    for row in x:
        cos = space.vectors @ row
        near = np.argsort(-cos, kind="stable")[:15]
        w = np.maximum(cos[near], 0).astype(float) ** 16
        votes.append((w * space.labels[near]).sum() / w.sum() if w.sum() else space.prior)
    sure = [abs(v - 0.7) > 1e-3 for v in votes]
    kept = {r.doc_id for r in steps[1]}
    assert all((r.doc_id in kept) == (v >= 0.7) for r, v, s in zip(steps[0], votes, sure) if s)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert np.mean([(i in kept) == (q == 1) for i, q in quality.items()]) > 0.98


def test_near_dedup(steps):
    prints = np.asarray([slow_print(r.text) for r in steps[1]], np.uint64)
    links = [(i, j) for i in range(len(prints)) for j in (np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= 3)).tolist()]
    label = components(len(prints), links)
    assert [r.doc_id for r in steps[2]] == [r.doc_id for i, r in enumerate(steps[1]) if label[i] == i]


def test_repeats(steps):
    want = brute([(r.doc_id, r.text) for r in steps[2]])
    assert [r.doc_id for r in steps[3]] == [r.doc_id for r in steps[2]]
    for r, kept in zip(steps[3], want):
        assert r.n_chars == len(r.text)
        assert r.text.encode() == kept or len(r.text.encode()) > len(kept) and len(r.text.encode()) - len(kept) < 6 * (1 + len(kept) // 100)


def test_packing(steps):
    lib = Encoder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    assert [(r.doc_id, r.piece) for r in steps[4] if r.piece == 0] == [(r.doc_id, 0) for r in steps[3]]
    ids = {}
    for r in steps[4]:
        ids[r.doc_id] = ids.get(r.doc_id, b"") + r.ids
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids)
    for r in steps[3][:200]:
        assert ids[r.doc_id] == np.append(lib.tokenizer.encode(r.text, add_special_tokens=False).ids, 2).astype("<u4").tobytes()
    n = len({r.sequence_id for r in steps[4]})
    assert n <= 1.02 * sum(r.length for r in steps[4]) / 1024 + 1


def test_run_gives_the_stages_result(spark, steps):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, rows)) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in steps[4])


def test_columns_of_any_name(spark, docs_of, odd):
    docs = docs_of(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert out.count() > 0 and stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() >= len(odd)
