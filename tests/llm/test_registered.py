"""The digests that registered queries derive, against plain versions over whole small tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from canopyflow.llm.queries import QUERIES

from .test_suffixes import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in sorted(rows, key=lambda r: r["doc_id"])}


@pytest.fixture(scope="module")
def ids(texts):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def crc(x) -> int:
    return zlib.crc32(np.asarray(x, "<u4").tobytes())


def rows_of(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_token_counts(spark, texts, ids):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows_of(spark, "op1_token_counts")}
    assert got == {(i, len(texts[i].encode()), len(x), len(x) > 512) for i, x in ids.items()}


def test_arrow_sequences(spark, ids):
    want, start = set(), 0
    for i, x in ids.items():
        want.add((i, start, len(x) + 1, crc([*x, 0])))
        start += len(x) + 1
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, "op3_arrow_sequences")} == want


def test_sentencepiece(spark, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = rows_of(spark, "op6_sentencepiece")
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows} == {(i, len(x), crc(x)) for i, t in texts.items() for x in [lib.encode(t)]}
    assert all(r.rebuilt and r.round_trip for r in rows)  # so the ids are the rebuilt tokenizer's


def test_suffix_array_dedup(spark, texts):
    rows = sorted(rows_of(spark, "op8_suffix_array_dedup"), key=lambda r: r.doc_id)
    for r, kept in zip(rows, brute(list(texts.items())), strict=True):
        assert (r.kept_sha256, r.n_bytes, r.n_removed) == (hashlib.sha256(kept).hexdigest(), len(texts[r.doc_id].encode()), r.n_bytes - len(kept))
        assert (r.n_spans > 0) == (r.n_removed > 0)


def test_best_fit_packing(spark, ids):
    rows = rows_of(spark, "op10_best_fit_packing")
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, x in ids.items():
        whole, at = [*x, 2], 0
        for n, r in enumerate(sorted(pieces.pop(i), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and 0 < r.length <= 1024 and r.ids_crc32 == crc(whole[at:at + r.length])
            assert len(whole) > 1024 or r.length == len(whole)
            at += r.length
        assert at == len(whole)
    assert not pieces
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in placed.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(placed) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_simhash_and_classifier_columns(spark, texts):
    near = rows_of(spark, "op4_simhash_near_dedup")
    assert sorted(r.doc_id for r in near) == list(texts) and all(len(r.fingerprint) == 16 and r.component_id <= r.doc_id for r in near)
    scored = rows_of(spark, "op5_quality_classifier")
    assert sorted(r.doc_id for r in scored) == list(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
