import io
import struct

import numpy as np
import public_tokenizers
import sentencepiece

from canopyflow.llm import sp_backend
from canopyflow.llm.sp_backend import BYTE, CONTROL, NORMAL, UNKNOWN, build, decode, encode, parse_model

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_and_round_trip(docs_of, odd):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = encode(docs_of(odd), MODEL).collect()
    assert all(r.rebuilt and r.round_trip for r in rows)
    assert sorted(r.ids for r in rows) == sorted(np.asarray(lib.encode(t or ""), "<u4").tobytes() for _, t in odd)
    assert encode(docs_of([]), MODEL).count() == 0


def test_threads_give_the_same(docs_of, odd):
    rows = [encode(docs_of(odd), MODEL, threads=t).select("ids").collect() for t in (1, 3)]
    assert sorted(r.ids for r in rows[0]) == sorted(r.ids for r in rows[1])


def test_decode(docs_of, odd):
    coded = encode(docs_of(odd), MODEL)
    assert sorted(r.text for r in decode(coded, MODEL).collect()) == sorted(t or "" for _, t in odd)
    assert [r.text for r in decode(coded.limit(1).selectExpr("doc_id", "cast(null as binary) as ids", "'old' as text"), MODEL).collect()] == [None]


def test_decoding_any_ids():
    backend, rnd = sp_backend.Backend(MODEL), np.random.default_rng(1)
    ids = [rnd.integers(0, 32_000 if i % 2 else 400, rnd.integers(0, 30)) for i in range(400)] + [np.asarray([5, 99_999, 300])]
    assert backend.decode(ids) == backend.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def test_hard_texts():
    backend, lib = sp_backend.Backend(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", " ", "  a", "a  b", "\n\n", "<s> </s> <unk> <0x0A>", "\x00é😀", "▁x ▁", "trail ", "x" * 400, "l'été naïve\tüber", "aaa aaaa aaaaa"]
    assert [x.tolist() for x in backend.encode(texts)] == [lib.encode(t) for t in texts]


def _number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _bytes(field, value):
    return _number(field * 8 + 2) + _number(len(value)) + value


def test_a_unigram_model(tmp_path):
    pieces = [("<unk>", 0, UNKNOWN), ("<s>", 0, CONTROL), ("</s>", 0, CONTROL)] + [(f"<0x{b:02X}>", 0, BYTE) for b in range(256)]
    pieces += [("▁", -3, NORMAL), ("▁hello", -4, NORMAL), ("▁he", -5, NORMAL), ("l", -6, NORMAL), ("lo", -5.5, NORMAL), ("o", -6.5, NORMAL), ("▁wor", -5.2, NORMAL), ("ld", -5.1, NORMAL), ("w", -7, NORMAL), ("d", -7.1, NORMAL), ("e", -6.2, NORMAL), ("h", -6.6, NORMAL), ("r", -6.7, NORMAL)]
    raw = b"".join(_bytes(1, _bytes(1, p.encode()) + _number(2 * 8 + 5) + struct.pack("<f", s) + _number(3 * 8) + _number(k)) for p, s, k in pieces)
    raw += _bytes(2, _number(3 * 8) + _number(1) + _number(4 * 8) + _number(len(pieces)) + _number(35 * 8) + _number(1))
    raw += _bytes(3, _bytes(1, b"identity") + _number(3 * 8) + _number(1) + _number(4 * 8) + _number(1) + _number(5 * 8) + _number(1))
    model = parse_model(raw)
    lib, ours = sentencepiece.SentencePieceProcessor(model_proto=raw), build(model)
    assert model.type == sp_backend.UNIGRAM and model.byte_fallback and model.remove_extra_spaces
    for t in ("hello world", "  hello   wor ", "hold low", "é hello", "held o r"):
        assert ours.encode(t, add_special_tokens=False).ids == lib.encode(t), t
        assert ours.decode(lib.encode(t), skip_special_tokens=False) == lib.decode(lib.encode(t)), t
    assert io.BytesIO(raw).read() == raw
