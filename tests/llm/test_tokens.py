import random

import numpy as np
import public_tokenizers
import pytest

from canopyflow.llm.encode import Encoder
from canopyflow.llm.token_counts import token_counts

PARTS = ["a", "bc", " ", "  ", "\n", "'s", "'", "1", "é", "<|endoftext|>", "!", "\t", " ", "日", "<|endof", ".", ".\n", "Straße", "\x1c", "\r\n"]


def plain(lib, text):
    return np.asarray(lib.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("memo", [3, 100_000])
def test_segments_give_the_librarys_ids(bpe, memo):
    lib = Encoder(bpe, memo_words=memo)
    for i, batch in enumerate(np.array_split(random_texts(1500, 1), 30)):
        texts = [str(t) for t in batch] + [None]
        assert [x.tobytes() for x in lib.encode(texts)] == [plain(lib, t or "") for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_are_spliced_exactly(name):
    lib = Encoder(public_tokenizers.path(name))
    widened = 0
    for t in random_texts(400, 2) + ["a" * 300 + " b", "\n" * 200]:
        if name.startswith("word") and "<|endof" in t:
            continue
        ids, _, w = lib.encode_long(t, 40, 18)
        widened += w
        assert ids.tobytes() == plain(lib, t)
    assert widened


def test_counts(docs_of, odd, bpe):
    rows = token_counts(docs_of(odd), bpe, limit=3, chunk_chars=4000).collect()
    lib = Encoder(bpe)
    want = sorted((str(i), len((t or "").encode()), len(plain(lib, t or "")) // 4) for i, t in odd)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in rows) and max(r.n_chunks for r in rows) > 10
    assert token_counts(docs_of([]), bpe).count() == 0


def test_counts_of_a_sentencepiece_model(docs_of, odd):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts(docs_of(odd), path).collect())
    assert got == sorted((len((t or "").encode()), len(lib.encode(t or ""))) for _, t in odd)
