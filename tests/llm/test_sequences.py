import zlib

import numpy as np
from pyspark.sql import types as T

from canopyflow.llm.encode import Encoder
from canopyflow.llm.sequences import open_stream, read_documents, read_sequences, sequence, write_sequences


def test_round_trip(spark, docs_of, odd, bpe, tmp_path):
    folder = str(tmp_path / "out")
    manifest = write_sequences(docs_of(odd), folder, bpe, end_id=0, length=16, partitions=3).collect()
    lib = Encoder(bpe)
    got = sorted(read_documents(spark, folder, T.LongType()).collect(), key=lambda r: r.start)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [r.doc_id for r in got] == [i for i, _ in sorted(odd, key=key)]
    ids = {t: np.append(lib.tokenizer.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4").tobytes() for _, t in odd}
    assert sorted(zlib.crc32(r.ids) for r in got) == sorted(zlib.crc32(ids[t]) for _, t in odd)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    flat = b"".join(r.ids for r in got)
    seqs = sorted(read_sequences(spark, folder).collect(), key=lambda r: (r.shard, r.sequence))
    assert [i for r in seqs for i, m in zip(r.ids, r.mask) if m] == np.frombuffer(flat, "<u4").tolist()
    assert len(seqs) == sum(r.n_sequences for r in manifest) and sum(r.n_docs for r in manifest) == len(odd)


def test_access_is_zero_copy(docs_of, bpe, tmp_path):
    folder = str(tmp_path / "out")
    row = write_sequences(docs_of([(i, "some words " * 50) for i in range(200)]), folder, bpe, length=8, partitions=1).first()
    table = open_stream(f"{folder}/{row.ids_file}")
    ids, mask = sequence(table, row.n_sequences - 1)
    again, _ = sequence(table, row.n_sequences - 1)
    assert ids.__array_interface__["data"][0] == again.__array_interface__["data"][0] and not ids.flags.owndata
    assert [len(c) for c in table.column("ids").chunks[:-1]] == [256] * (table.num_rows // 256) and len(ids) == 8
    flat = np.concatenate([sequence(table, i)[0] for i in range(row.n_sequences)])
    one = [*Encoder(bpe).encode(["some words " * 50])[0].tolist(), 0]
    assert flat[:2 * len(one)].tolist() == one * 2
    assert mask.sum() == row.n_tokens - 8 * (row.n_sequences - 1)


def test_empty(spark, docs_of, bpe, tmp_path):
    assert write_sequences(docs_of([]), str(tmp_path / "out"), bpe).count() == 0
    assert read_documents(spark, str(tmp_path / "out"), T.LongType()).count() == 0
