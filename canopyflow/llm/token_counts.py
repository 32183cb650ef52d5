"""Token counts of whole texts; very long ones by overlap resynchronisation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from canopyflow.llm.common import field, map_arrow, text_slices
from canopyflow.llm.encode import Encoder, encoder


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 chunk_chars: int = 32_768, overlap_chars: int = 256) -> DataFrame:
    """Bytes and tokens of each document, without added special tokens.

    ``tokenizer`` is a tokenizers ``.json`` or a sentencepiece ``.model`` file that every executor can open. A ``.json`` text of more
    than ``chunk_chars`` characters is encoded in overlapping chunks with offsets, spliced where both chunks begin a word; overlaps
    without such a place are doubled (``n_chunks``, ``n_widened``). One row per input row, in any order: equal rows give equal
    rows, a null or empty text has 0 bytes and 0 tokens, a null id stays null, other columns are not read; an
    empty table gives none. No shuffle.
    """
    def run(batches):
        counter = _pieces(tokenizer) if tokenizer.endswith(".model") else _by_chunks(encoder(tokenizer), chunk_chars, overlap_chars)
        for part in text_slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            n_bytes = [len(t.encode()) for t in texts]
            tokens, chunks, widened = counter(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens]),
                 pa.array(chunks, pa.int32()), pa.array(widened, pa.int32())],
                ["id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = map_arrow(rows, run, field(rows, "id"), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                    T.StructField("over_limit", T.BooleanType()), T.StructField("n_chunks", T.IntegerType()),
                    T.StructField("n_widened", T.IntegerType()))
    return out.withColumnRenamed("id", id_col)


def _by_chunks(lib: Encoder, chunk_chars: int, overlap_chars: int):
    def count(texts):
        short = [t if len(t) <= chunk_chars else None for t in texts]
        tokens, chunks, widened = [len(x) for x in lib.encode(short)], [1] * len(texts), [0] * len(texts)
        for i, t in enumerate(texts):
            if short[i] is None:
                ids, chunks[i], widened[i] = lib.encode_long(t, chunk_chars, overlap_chars)
                tokens[i] = len(ids)
        return tokens, chunks, widened
    return count


def _pieces(path: str):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(texts):
        return [len(x) for x in model.encode(texts, num_threads=1)], [1] * len(texts), [0] * len(texts)
    return count
