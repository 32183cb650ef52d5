"""SentencePiece models on the tokenizers library."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from canopyflow.llm.common import field as column_field
from canopyflow.llm.common import map_arrow, text_slices
from canopyflow.llm.encode import ID, Segments, per_worker

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message: numbers as stored, everything else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, data[at:at + size]
        at += size


@dataclass
class Model:
    """What a ``.model`` file says; field numbers and defaults are those of sentencepiece's public message definition."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    suffix_space: bool = False


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            m.pieces.append(piece.get(1, b"").decode())
            m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            m.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            m.type, m.byte_fallback, m.suffix_space = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap, m.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
            m.remove_extra_spaces, m.escape_spaces = bool(spec.get(4, 1)), bool(spec.get(5, 1))
    m.unk_id = m.kinds.index(UNKNOWN)
    if m.type not in (UNIGRAM, BPE) or m.suffix_space or not m.escape_spaces:
        raise ValueError("only unigram and BPE models that mark the space before a word can be rebuilt")
    return m


def spaces_begin_pieces(m: Model) -> bool:
    """Whether no piece holds a space mark after another character: then pieces never cross from a word to the next space."""
    return not any(SPACE in p.lstrip(SPACE) for p, k in zip(m.pieces, m.kinds) if k in (NORMAL, USER_DEFINED))


def build(m: Model):
    """The same tokenizer in the tokenizers library: normaliser, space mark, scores or merges, byte fallback, decoder."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    if m.type == UNIGRAM:
        model = models.Unigram(list(zip(m.pieces, m.scores)), unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    else:
        ids = {p: i for i, p in enumerate(m.pieces)}
        merges = []
        for piece, score, kind in zip(m.pieces, m.scores, m.kinds):
            if kind == NORMAL:
                cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in ids and piece[i:] in ids]
                merges += [(-score, ids[piece], *sorted((ids[a], ids[b]) for a, b in [c])[0], c) for c in cuts]
        model = models.BPE(ids, [x[-1] for x in sorted(merges, key=lambda x: x[:-1])], unk_token=m.pieces[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback)
    out = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if spaces_begin_pieces(m):  # words are independent, and the library remembers them
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    out.add_tokens([AddedToken(p, normalized=False, special=False) for p, k in zip(m.pieces, m.kinds) if k == USER_DEFINED])
    return out


class Backend(Segments):
    """Encodes and decodes by the rebuilt tokenizer. Where single spaces part a text in independent words, each is encoded once.

    ``threads``: how many the library uses for a batch; one where a task has one core, as Spark's tasks do by default.
    """

    def __init__(self, path: str, memo_words: int = 500_000, threads: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = str(threads > 1).lower(), str(threads)
        self.threads = threads
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.tokenizer = build(self.model)
        m = self.model
        raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(m.pieces, m.kinds)]
        self.piece_size = np.asarray([len(r) for r in raw], np.int64)
        self.piece_begin, self.piece_bytes = np.cumsum(self.piece_size) - self.piece_size, np.frombuffer(b"".join(raw), np.uint8)
        self.by_words = spaces_begin_pieces(m) and m.dummy_prefix and not m.charsmap and not m.remove_extra_spaces and USER_DEFINED not in m.kinds
        super().__init__(memo_words)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, ID) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        n, known = self._grow()
        fresh = list(zip(range(n - 1, known - 1, -1), reversed(self.slot)))
        self.size[[p for p, k in fresh if not k or k == " "]] = -1  # two spaces: they may be one piece
        fresh = [x for x in fresh if x[1] and x[1] != " "]
        for i in range(0, len(fresh), 5_000):
            part = fresh[i:i + 5_000]
            if self.threads > 1:
                each = self._plain([k for _, k in part])
            else:  # one word each: the model without the steps around it
                each = [np.asarray([t.id for t in self.tokenizer.model.tokenize(SPACE + k)], ID) for _, k in part]
            size = np.asarray([len(x) for x in each])
            self._keep([p for p, _ in part], np.concatenate(each), np.cumsum(size) - size, size)
        self.n = n

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        if not self.by_words:
            return [x if t else np.zeros(0, ID) for t, x in zip(texts, self._plain(texts))]
        out = []
        for t, places in zip(texts, self.look_up([t.split(" ") for t in texts])):
            ids = self.ids_of(places) if t else np.zeros(0, ID)
            out.append(self._plain([t])[0] if ids is None else ids)
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The pieces' bytes, joined; byte pieces that form no characters, and unknown ids, are left to the library."""
        out = []
        for x in ids:
            try:
                size = self.piece_size[x]
                ends = np.cumsum(size)
                raw = self.piece_bytes[np.repeat(self.piece_begin[x] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
                text = raw.decode()
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            except (UnicodeDecodeError, IndexError):
                out.append(self.tokenizer.decode(x.tolist(), skip_special_tokens=False))
        return out


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 1) -> DataFrame:
    """Id, ``ids`` (little-endian unsigned 32-bit), ``n_tokens``, ``rebuilt`` and ``round_trip`` of every whole text.

    ``ids`` are the rebuilt tokenizer's. The sentencepiece library encodes every text too, to verify parity: ``rebuilt`` is false where
    its ids differ, and only there ``ids`` are the library's. ``round_trip``: decoding gives the text back (a model that normalises does not
    promise that). A null or empty text has no ids; very long texts are encoded whole; null ids stay null; equal rows give equal rows; an empty
    table gives none; other columns are not read.
    """
    def run(batches):
        import sentencepiece
        backend = per_worker(("sp", model), lambda: Backend(model, threads=threads))
        original = sentencepiece.SentencePieceProcessor(model_file=model)
        for part in text_slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            got = backend.encode(texts)
            want = [np.asarray(x, ID) for x in original.encode(texts, num_threads=threads)]
            same = [np.array_equal(a, b) for a, b in zip(got, want)]
            back = [a == b for a, b in zip(backend.decode(got), texts)]
            ids = [a if ok else b for a, b, ok in zip(got, want, same)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(same), pa.array(back)], ["id", "ids", "n_tokens", "rebuilt", "round_trip"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = map_arrow(rows, run, column_field(rows, "id"), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
                    T.StructField("rebuilt", T.BooleanType()), T.StructField("round_trip", T.BooleanType()))
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Add the text of ``ids`` (little-endian unsigned 32-bit); null ids give a null text. Other columns are carried."""
    kept = [f for f in encoded.schema if f.name != text_col]

    def run(batches):
        backend = per_worker(("sp", model), lambda: Backend(model))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [np.frombuffer(x or b"", ID) for x in part.column(ids_col).to_pylist()]
                texts = [None if null else t for t, null in zip(backend.decode(ids), part.column(ids_col).is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), text_col])

    return map_arrow(encoded, run, *kept, T.StructField(text_col, T.StringType()))
