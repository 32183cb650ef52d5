"""Ids of whole texts by the tokenizers library.

A byte-level BPE splits a text in words before it merges, and merges never cross a word. A single space between two characters that
are no white space always begins a word, so the text between two such spaces has the same ids wherever it stands. ``Encoder`` has
the library encode each such segment once, keeps the ids, and joins them. Tokenizers of another kind encode text by text.

``encode_long`` is the other way for very long texts: overlapping chunks with offsets, spliced where both chunks begin a word.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections import defaultdict
from collections.abc import Iterable
from itertools import count
from operator import itemgetter

import numpy as np

_STABLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: a word's end may depend on so many characters after it (contractions, a special token's string)
_LOOK_AHEAD = 16
ID = np.dtype("<u4")
#: letters before U+0250, then punctuation: two words, wherever the segment stands
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)").fullmatch
_EDGE = " "  # ends the key of a text's first segment, which has no space before it


def per_worker(key, make):
    """What ``make`` gives, made once in a Python worker and kept over its tasks. Functions of this package may be sent by value, so
    the place to keep it is a module of its own."""
    state = sys.modules.setdefault("canopyflow_worker_state", types.ModuleType("canopyflow_worker_state"))
    kept = vars(state).setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, with what it remembers."""
    return per_worker(("encoder", path), lambda: Encoder(path))


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the bytes that are no printable Latin-1 characters: as the characters from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class Segments:
    """Ids of text segments by key: ``slot`` gives each key a place, new keys the next one; the ids of all places lie in one array."""

    def __init__(self, memo_words: int):
        self.memo_words = memo_words
        self._clear()

    def _clear(self) -> None:
        self.slot = defaultdict(count().__next__)  # key -> place in size, begin and uses
        self.size, self.begin, self.uses = np.zeros(1024, dtype=np.int32), np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int32)
        self.n, self.ids, self.n_ids = 0, np.zeros(8192, dtype=ID), 0

    def _forget_rare(self) -> None:
        """Keep what was met more than once; if that is not much less, nothing."""
        keep = np.flatnonzero((self.uses[:self.n] > 1) & (self.size[:self.n] >= 0))
        if len(keep) > self.memo_words // 2:
            self._clear()
            return
        kept = set(keep.tolist())
        keys = [k for place, k in enumerate(self.slot) if place in kept]
        size, begin = self.size[keep], self.begin[keep]
        ends = np.cumsum(size, dtype=np.int64)
        self.ids = self.ids[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        self.n = len(keys)
        self.slot = defaultdict(count(self.n).__next__, zip(keys, range(self.n)))
        self.size, self.begin, self.uses, self.n_ids = size, ends - size, np.ones(self.n, dtype=np.int32), len(self.ids)

    def _keep(self, places: list[int], ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.n_ids + len(ids)))
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.begin[places], self.size[places] = begin + self.n_ids, size
        self.n_ids += len(ids)

    def _learn(self) -> None:
        """Give ids, or a size of -1, to the places from ``n`` on, and set ``n``."""
        raise NotImplementedError

    def _grow(self) -> tuple[int, int]:
        n, known = len(self.slot), self.n
        if n > len(self.size):
            self.size, self.begin, self.uses = (np.resize(x, 2 * n) for x in (self.size, self.begin, self.uses))
        self.uses[known:n] = 0
        return n, known

    def look_up(self, keyed: Iterable[list[str]]) -> list[np.ndarray]:
        """The places of each list of keys, with ids known for all."""
        if self.n > self.memo_words:
            self._forget_rare()
        places = [np.asarray(itemgetter(*keys, _EDGE)(self.slot)[:-1], np.int64) for keys in keyed]
        self._learn()
        if places:
            self.uses[:self.n] += np.bincount(np.concatenate(places), minlength=self.n).astype(np.int32)
        return places

    def ids_of(self, places: np.ndarray) -> np.ndarray | None:
        """The ids of the places, one after the other; None if a segment has none of its own."""
        size = self.size[places]
        if size.min(initial=0) < 0:
            return None
        ends = np.cumsum(size, dtype=np.int64)
        return self.ids[np.repeat(self.begin[places] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder(Segments):
    """``encode(texts)`` gives each text's ids, little-endian unsigned 32-bit; a null text has none.

    ``memo_words`` bounds the remembered segments: beyond it, those met only once are forgotten.
    """

    def __init__(self, path: str, memo_words: int = 400_000, parallel: bool = False):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if parallel else "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.margin = max([_LOOK_AHEAD] + [len(t["content"]) + 1 for t in spec["added_tokens"]])
        self.newline = self._newline(spec)
        self.letters, self.ends = _byte_letters(), {}
        super().__init__(memo_words)

    def _newline(self, spec: dict) -> int | None:
        """The id that separates segments when many are encoded in one text; None: this tokenizer's segments are not independent."""
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        added = added and all(re.search(r"[^A-Za-z][A-Za-z]+[^A-Za-z]", t["content"]) for t in spec["added_tokens"])  # never within a word
        if not plain or not added or spec["normalizer"] or spec["post_processor"]:
            return None
        ids = self.tokenizer.encode("\n", add_special_tokens=False).ids
        return ids[0] if len(ids) == 1 else None

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=ID) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encode the segments met since the last call: plain words by the library's model, of others many in one text where a
        newline's id tells them apart."""
        n, known = self._grow()
        together, alone, words, sizes, flat = [], [], [], [], []
        letters, model, ends = self.letters, self.tokenizer.model, self.ends
        for place, key in zip(range(n - 1, known - 1, -1), reversed(self.slot)):
            if word := _WORD(key):
                name, end = word.groups()
                ids = [t.id for t in model.tokenize("\u0120" + name if name.isascii() else (" " + name).encode().decode("latin-1").translate(letters))]
                if end:
                    if end not in ends:
                        ends[end] = self.tokenizer.encode(end, add_special_tokens=False).ids
                    ids += ends[end]
                words.append(place)
                sizes.append(len(ids))
                flat += ids
                continue
            segment = key[:-1] if key.endswith(_EDGE) else key
            if not segment or segment[0].isspace() or segment[-1].isspace():
                self.size[place] = -1  # white space beside the cut: where words begin depends on the rest
            elif segment is not key or "\n" in segment:
                alone.append((place, key))
            else:
                together.append((place, key))
        size = np.asarray(sizes, np.int64)
        self._keep(words, np.asarray(flat, ID), np.cumsum(size) - size, size)
        for i in range(0, len(together), 20_000):
            part = together[i:i + 20_000]
            ids, = self._plain(["\n".join(" " + k for _, k in part)])
            cuts = np.flatnonzero(ids == self.newline)
            if len(cuts) != len(part) - 1:
                alone += part
                continue
            begin = np.concatenate([[0], cuts + 1])
            self._keep([p for p, _ in part], ids, begin, np.append(cuts, len(ids)) - begin)
        for i in range(0, len(alone), 5_000):
            part = alone[i:i + 5_000]
            each = self._plain([k[:-1] if k.endswith(_EDGE) else " " + k for _, k in part])
            size = np.asarray([len(x) for x in each])
            self._keep([p for p, _ in part], np.concatenate(each), np.cumsum(size) - size, size)
        self.n = n

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        if self.newline is None:
            return self._plain(texts)
        if len(self.ends) > 10_000:
            self.ends = {}
        keyed = [t.split(" ") for t in texts]
        for keys in keyed:
            keys[0] += _EDGE
        out = []
        for t, places in zip(texts, self.look_up(keyed)):
            ids = self.ids_of(places) if t else np.zeros(0, ID)
            out.append(self._by_stable_spaces(t) if ids is None else ids)  # None: a segment beside other white space
        return out

    def _by_stable_spaces(self, text: str) -> np.ndarray:
        first, *rest = _STABLE_SPACE.split(text)
        segments = [first, *(" " + s for s in rest)]
        return np.concatenate([x for i in range(0, len(segments), 5_000) for x in self._plain(segments[i:i + 5_000])])

    def _chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a chunk, and where its words begin: place in the text, place in the ids."""
        return self._words(self.tokenizer.encode(text[start:end], add_special_tokens=False), start)

    @staticmethod
    def _words(encoding, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.asarray(encoding.ids, dtype=ID)
        words = np.asarray([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
        at, offsets = np.flatnonzero(np.diff(words, prepend=-2)), encoding.offsets  # the library builds this list anew at each call
        return ids, np.asarray([offsets[i][0] for i in at.tolist()], dtype=np.int64) + start, at

    def encode_long(self, text: str, chunk: int = 32_768, overlap: int = 256) -> tuple[np.ndarray, int, int]:
        """Ids of a long text, the number of chunks, and how often an overlap had to be widened.

        A place where a chunk and the next one both begin a word, not nearer than the look-ahead to the first one's end, is stable:
        the first chunk has read all that decides on the words before it, and the words after it depend only on what follows. If an
        overlap holds no such place it is doubled, at last back to the place that is settled already.
        """
        n = len(text)
        starts = [0]
        while starts[-1] + chunk < n:
            starts.append(starts[-1] + chunk - overlap)
        spans = [(s, min(n, s + chunk)) for s in starts]
        out, widened = [], 0
        settled, (ids, places, at), end = 0, self._chunk(text, *spans[0]), spans[0][1]
        for i in range(1, len(spans), 16):  # so many chunks are held at once
            group = spans[i:i + 16]
            for (s, e), encoded in zip(group, self.tokenizer.encode_batch([text[s:e] for s, e in group], add_special_tokens=False)):
                nxt, size = self._words(encoded, s), overlap
                while True:
                    both = np.intersect1d(places, nxt[1])
                    both = both[(both > settled) & (both <= end - self.margin)]
                    if len(both) or s <= settled:
                        break
                    size, widened = size * 2, widened + 1
                    s = max(settled, end - size)
                    nxt = self._chunk(text, s, e)
                if len(both):
                    p = int(both[-1])
                    begin = at[np.searchsorted(places, settled)] if settled else 0
                    out.append(ids[begin:at[np.searchsorted(places, p)]])
                    settled = p
                ids, places, at = nxt
                end = e
        begin = at[np.searchsorted(places, settled)] if settled else 0
        out.append(ids[begin:])
        return np.concatenate(out), len(spans), widened
