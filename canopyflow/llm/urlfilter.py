"""URL rules by a bit-parallel wildcard automaton."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflow.llm.common import field, map_arrow, text_slices

ALLOW, BLOCK = "allow", "block"
#: bits of state in one automaton; longer rule lists are run in several, so a batch's memory is bounded
_STATES = 64 * 64


@dataclass(frozen=True)
class Rule:
    """``host/path`` with ``*`` (any run of characters, within the host or within the path) and ``?`` (one byte, so one ASCII character).

    A rule fits its host and all subdomains, and every path that begins with the rule's.
    """

    text: str
    verdict: str

    def __post_init__(self):
        if "/" not in self.text or self.verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a rule is host/path with verdict {ALLOW} or {BLOCK}, not {self}")


class Automaton:
    """All rules as one Shift-And automaton over the bytes of ``.host/path``: one bit for each rule character, in 64-bit words.

    ``step[c]`` has a bit where a rule's character accepts byte c after the one before it, ``stay[c]`` where a star keeps the state.
    A rule begins at the text's first dot or, because of subdomains, at any dot of the host.
    """

    def __init__(self, rules: Sequence[Rule]):
        states: list[tuple[bytes | None, bool]] = []  # (byte, or None for any; whether a star follows)
        host_part, first, last = [], [], []
        for r in rules:
            raw = ("." + r.text).encode()
            first.append(len(states))
            in_host = True
            for i in range(len(raw)):
                c = raw[i:i + 1]
                if c == b"*":
                    states[-1] = (states[-1][0], True)
                    continue
                in_host = in_host and c != b"/"
                states.append((None if c == b"?" else c, False))
                host_part.append(in_host)
            last.append(len(states) - 1)
        n = len(states)
        self.words = max(1, -(-n // 64))
        self.step, self.stay = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for i, (c, star) in enumerate(states):
            word, bit = i // 64, np.uint64(1 << (i % 64))
            anything = [b for b in range(256) if not (host_part[i] and b == ord("/"))]
            self.step[anything if c is None else c[0], word] |= bit
            if star:
                self.stay[anything, word] |= bit
        self.first, self.last = self._mask(first), self._mask(last)
        self.ends = last

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in bits:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def run(self, texts: list[bytes]) -> np.ndarray:
        """For each text which rules end somewhere in it (texts x rules); a rule's path is a prefix, so an end is final."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.asarray([len(texts[i]) for i in order])
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.cumsum(lengths) - lengths
        n = len(texts)
        state, ended = np.zeros((n, self.words), np.uint64), np.zeros((n, self.words), np.uint64)
        in_host, at = np.ones(n, bool), np.arange(n)  # rows that can still change
        one, top = np.uint64(1), np.uint64(63)
        for pos in range(int(lengths[0]) if n else 0):
            at = at[(lengths[at] > pos) & (in_host[at] | state[at].any(axis=1))]
            if not len(at):
                break
            c = flat[begin[at] + pos]
            before = state[at]
            moved = before << one
            moved[:, 1:] |= before[:, :-1] >> top  # the bit that leaves a word enters the next
            moved &= ~self.first  # a rule's first state is entered only by its own start
            moved |= np.where(in_host[at, None], self.first, np.uint64(0))
            now = (moved & self.step[c]) | (before & self.stay[c])
            state[at] = now
            ended[at] |= now & self.last
            in_host[at] &= c != ord("/")
        hit = np.zeros((n, len(self.ends)), bool)
        for k, e in enumerate(self.ends):
            hit[order, k] = (ended[:, e // 64] >> np.uint64(e % 64)) & one > 0
        return hit


def automata(rules: Sequence[Rule]) -> list[tuple[list[int], Automaton]]:
    """Blocks of rules of at most ``_STATES`` bits (a longer rule alone), with each rule's place."""
    blocks, size = [[]], 0
    for i, r in enumerate(rules):
        n = len(r.text.encode()) + 1
        if blocks[-1] and size + n > _STATES:
            blocks.append([])
            size = 0
        blocks[-1].append(i)
        size += n
    return [(b, Automaton([rules[i] for i in b])) for b in blocks if b]


def url_parts(url) -> tuple:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then up to ``?``, ``#`` or the
    end) as columns; both empty if the url is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "#", 1)).otherwise(F.lit(""))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(rest, F.char_length(host) + 1, 1 << 30)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Id, host, path, the longest rule that fits (null if none; of equally long ones the first in the list) and its verdict.

    The rule list is the caller's and goes along with the tasks. One row per input row, so equal rows give equal rows; a null or
    empty url has empty host and path and takes the default; a null id stays null; other columns are not read;
    an empty table gives none; a very long url is read whole, byte by byte. No shuffle.
    """
    rules = list(rules)
    texts = [r.text for r in rules]
    if len({(r.text, r.verdict) for r in rules}) != len(set(texts)):
        raise ValueError("a rule has two verdicts")
    host, path = url_parts(pages[url_col])
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    rank = sorted(range(len(rules)), key=lambda i: (len(texts[i]), -i))
    verdicts = [r.verdict for r in rules]

    def run(batches):
        blocks, place = automata(rules), np.empty(len(rules), np.int64)
        place[rank] = np.arange(len(rules))
        for part in text_slices(batches, "host", "path"):
            canonical = [f".{h}{p}".encode() for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist())]
            best = np.full(len(canonical), -1)
            for members, automaton in blocks:
                hit = automaton.run(canonical)
                best = np.maximum(best, np.where(hit, place[members], -1).max(axis=1, initial=-1))
            found = [rank[b] if b >= 0 else None for b in best.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("id", "host", "path")), pa.array([None if i is None else texts[i] for i in found], pa.string()),
                 pa.array([default if i is None else verdicts[i] for i in found], pa.string())], ["id", "host", "path", "rule", "verdict"])

    out = map_arrow(rows, run, field(rows, "id"), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")))
    return out.withColumnRenamed("id", id_col)
