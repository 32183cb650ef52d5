import collections
import math
import random
import zlib

import numpy as np
import pytest

from canopyflow.llm.encode import Encoder
from canopyflow.llm.packing import DOT, Capacity, pack, plan


@pytest.mark.parametrize("capacity", [Capacity(), Capacity(100, 4, 5000), Capacity(100, 4, 5000, rule=DOT), Capacity(60, 3, 3600, (1.0, 0.1, 3.0)), Capacity(10, 1, 100)])
def test_plan_keeps_every_capacity(capacity):
    rnd = random.Random(1)
    counts = collections.Counter(rnd.randint(1, min(capacity.longest, rnd.choice([20, 200, 2000]))) for _ in range(3000))
    held, seen = collections.defaultdict(list), collections.Counter()
    for length, rank, n, first, each, offset in plan(counts, capacity).tolist():
        assert seen[length] == rank
        seen[length] += n
        for j in range(n):
            held[first + j // each].append((offset + j % each * length, length))
    assert seen == counts
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(pieces) <= capacity.documents and sum(n * n for _, n in pieces) <= capacity.attention
    if capacity == Capacity():
        assert len(held) <= 1.01 * math.ceil(sum(k * v for k, v in counts.items()) / 1024)


def test_no_worse_than_one_at_a_time():
    rnd = random.Random(6)
    lengths = [rnd.choice([rnd.randint(1, 1024), rnd.randint(300, 700), rnd.randint(1, 90)]) for _ in range(4000)]
    left = []
    for n in sorted(lengths, reverse=True):
        best = min((i for i, r in enumerate(left) if r >= n), key=lambda i: left[i], default=None)
        if best is None:
            left.append(1024 - n)
        else:
            left[best] -= n
    runs = plan(collections.Counter(lengths), Capacity())
    assert max(f + -(-n // e) for _, _, n, f, e, _ in runs.tolist()) <= len(left) + 1


def test_pieces_and_places(docs_of, odd, bpe):
    capacity = Capacity(tokens=64, documents=64, attention=64 * 64)
    rows = pack(docs_of(odd), bpe, end_id=2, capacity=capacity).collect()
    lib, want = Encoder(bpe), []
    for i, t in odd:
        ids = np.append(lib.tokenizer.encode(t or "", add_special_tokens=False).ids, 2).astype("<u4")
        edges = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == sorted(want)
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist() and sum(n for _, n in pieces) <= 64
    assert len(held) <= 1.02 * sum(r.length for r in rows) / 64 + 1
    assert pack(docs_of([]), bpe).count() == 0
