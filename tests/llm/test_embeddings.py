import numpy as np
import pytest

from canopyflow.llm import embedding_dedup
from canopyflow.llm.embedding_dedup import hyperplanes, near_vectors

from .test_simhash import components

SCHEMA = "vec_id long, embedding array<float>, label int, node string, signature string, n string"


def cases():
    rnd = np.random.default_rng(9)
    base = rnd.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + rnd.standard_normal(16) * 0.02 * (i % 9)).astype(np.float32).tolist(), i % 3 if i % 2 else i % 6) for i in range(200)]
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(9)] + [(5, rows[5][1], rows[5][2])]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, rows[5][1], None), (404, rows[5][1], None), (405, [], 1),
             (406, [1.0, None] * 8, 1), (407, [float("inf")] + [1.0] * 15, 1), (None, rows[5][1], rows[5][2]), (408, (np.asarray(rows[5][1]) * 3).tolist(), rows[5][2]), (409, [1.0, 2.0], 1)]
    return rows


@pytest.mark.parametrize("shard", [1024, 7])
def test_links_and_components(spark, monkeypatch, shard):
    monkeypatch.setattr(embedding_dedup, "_SHARD", shard)
    rows = cases()
    got = near_vectors(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)).collect()
    x = [np.asarray(v, np.float32).astype(float) if v and None not in v else np.zeros(1) for _, v, _ in rows]
    ok = [bool(np.isfinite(v).all() and v.any() and r[2] is not None) for v, r in zip(x, rows)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j])
             and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98]
    label, n = components(len(rows), links), np.bincount(np.asarray(links).ravel(), minlength=len(rows))
    least = {c: min((r[0] for r, d in zip(rows, label) if d == c and r[0] is not None), default=None) for c in label}
    want = sorted(repr((r[0], int(k), least[c], r[0] is not None and r[0] == least[c])) for r, k, c in zip(rows, n, label))
    assert sorted(repr(tuple(r)) for r in got) == want and n.max() > 12


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hyperplanes_grow_with_the_largest_label():
    assert hyperplanes(0, 0.98) == (4, 8) and hyperplanes(200, 0.98) == (10, 15)
    sizes = [hyperplanes(10**k, 0.98) for k in range(3, 10)]
    assert sizes == sorted(sizes) and sizes[-1][0] == 32 and sizes[-1][1] < 90
    for bits, tables in sizes:
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 3e-5


def test_recall_on_given_vectors(spark):
    """Every link and component of the table, and of vectors planted close to the limit beside its own, by brute force."""
    given = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rnd, rows = np.random.default_rng(4), list(given)
    for i, v, label in given[::2]:
        v = np.asarray(v, float)
        for n in range(3):
            aside = rnd.standard_normal(len(v))
            aside -= (aside @ v) / (v @ v) * v
            cos = rnd.uniform(0.975, 0.99)
            rows.append((100_000 + 3 * i + n, (v / np.linalg.norm(v) * cos + aside / np.linalg.norm(aside) * np.sqrt(1 - cos * cos)).astype(np.float32).tolist(), label))
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)).collect()}
    links, at = np.zeros(len(rows), int), []
    for label in {r[2] for r in rows}:
        mine = np.asarray([i for i, r in enumerate(rows) if r[2] == label])
        x = np.asarray([rows[i][1] for i in mine], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
        at += list(zip(mine[i], mine[j]))
        links += np.bincount(np.concatenate([mine[i], mine[j]]), minlength=len(rows))
    found = sum(n for n, _ in got.values()) / 2
    assert len(at) > 1500 and found >= 0.999 * len(at)
    assert all(got[r[0]][0] <= n for r, n in zip(rows, links))
    if found == len(at):
        least = {}
        for r, c in zip(rows, label_of := components(len(rows), at)):
            least[c] = min(least.get(c, r[0]), r[0])
        assert all(got[r[0]][1] == least[c] for r, c in zip(rows, label_of))
