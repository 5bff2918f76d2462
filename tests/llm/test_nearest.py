"""Nearest neighbours: recall against brute force, exact scores and order, odd rows."""

import numpy as np
import pytest

from boutframe.llm import nearest
from boutframe.llm.catalogue import QUERIES
from boutframe.llm.tables import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, q in queries:
        d = np.sqrt(np.square(x - np.array(q, np.float32).astype(float)).sum(1))
        d[ids == i] = np.inf
        best = np.lexsort((ids, d))[: min(k, (ids != i).sum())]
        out[i] = [(ids[b], d[b]) for b in best]
    return out


def check(got, want, least):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i, x in want.items() if x}
    hits = total = 0
    for i, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[i]) + 1))
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[i]})
        total += len(want[i])
        true = dict(want[i])
        assert all(abs(s - true[v]) < 1e-12 for _, v, s in rows if v in true)
    assert hits >= least * total, hits / total
    return hits / total


@pytest.mark.parametrize("size", ["0.001", "0.1"])
def test_recall_on_the_whole_table(spark, size):
    root = f"/root/testdata/sf{size}"
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, root, "embeddings").collect()]
    got = QUERIES["op2_nearest_neighbours"](spark, root).collect()
    check(got, brute(rows, [r for r in rows if r[0] % 100 == 0]), 0.93)


def test_many_blocks_copies_and_scales(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for scale in (1e-6, 1e5):
        centres = rng.normal(size=(20, 16)) * scale
        x = np.vstack([centres[rng.integers(20, size=1500)] + rng.normal(size=(1500, 16)) * scale / 20, np.repeat(centres[:1], 300, 0)])
        rows = [(int(i), [float(c) for c in v], 0) for i, v in enumerate(x.astype(np.float32))]
        df = spark.createDataFrame(rows, SCHEMA)
        want = brute([r[:2] for r in rows], [r[:2] for r in rows if r[0] % 50 == 0])
        monkeypatch.setattr(nearest, "BLOCK_BYTES", 400 * 16 * 8)
        monkeypatch.setattr(nearest, "QUERY_BYTES", 10 * 16 * 8)
        check(nearest.nearest(df, df.filter("vec_id % 50 = 0")).collect(), want, 0.93)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (100, [0.0, 0.0], 1), (200, None, 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 1), (None, [1.0, 1.0], 1),
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [None, 1.0], 1), (4, [], 1), (5, [1.0, 0.0, 0.0], 1), (500, [9.0, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame([r + ("x", 1.0) for r in rows], SCHEMA + ", rank string, score double")
    got = sorted(map(tuple, nearest.nearest(df, df.filter("vec_id % 100 = 0")).collect()))
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (500, 1, 5, 8.0)]
    assert nearest.nearest(df.limit(0), df).collect() == []
    assert nearest.nearest(df, df.limit(0)).collect() == []
