"""Vantage-point trees against brute force: results, recall, work, and odd cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import common, vptree

VEC = "vec_id long, embedding array<float>"


def brute(ids: np.ndarray, x: np.ndarray, k: int, every: int) -> list[tuple]:
    d = np.round(vptree.distances(x, x), 6)
    np.fill_diagonal(d, np.inf)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        for rank, j in enumerate(np.lexsort((ids, d[i]))[:k]):
            if np.isfinite(d[i, j]):
                out.append((int(ids[i]), int(ids[j]), rank + 1, float(d[i, j])))
    return sorted(out)


def clustered(n: int, rng: np.random.Generator) -> np.ndarray:
    centres = rng.normal(size=(n // 100, 16)) * 4
    return (centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 16)) * 0.2).astype(np.float32).astype(float)


@pytest.mark.parametrize(("every", "shard_rows", "sample"), [(1, 60, 20_000), (10, 25, 40), (7, 10_000, 20_000)])
def test_factor_one_is_exact(spark, every, shard_rows, sample):
    rng = np.random.default_rng(1)
    x = clustered(300, rng)
    x[:100] = x[0]  # a third of all rows is one vector
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC)
    got = vptree.nearest_neighbours(table, 5, 1.0, shard_rows=shard_rows, every=every, sample_rows=sample)
    assert sorted(tuple(r) for r in got.collect()) == brute(np.arange(300), x, 5, every)


def test_recall_of_the_query(spark):
    """The query of the operator, as it is registered, on uniform data (which nothing can prune)."""
    table = common.read(spark, "/root/testdata/sf0.1", "embeddings")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    want = {t[:2] for t in brute(ids, x, 10, 100)}
    got = {(r["vec_id"], r["neighbour_id"]) for r in vptree.nearest_neighbours(table, every=100, shard_rows=500).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_clusters_are_pruned():
    """With the production factor: at most a tenth of all pairs, and of a router's regions, at a recall of 0.9."""
    rng = np.random.default_rng(2)
    x, ids = clustered(10_000, rng), np.arange(10_000)
    tree, q = vptree.Tree(x), np.arange(0, 10_000, 50)
    search = vptree.Search(x[q], q, 10, vptree.FACTOR).run(tree, ids, x)
    d = vptree.distances(x[q], x).round(6)
    d[np.arange(len(q)), q] = np.inf
    truth = np.sort(d, axis=1)[:, 9]
    assert (search.best <= truth[:, None]).mean() >= 0.9
    assert search.pairs <= 0.1 * len(q) * len(x)
    exact = vptree.Search(x[q], q, 10, 1.0).run(tree, ids, x)
    assert (exact.best[:, 9] == truth).all() and exact.pairs <= 0.1 * len(q) * len(x)
    router = vptree.Tree(x[::5], leaf=40, tight=False)
    visits = sum(len(at) for at, _ in router.reach(x[q], truth, vptree.FACTOR))
    assert visits <= 0.1 * len(q) * len(router.leaves)


def test_queries_stream_in_blocks(monkeypatch):
    """A shard's queries are never held all at once."""
    monkeypatch.setattr(vptree, "BLOCK", 16)
    sizes = []
    run = vptree.Search.run
    monkeypatch.setattr(vptree.Search, "run", lambda self, *a: (sizes.append(len(self.q)), run(self, *a))[1])
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))

    def batch(kind, at):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), 5)), pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(x[at].tolist()), pa.array([None if kind == 0 else np.inf] * len(at), pa.float64())],
            names=["shard", "kind", "id", "v", "tau"])

    batches = [batch(0, np.arange(0, 150)), batch(0, np.arange(150, 400)), batch(1, np.arange(0, 77)), batch(1, np.arange(77, 200))]
    out = list(vptree._stream(4, 3, 1.0)(iter(batches)))
    assert sum(sizes) == 200 and max(sizes) <= 32
    assert sum(b.num_rows for b in out) == 600


def test_odd_cases(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (2, [5.0, 5.0]), (3, [1.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0])]
    want = {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)}
    got = vptree.nearest_neighbours(spark.createDataFrame(rows, VEC), 2).collect()
    assert {(r["vec_id"], r["neighbour_id"], r["rank"]) for r in got} == want
    clash = spark.createDataFrame([(i, v, 0, 1, "s", 2.0, 3, 4) for i, v in rows], f"{VEC}, id int, v int, shard string, tau double, region int, part int")
    got = vptree.nearest_neighbours(clash, 2).collect()
    assert {(r["vec_id"], r["neighbour_id"], r["rank"]) for r in got} == want
    assert vptree.nearest_neighbours(spark.createDataFrame([], VEC)).count() == 0
    assert vptree.nearest_neighbours(spark.createDataFrame([(3, [1.0])], VEC)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], VEC)
    assert vptree.nearest_neighbours(same, 3, shard_rows=50).count() == 600
    long = spark.createDataFrame([(i, [float(i)] + [0.5] * 20_000) for i in range(6)], VEC)
    assert {(r["vec_id"], r["neighbour_id"]) for r in vptree.nearest_neighbours(long, 1).collect() if r["vec_id"] in (0, 5)} == {(0, 1), (5, 4)}
