"""SimHash near-dedup as a whole, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from corvane.llm import simhash

NODE = "rep long, n long, high long, low long"


def nodes(rng: np.random.Generator, groups: int, distances: range, base: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Isolated pairs of signatures that differ in the given numbers of bits, in turn."""
    out = []
    for i in range(groups):
        x = rng.integers(0, 2**64, 2, dtype=np.uint64)
        y = x.copy()
        for b in rng.choice(128, distances[i % len(distances)], replace=False):
            y[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        out += [(2 * i, 100, *map(int, x.view(np.int64))), (2 * i + 1, 100, *map(int, y.view(np.int64)))]
    return out


def test_every_pair_up_to_the_greatest_distance(spark):
    rows = nodes(np.random.default_rng(1), 400, range(12, 21))
    got = {(r["node"], r["root"]) for r in simhash.components(simhash.near_links(spark.createDataFrame(rows, NODE))).collect()}
    assert got == {(2 * i + k, 2 * i) for i in range(400) if 12 + i % 9 <= simhash.MAX_DISTANCE for k in (0, 1)}


@pytest.mark.parametrize("wide", [16, 4096])
def test_large_buckets_of_mostly_unrelated_signatures(monkeypatch, wide):
    monkeypatch.setattr(simhash, "_WIDE", wide)
    rows = np.array([r[2:] for r in nodes(np.random.default_rng(2), 150, range(1, 40))], dtype=np.int64).view(np.uint64)
    zero, n = np.zeros(300, np.int64), np.full(300, 100)
    a, b = simhash._links(zero, zero, zero + 1, rows[:, 0], rows[:, 1], n, 19, 0.8)
    pairs = [(i, j) for i in range(300) for j in range(i) if simhash._near(rows[:, 0], rows[:, 1], n, np.array([i]), np.array([j]), 19, 0.8)[0]]
    assert len(pairs) > 50
    whole = simhash._forest(300, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert (simhash._forest(300, a, b) == whole).all()


def test_word_counts_of_equal_signatures(spark):
    """A text written twice has the signature of the text, but not its word count."""
    text = " ".join(f"word{i}" for i in range(101))
    rows = [(1, text), (2, f"{text} {text}"), (3, f"{text} {text} more"), (4, text), (5, f"{text} {text}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({(r["high"], r["low"]) for r in simhash.signatures(docs).collect() if r["doc_id"] != 3}) == 1
    got = {(r["doc_id"], r["kept_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(3, 2), (4, 1), (5, 2)}
    # within the ratio of each other they are near duplicates
    assert {(r["doc_id"], r["kept_id"]) for r in simhash.near_duplicates(docs, min_ratio=0.5).collect()} >= {(2, 1), (4, 1), (5, 1)}


@pytest.mark.parametrize("group_rows", [7, 64, 10**6])
def test_split_groups_lose_no_link(spark, group_rows):
    """A third of all signatures near one another, in groups that are split into blocks."""
    rng = np.random.default_rng(4)
    rows, center = nodes(rng, 60, range(1, 20)), rng.integers(0, 2**64, 2, dtype=np.uint64)
    for i in range(60):
        x = center.copy()
        for b in rng.choice(128, int(rng.integers(0, 10)), replace=False):
            x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        rows.append((1000 + i, 100, *map(int, x.view(np.int64))))
    table = spark.createDataFrame(rows, NODE)
    got = {(r["node"], r["root"]) for r in simhash.components(simhash.near_links(table, group_rows=group_rows)).collect()}
    h, n = np.array([r[2:] for r in rows], dtype=np.int64).view(np.uint64), np.full(len(rows), 100)
    a, b = np.triu_indices(len(rows), 1)
    ok = simhash._near(h[:, 0], h[:, 1], n, a, b, 19, 0.8)
    root = simhash._forest(len(rows), a[ok], b[ok])
    ids = np.array([r[0] for r in rows])
    least = {k: int(ids[root == k].min()) for k in np.unique(root)}
    size = np.bincount(root, minlength=len(rows))
    assert got == {(int(ids[i]), least[root[i]]) for i in range(len(rows)) if size[root[i]] > 1}


def test_bits_are_those_of_the_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1, *map(int, rng.integers(-(2**63), 2**63, 2))) for i in range(50)]
    table, h = spark.createDataFrame(rows, NODE), np.array([r[2:] for r in rows], dtype=np.int64).view(np.uint64)
    for start, stop in ((0, 5), (58, 64), (60, 71), (64, 70), (120, 128), (33, 64)):
        want = [r[0] for r in table.orderBy("rep").select(simhash._take(table.high, table.low, start, stop)).collect()]
        assert simhash._bits(h[:, 0], h[:, 1], start, stop).tolist() == want


def test_few_of_a_large_bucket_are_verified(monkeypatch):
    """Whole signatures are compared for those pairs only whose word counts and first words leave it open."""
    rng, seen = np.random.default_rng(6), []
    near = simhash._near
    monkeypatch.setattr(simhash, "_near", lambda high, low, n, a, b, *limits: seen.append(np.broadcast(a, b).size) or near(high, low, n, a, b, *limits))
    h, n = rng.integers(0, 2**64, (3000, 2), dtype=np.uint64), np.exp(rng.normal(6, 1, 3000)).astype(np.int64) + 1
    # one pair is near, at the least ratio that is allowed
    h[1], n[:2] = h[0] ^ np.uint64(5), (800, 1000)
    zero = np.zeros(3000, np.int64)
    a, b = simhash._links(zero, zero, zero + 1, h[:, 0], h[:, 1], n, 19, 0.8)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == {(0, 1)}
    assert sum(seen) < 3000 * 3000 / 2 / 20


@pytest.mark.parametrize("tile", [16, 4096])
@pytest.mark.parametrize("ratio", [0.0, 0.8, 1.0])
def test_buckets_of_all_sizes_against_pairs(monkeypatch, tile, ratio):
    """Many groups and buckets in one call, some of near copies, with word counts on both sides of the ratio."""
    monkeypatch.setattr(simhash, "_TILE", tile)
    rng = np.random.default_rng(7)
    centers = rng.integers(0, 2**64, (12, 2), dtype=np.uint64)
    h = centers[rng.choice(12, 900, p=[0.3, 0.2] + [0.05] * 10)]
    for x in h:
        for b in rng.choice(128, int(rng.integers(0, 14)), replace=False):
            x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    g, n = rng.integers(0, 5, 900), rng.integers(50, 130, 900)
    other, width = rng.integers(0, 8, 900), np.where(g < 2, 2, 3)
    other &= (1 << width) - 1
    i, j = np.triu_indices(900, 1)
    ok = simhash._near(h[:, 0], h[:, 1], n, i, j, 19, ratio)
    whole = simhash._forest(900, i[ok], j[ok])
    met = ok & (g[i] == g[j]) & (np.bitwise_count(other[i] ^ other[j]) <= 1)
    least = simhash._forest(900, i[met], j[met])
    a, b = simhash._links(g, other, width, h[:, 0], h[:, 1], n, 19, ratio)
    got = simhash._forest(900, a, b)
    # all that a bucket connects, and nothing that near pairs don't
    assert (got[least] == got).all() and (whole[got] == whole).all()
