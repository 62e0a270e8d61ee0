"""Approximate nearest neighbours: vantage-point trees per shard, with relaxed triangle-inequality pruning.

A vantage-point tree splits vectors by their distance to a chosen vector. If the vectors of one side are at
distances from lo to hi from the vantage point and a query is at d, none of them is nearer to the query than
max(d - hi, lo - d). A leaf's bound is the largest along its path, and a query whose k-th neighbour so far is at
tau needs the leaf only if the bound is at most tau. Here it is visited only if ``factor`` * bound <= tau: factor 1
is the exact search, larger factors prune more and miss some neighbours.

The corpus is cut into regions by the top levels of such a tree, built on a bounded sample; every row is
indexed. A region with more rows than a shard may hold (many equal vectors, or more rows than the sample can
tell apart) is dealt by a hash of the id over as many shards as it needs, so no shard grows with the corpus.
Queries visit the shards of their own region first, which gives them a tau; then they go only to those regions
that the same relaxed test leaves, and the results are merged. A shard's rows arrive sorted before its queries,
which stream through the shard's tree in blocks: a task holds one shard and one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import common

#: README has the curve of recall and work by factor that the default was chosen from.
K, FACTOR = 10, 4.0
#: Rows of a shard, rows of the sample that regions are cut from, least sample rows of a region, rows of a leaf.
SHARD_ROWS, SAMPLE_ROWS, REGION_SAMPLE, LEAF = 10_000, 20_000, 8, 64
#: Queries that walk a tree together; nearest leaves that each visits before all others.
BLOCK, FIRST = 1024, 4
#: Distances are rounded to 6 digits; tests on bounds have this much slack.
_SLACK = 1e-5
_NONE = np.iinfo(np.int64).max


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to the rows of b."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """A vantage-point tree over the rows of vectors.

    ``tight`` bounds a side by the distances its rows have, which holds for these rows only; without it a side is
    bounded by the radius, which holds for any vector that ``home`` puts there.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, tight: bool = True):
        rng = np.random.default_rng(7)
        self.leaves: list[np.ndarray] = []
        #: (vantage point, ((is leaf, index, lo, hi) of the inner side, of the outer side)), parents first
        points: list[np.ndarray] = []
        self.sides: list[list[tuple[bool, int, float, float]]] = []
        self.radius: list[float] = []
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(vectors)), -1, 0)]
        spans: dict[tuple[int, int], tuple[float, float]] = {}
        while todo:
            rows, parent, side = todo.pop()
            split = self._split(vectors, rows, rng) if len(rows) > leaf else None
            if parent >= 0:
                lo, hi = spans[parent, side]
                self.sides[parent][side] = (split is None, len(self.leaves) if split is None else len(points), lo, hi)
            if split is None:
                self.leaves.append(rows)
                continue
            vantage, radius, d, near = split
            at = len(points)
            points.append(vantage)
            self.radius.append(radius)
            self.sides.append([(False, -1, 0.0, 0.0)] * 2)
            for k, group in enumerate((near, ~near)):
                spans[at, k] = (float(d[group].min()), float(d[group].max())) if tight else ((0.0, radius) if k == 0 else (radius, np.inf))
                todo.append((rows[group], at, k))
        self.points = np.array(points) if points else np.zeros((0, vectors.shape[1] if vectors.ndim == 2 else 0))

    @staticmethod
    def _split(vectors: np.ndarray, rows: np.ndarray, rng: np.random.Generator):
        """(vantage point, radius, distances, inner rows); None if all rows are at one distance of it."""
        candidates, probe = rng.choice(rows, min(5, len(rows)), replace=False), rng.choice(rows, min(64, len(rows)), replace=False)
        vantage = vectors[candidates[int(np.argmax(distances(vectors[candidates], vectors[probe]).var(axis=1)))]]
        d = distances(vectors[rows], vantage[None])[:, 0]
        ordered = np.sort(d)
        # between two values that differ, as near to the middle as there are such
        steps = np.flatnonzero(ordered[1:] > ordered[:-1] + 1e-9)
        if not len(steps):
            return None
        step = steps[int(np.argmin(np.abs(steps - len(rows) // 2)))]
        radius = float((ordered[step] + ordered[step + 1]) / 2)
        return vantage, radius, d, d < radius

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least possible distance of every query to the rows of every leaf."""
        out = np.zeros((len(queries), len(self.leaves)))
        if not len(self.points):
            return out
        d, held = distances(queries, self.points), {0: np.zeros(len(queries))}
        for i, sides in enumerate(self.sides):
            above = held.pop(i)
            for is_leaf, j, lo, hi in sides:
                here = np.maximum(above, np.maximum(d[:, i] - hi, lo - d[:, i]))
                if is_leaf:
                    out[:, j] = here
                else:
                    held[j] = here
        return out

    def reach(self, queries: np.ndarray, tau: np.ndarray | None, factor: float) -> list[tuple[np.ndarray, int]]:
        """(queries, leaf) pairs: with tau all leaves that the relaxed test leaves, without it the home leaf only."""
        if not len(self.points):
            return [(np.arange(len(queries)), 0)] if len(queries) else []
        out, todo = [], [(0, np.arange(len(queries)))]
        while todo:
            i, at = todo.pop()
            d = distances(queries[at], self.points[i][None])[:, 0]
            near = d < self.radius[i]
            for k, (is_leaf, j, lo, hi) in enumerate(self.sides[i]):
                go = near if k == 0 else ~near
                if tau is not None:
                    go = go | (factor * np.maximum(d - hi, lo - d) <= tau[at] + _SLACK)
                if go.any():
                    (out if is_leaf else todo).append((at[go], j) if is_leaf else (j, at[go]))
        return out


class Search:
    """The k nearest rows of a tree for a block of queries. ``pairs`` counts the distances computed."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, tau: np.ndarray | None = None):
        self.q, self.own, self.k, self.factor, self.pairs = queries, own, k, factor, 0
        self.best = np.full((len(queries), k), np.inf)
        self.who = np.full((len(queries), k), _NONE)
        self.bound = np.full(len(queries), np.inf) if tau is None else tau.astype(np.float64)

    def tau(self) -> np.ndarray:
        return np.minimum(self.best[:, -1], self.bound)

    def run(self, tree: Tree, ids: np.ndarray, vectors: np.ndarray) -> "Search":
        bounds = self.factor * tree.bounds(self.q)
        seen = np.zeros(bounds.shape, dtype=bool)
        first = np.argsort(bounds, axis=1, kind="stable")[:, :FIRST]
        for r in range(first.shape[1]):  # nearest leaves first: they make tau small
            open_ = bounds[np.arange(len(self.q)), first[:, r]] <= self.tau() + _SLACK
            for leaf in np.unique(first[open_, r]):
                at = np.flatnonzero(open_ & (first[:, r] == leaf))
                seen[at, leaf] = True
                self._offer(at, ids[tree.leaves[leaf]], vectors[tree.leaves[leaf]])
        for leaf in np.argsort(bounds.mean(axis=0), kind="stable"):
            at = np.flatnonzero(~seen[:, leaf] & (bounds[:, leaf] <= self.tau() + _SLACK))
            if len(at):
                self._offer(at, ids[tree.leaves[leaf]], vectors[tree.leaves[leaf]])
        return self

    def _offer(self, at: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        for lo in range(0, len(ids), 4096):  # a leaf of equal vectors may be large
            self._merge(at, ids[lo : lo + 4096], vectors[lo : lo + 4096])

    def _merge(self, at: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.pairs += len(at) * len(ids)
        d = np.round(distances(self.q[at], vectors), 6)
        d[self.own[at][:, None] == ids[None]] = np.inf
        better = (d <= np.minimum(self.best[at, -1], self.bound[at])[:, None]) & np.isfinite(d)
        some = better.any(axis=1)
        at, d, better = at[some], d[some], better[some]
        if not len(at):
            return
        # only what may enter is sorted: the candidates of each query, moved to the left
        width = int(better.sum(axis=1).max())
        left = np.argsort(~better, axis=1, kind="stable")[:, :width]
        d = np.c_[self.best[at], np.where(np.take_along_axis(better, left, 1), np.take_along_axis(d, left, 1), np.inf)]
        who = np.c_[self.who[at], ids[left]]
        order = np.lexsort((who, d), axis=1)[:, : self.k]
        self.best[at], self.who[at] = np.take_along_axis(d, order, 1), np.take_along_axis(who, order, 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _stream(dim: int, k: int, factor: float):
    """Searches a sorted stream of (shard, kind, id, v, tau): of every shard first its rows (kind 0), then its queries."""

    def found(shard: int, index: list, queries: list, tree: list) -> pa.RecordBatch:
        if not tree:
            ids, vectors = np.concatenate([i for i, _ in index]), np.concatenate([v for _, v in index])
            tree += [Tree(vectors), ids, vectors]
        own, q, tau = (np.concatenate(x) for x in zip(*queries, strict=True))
        s = Search(q, own, k, factor, tau).run(*tree)
        hit = np.isfinite(s.best)
        row = np.nonzero(hit)[0]
        return pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(s.who[hit]), pa.array(s.best[hit])], names=["id", "neighbour_id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, queries, waiting, tree = None, [], [], 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            shards, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1]), True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if shards[a] != now:
                    if queries and index:
                        yield found(now, index, queries, tree)
                    now, index, queries, waiting, tree = shards[a], [], [], 0, []
                part = batch.slice(a, b - a)
                ids, vectors = part.column("id").to_numpy(), _matrix(part.column("v"), dim)
                if kinds[a] == 0:
                    index.append((ids, vectors))
                    continue
                tau = part.column("tau").to_numpy(zero_copy_only=False)
                for lo in range(0, len(ids), BLOCK):
                    hi = min(lo + BLOCK, len(ids))
                    queries.append((ids[lo:hi], vectors[lo:hi], tau[lo:hi]))
                    waiting += hi - lo
                    if waiting >= BLOCK and index:
                        yield found(now, index, queries, tree)
                        queries, waiting = [], 0
        if queries and index:
            yield found(now, index, queries, tree)

    return run


def _nearest(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest_neighbours(
    table: DataFrame,
    k: int = K,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 1,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the k nearest other vectors of every query, nearest first.

    Queries are the rows whose id is divisible by ``every``; they are searched against all rows. Distances are
    Euclidean, rounded to 6 digits; equal ones are ordered by id. A query with fewer than k others has fewer rows.
    Left out are rows whose id or vector is null, whose vector is empty, has a null or non-finite element or
    another length than most vectors have (the smaller length on a tie). Rows repeated with the same id count
    once: the smallest vector is taken. Extra columns are ignored, whatever their names. An empty table gives an
    empty result. The sample that regions are cut from has at most ``sample_rows`` rows, those with the smallest
    hashes of ids.
    """
    element = table.schema[vector_col].dataType.elementType.simpleString()
    kind = element if element in ("float", "double") else "double"
    vector = F.col("v")
    clean = (
        table.select(common.col(id_col).cast("long").alias("id"), common.col(vector_col).cast(f"array<{kind}>").alias("v"))
        .filter(F.col("id").isNotNull() & (F.size(vector) > 0))
        .filter(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .groupBy("id").agg(F.min("v").alias("v"))
    )
    clean = common.checkpoint(clean)
    spark = table.sparkSession
    sizes = clean.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, rank int, distance double")
    dim, n = sizes["dim"], sizes["count"]
    clean = clean.filter(F.size("v") == dim)
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toPandas()["v"]
    sample = np.stack(sample.to_list()).astype(np.float64)
    regions = max(1, min(-(-n // shard_rows), len(sample) // REGION_SAMPLE))
    router = spark.sparkContext.broadcast(Tree(sample, max(1, -(-len(sample) // regions)), tight=False))

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vectors, region = np.stack(frame["v"].to_list()).astype(np.float64), np.zeros(len(frame), dtype=np.int64)
                for at, r in router.value.reach(vectors, None, factor):
                    region[at] = r
                frame["region"] = region
                yield frame[["region", "id", "v"]]

    placed = clean.mapInPandas(home, f"region long, id long, v array<{kind}>")
    # one row a region, and there are no more regions than sample rows
    counts = {r["region"]: r["count"] for r in placed.groupBy("region").count().collect()}
    parts = [max(1, -(-counts.get(r, 0) // shard_rows)) for r in range(len(router.value.leaves))]
    spread = F.broadcast(spark.createDataFrame(list(enumerate(parts)), "region long, parts long"))
    tasks = min(sum(parts), 100_000)

    def shard(region: Column, part: Column) -> Column:
        return F.shiftleft(region, 32).bitwiseOR(part)

    rows = placed.join(spread, "region").select(
        shard(F.col("region"), F.pmod(F.xxhash64("id"), F.col("parts"))).alias("shard"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("tau"))

    def search(queries: DataFrame) -> DataFrame:
        """queries: region, id, v, tau."""
        each = queries.join(spread, "region").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        asked = each.select(shard(F.col("region"), F.col("part")).alias("shard"), F.lit(1).alias("kind"), "id", "v", "tau")
        stream = rows.unionByName(asked).repartition(tasks, "shard").sortWithinPartitions("shard", "kind", "id")
        return _nearest(stream.mapInArrow(_stream(dim, k, factor), "id long, neighbour_id long, distance double"), k)

    queries = placed.filter(F.col("id") % every == 0)
    first = common.checkpoint(search(queries.withColumn("tau", F.lit(float("inf")))).drop("rank"))
    reached = first.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("tau"))
    known = queries.join(reached, "id", "left").select("region", "id", "v", F.coalesce("tau", F.lit(float("inf"))).alias("tau"))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            vectors, tau = np.stack(frame["v"].to_list()).astype(np.float64), frame["tau"].to_numpy()
            for at, r in router.value.reach(vectors, tau, factor):
                part = frame.iloc[at]
                part = part[part["region"] != r]
                if len(part):
                    yield part.assign(region=r)

    visits = known.mapInPandas(send, f"region long, id long, v array<{kind}>, tau double")
    merged = _nearest(first.unionByName(search(visits).drop("rank")), k)
    return merged.select(F.col("id").alias("vec_id"), "neighbour_id", "rank", "distance")
