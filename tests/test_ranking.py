"""Fusion, vectors, graphs, metrics and maintenance on small tables with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from corvane.operators import fusion, graph, lookups, maintenance, metrics, vectors


def test_rrf_equal_weights(spark):
    lists = spark.createDataFrame([(0, s, d, r) for s, l in (("a", [1, 2, 3]), ("b", [1, 3, 2])) for r, d in enumerate(l, 1)], "query_id int, source string, doc_id int, rank int")
    rows = fusion.top(fusion.rrf(lists), 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [1, 2, 3]
    assert rows[0]["score"] == round(1 / 61, 9)
    assert rows[1]["score"] == rows[2]["score"] == round((1 / 62 + 1 / 63) / 2, 9)


def test_missing_weight_keeps_the_document(spark):
    lists = spark.createDataFrame([(0, "odd", 7, 1)], "query_id int, source string, doc_id int, rank int")
    weights = spark.createDataFrame([("exact", 1.0)], "source string, weight double")
    assert fusion.rrf(lists, weights).first()["score"] == 0.0


def test_blend(spark):
    fused = spark.createDataFrame([(0, 7, 0.02), (0, 9, 0.01)], "query_id int, doc_id int, score double")
    reranked = spark.createDataFrame([(0, 7, 0.1), (0, 9, 0.9)], "query_id int, doc_id int, rerank double")
    assert {(r["doc_id"], r["score"], r["rank"]) for r in fusion.blend(fused, reranked).collect()} == {(9, 0.78, 1), (7, 0.37, 2)}


def test_file_rollup(spark):
    rows = spark.createDataFrame([(0, "a", 1, 0.4, 3), (0, "b", 2, 0.9, 1), (0, "a", 3, 0.7, 2)], "query_id int, path string, doc_id int, score double, rank int")
    got = {r["path"]: (r["score"], r["best_doc_id"], sorted(r["doc_ids"]), r["rank"]) for r in fusion.file_rollup(rows, 5).collect()}
    assert got == {"b": (0.9, 2, [2], 1), "a": (0.7, 3, [1, 3], 2)}


def test_quantize(spark):
    row = spark.createDataFrame([([0.5, -1.0, 0.0, 2.0],)], "v array<float>").select(vectors.quantize(F.col("v")).alias("w")).first()
    assert row["w"] == [(0b1001 << 60) - (1 << 64)]
    long = spark.createDataFrame([([1.0] * 65,)], "v array<float>").select(vectors.quantize(F.col("v")).alias("w")).first()
    assert long["w"] == [-1, -(1 << 63)]


def test_funnel_falls_back(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 2.0])], "query_id int, embedding array<float>")
    fine = vectors.cosine_topk(v, q, 2)
    none = spark.createDataFrame([], "query_id int, id int")
    assert vectors.funnel(none, fine).count() == 2
    assert fine.orderBy("rank").first()["id"] == 2


@pytest.mark.parametrize(("kind", "direction", "distance", "score"), [("import", "backward", 1, 1.3), ("call", "forward", 1, 0.9), ("odd", "backward", 1, 0.39)])
def test_edge_score(spark, kind, direction, distance, score):
    got = spark.range(1).select(graph.edge_score(F.lit(kind), F.lit(direction), F.lit(distance)).alias("s")).first()["s"]
    assert math.isclose(got, score)


def test_scored_search(spark):
    edges = spark.createDataFrame([("A", "B", 2.0, 0), ("A", "C", 1.0, 1), ("B", "C", 3.0, 2)], "from_key string, to_key string, weight double, edge_ord int")
    seeds = spark.createDataFrame([(0, "A", 0)], "query_id int, node string, seed_ord int")
    assert {r["node"]: r["score"] for r in graph.scored_search(seeds, edges, 2).collect()} == {"B": 2.0, "C": 4.0}


def test_reach_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "from_key string, to_key string")
    starts = spark.createDataFrame([("a",)], "start string")
    assert {(r["node"], r["depth"]) for r in graph.reach(starts, edges, 3).collect()} == {("b", 1), ("c", 2)}


def test_traverse_import_backward(spark):
    symbols = spark.createDataFrame([(1, "f", 10), (2, "g", 20)], "id long, name string, chunk_id long")
    refs = spark.createDataFrame([("g", "f", "import", None, None)], "from_name string, to_name string, ref_kind string, from_symbol_id long, to_symbol_id long")
    q = spark.createDataFrame([(0, "f")], "query_id int, query string")
    got = {r["chunk_id"]: r["score"] for r in graph.traverse(graph.seeds(q, symbols), graph.edge_chunks(refs, symbols)).collect()}
    assert got == {10: 1.0, 20: 1.3}
    hop = graph.one_hop(spark.createDataFrame([(0, 10, 1.0)], "query_id int, chunk_id long, score double"), graph.edge_chunks(refs.withColumn("ref_kind", F.lit("call")), symbols), symbols)
    assert {r["chunk_id"]: r["score"] for r in hop.collect()} == {10: 1.0, 20: 0.4875}


def test_metrics(spark):
    run = spark.createDataFrame([(0, f"d{i}", i) for i in range(1, 6)], "query_id int, item string, rank int")
    qrels = spark.createDataFrame([(0, "d2"), (0, "d9")], "query_id int, item string")
    m = metrics.per_query(run, qrels).first()
    assert (m["recall"], m["precision"], m["acc"], m["rr"], m["top_hit"]) == (0.5, 0.1, 0, 0.5, 1)
    assert m["ap"] == 0.05
    assert math.isclose(m["ndcg"], (1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs_tol=1e-6)


def test_symbol_chunks(spark):
    chunks = spark.createDataFrame([("p", 0, 100, 1, 10), ("p", 1, 101, 9, 20)], "path string, chunk_ix int, chunk_id long, start_line int, end_line int")
    symbols = spark.createDataFrame([("p", 0, 9), ("p", 1, 30)], "path string, ord int, start_line int")
    assert {r["ord"]: r["chunk_id"] for r in lookups.symbol_chunks(symbols, chunks).collect()} == {0: 100, 1: 101}


def test_max_chunk_id(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "chunk_id long")
    assert tuple(maintenance.max_chunk_id(ids(0, 1, 5), ids(7)).first()) == (7, 8)
    assert tuple(maintenance.max_chunk_id(ids(), ids()).first()) == (-1, 0)


@pytest.mark.parametrize(("hours", "tier"), [(1, "hot"), (48, "warm"), (200, "cold"), (None, "cold")])
def test_tiers(spark, hours, tier):
    at = F.lit(None if hours is None else 1e9 - hours * 3600).cast("double")
    assert spark.range(1).select(maintenance.tier(at, F.lit(1e9)).alias("t")).first()["t"] == tier


def test_shards_are_stable(spark):
    rows = spark.range(1000).select(maintenance.shard_of(F.concat(F.lit("f"), "id"), 8).alias("s")).collect()
    assert {r["s"] for r in rows} == set(range(8))


def test_sync_diff(spark):
    cols = "path string, content_hash string, last_modified double, file_size long"
    current = spark.createDataFrame([("new", "h", 1.0, 1), ("same", "h", 1.0, 1), ("touched", "h", 2.0, 1), ("changed", "i", 2.0, 1)], cols)
    known = spark.createDataFrame([("same", "h", 1.0, 1), ("touched", "h", 1.0, 1), ("changed", "h", 1.0, 1), ("removed", "h", 1.0, 1)], cols)
    assert all(r["path"] == r["status"] for r in maintenance.sync_diff(current, known).collect())
