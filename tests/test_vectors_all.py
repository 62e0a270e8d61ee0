"""Searches in which every embedding is a query, against brute force over the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from corvane.operators import vectors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return [r["vec_id"] for r in rows], [r["label"] for r in rows], (x[:, None] > 0) ^ (x > 0), unit @ unit.T


def best(score, names, k, keep=lambda i, j: True):
    """{query: names in order} by (score, name)."""
    return {i: [names[j] for j in sorted((j for j in range(len(names)) if keep(i, j)), key=lambda j: (score[i, j], names[j]))[:k]] for i in range(len(score))}


def found(spark, name, column="id"):
    rows = driver.queries()[name](spark, SF).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r[column])
    return rows, out


def test_every_row_is_a_query(spark, table):
    ids, _, signs, dot = table
    far, cosine, inner = signs.sum(-1), (1 - dot).round(6), (-dot).round(6)
    coarse, fine = best(far, ids, 200), best(cosine, ids, 50)
    rows, got = found(spark, "hamming_topk_all")
    assert got == {ids[i]: v for i, v in coarse.items()}
    assert all(r["score"] == far[ids.index(r["query_id"]), ids.index(r["id"])] for r in rows[:500])
    rows, got = found(spark, "cosine_topk_all")
    assert got == {ids[i]: v for i, v in fine.items()}
    assert all(r["score"] == cosine[ids.index(r["query_id"]), ids.index(r["id"])] for r in rows[:500])
    assert found(spark, "inner_product_topk_all")[1] == {ids[i]: v for i, v in best(inner, ids, 50).items()}
    both = {ids[i]: [x for x in fine[i] if x in set(coarse[i])] for i in fine}
    assert found(spark, "vector_funnel_all")[1] == {ids[i]: both[ids[i]] or fine[i] for i in fine}
    pairs = driver.queries()["funnel_intersect_all"](spark, SF).collect()
    assert {(r["query_id"], r["id"]) for r in pairs} == {(q, x) for q, v in both.items() for x in v}
    assert found(spark, "coarse_channel_all", "doc_id")[1] == {ids[i]: v for i, v in coarse.items()}


def test_every_row_is_expanded(spark, table):
    ids, labels, _, dot = table
    names = [("_" if label < 5 else "") + f"term{i}" for i, label in zip(ids, labels, strict=True)]
    score = dot.round(6)
    keep = lambda i, j: score[i, j] >= (0.35 if labels[j] >= 5 else 0.35 + 0.1) and names[j] not in "about term7"
    want = {ids[i]: v for i, v in best(-score, names, 5, keep).items() if v}
    assert found(spark, "cosine_threshold_expand_all", "name")[1] == want


@pytest.mark.parametrize("measure", ["hamming", "cosine", "inner"])
def test_batch_equals_nested_loop(spark, measure):
    """Several blocks, ties, odd vectors, other types of ids."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(60)] + [(60, [0.0] * 5)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.select(F.concat(F.lit("q"), "id").alias("query_id"), "embedding")
    loop = {"hamming": vectors.hamming_topk, "cosine": vectors.cosine_topk, "inner": vectors.inner_product_topk}[measure]
    want = {tuple(r) for r in loop(v, q, 7).select("query_id", "id", "score", "rank").collect()}
    odd = spark.createDataFrame([(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("nan")] * 5)], "id long, embedding array<float>")
    assert {tuple(r) for r in vectors.batch_topk(v.unionByName(odd), q, 7, measure, block=10).collect()} == want
    assert vectors.batch_topk(v.limit(0), q, 7, measure).count() == vectors.batch_topk(v, q.limit(0), 7, measure).count() == 0


def test_batch_expand_equals_nested_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(f"Name{i % 50}", i % 3 > 0, [float(x) for x in rng.normal(size=4)]) for i in range(50)]
    v = spark.createDataFrame(rows, "name string, is_public boolean, embedding array<float>")
    q = v.select(F.hash("name").alias("query_id"), F.concat(F.lit("find "), "name").alias("query"), "embedding")
    want = {tuple(r) for r in vectors.expand_by_cosine(v, q).collect()}
    assert want and {tuple(r) for r in vectors.batch_expand(v, q, block=12).collect()} == want


def test_floats_are_sent_as_floats(spark):
    v = spark.range(30).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    plan = lambda t: vectors.batch_topk(t, t.withColumnRenamed("id", "query_id"), 2, "cosine", block=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan(v)
    assert "array<double>" in plan(v.withColumn("embedding", F.col("embedding").cast("array<decimal(9,3)>")))
