"""Semantics of searches and filters that no query with SQL shows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.functions import text as T
from corvane.operators import fulltext
from corvane.plans import search as plan
from corvane.sources import files


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, "a.py", "the cached naïve value of sessions"), (2, "b.py", "caching of a session"), (3, "c.py", "nothing at all here"), (4, "d.py", "cached cached cached")]
    return spark.createDataFrame(rows, "chunk_id long, path string, content string")


def test_search_is_stemmed_and_folded(spark, chunks):
    queries = spark.createDataFrame([(1, "caching sessions"), (2, "naive"), (3, "cach")], "query_id long, query string")
    found = {(r["query_id"], r["chunk_id"]) for r in plan.search(plan.Index(chunks), queries, quality="fast").collect()}
    assert found == {(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (3, 4)}


def test_fast_weighs_exact_more_and_reranks(spark, chunks):
    queries = spark.createDataFrame([(1, "cached")], "query_id long, query string")
    assert plan.FAST_WEIGHTS == {"exact": 0.7, "fuzzy": 0.3}
    fast = plan.search(plan.Index(chunks), queries, Config(rerank_weight=0.0), "fast").collect()
    best = max(fast, key=lambda r: r["score"])
    # without rerank the best fused document has all of its weight
    assert best["rank"] == 1 and best["score"] == pytest.approx(1.0)
    only = plan.search(plan.Index(chunks), queries, Config(rerank_weight=1.0), "fast").collect()
    assert {r["chunk_id"] for r in only} == {r["chunk_id"] for r in fast} and [r["score"] for r in only] != [r["score"] for r in fast]


def test_auto_quality(spark, chunks):
    queries = spark.createDataFrame([(1, "cached")], "query_id long, query string")
    key = lambda df: sorted((r["chunk_id"], r["rank"]) for r in df.collect())
    assert key(plan.search(plan.Index(chunks), queries, quality="auto")) == key(plan.search(plan.Index(chunks), queries, quality="fast"))
    with pytest.raises(ValueError):
        plan.search(plan.Index(chunks), queries, quality="best")


def test_folding(spark):
    row = spark.createDataFrame([("éàüñçøß漢",)], "t string").select(fulltext.fold(F.col("t"))).first()
    assert row[0] == "eaunc" + "øß漢"


def test_excluded_folders(spark):
    paths = ["src/a.py", "node_modules/x.js", "p/x.egg-info/top", "x.egg-info", "egg-info/a", "a/.tox/b", "target/a.rs", "vendor/b.go", "my.eggs/a"]
    got = {r["p"]: r["e"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.excluded_dir(F.col("p")).alias("e")).collect()}
    assert {p for p, e in got.items() if e} == {"node_modules/x.js", "p/x.egg-info/top", "x.egg-info", "a/.tox/b"}


def test_generated_markers_and_parts(spark):
    rows = spark.createDataFrame([("// AUTO GENERATED",), ("// AUTO-GENERATED",), ("// DO NOT EDIT",)], "t string")
    reasons = [r[0] for r in rows.select(files.noise_reason(F.lit("a.go"), F.col("t"), F.length("t"))).collect()]
    assert reasons == ["generated", None, "generated"]
    asked = spark.createDataFrame([("this and that\nor those",), ("this and that or those",)], "t string")
    assert [r[0] for r in asked.select(T.many_parts(F.col("t"))).collect()] == [False, True]


def test_lists_from_the_environment(monkeypatch):
    monkeypatch.setenv("CORVANE_EXCLUDE_DIRS", "a, *.tmp")
    monkeypatch.setenv("CORVANE_TOP_K", "7")
    config = Config.from_env()
    assert config.exclude_dirs == ("a", "*.tmp") and config.top_k == 7
