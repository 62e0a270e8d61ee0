"""Full text counted and scored where chunks are, against joined postings; what is exchanged, by Spark's metrics."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph_scale import most_rows

from corvane.functions import stem
from corvane.operators import fulltext as op
from corvane.operators import vectors
from corvane.operators.best import Best


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(5)
    words = [*"the token tokens tokenization user users uses login pool authenticate authentic running runs".split(), "ñandú", "niño", "ÉCOLE", "x_1", "١٢", "naïve—ish", "日本"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(400)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, " .. "), (903, rows[3][1])], "chunk_id long, content string").repartition(3).cache()


@pytest.fixture(scope="module")
def asked(spark):
    rows = [("a", "the tokens"), ("b", "École ñan"), ("c", "user run"), ("d", "absent"), ("e", None), ("f", "to us 日本 the"), ("g", "x_1 ١٢")]
    return spark.createDataFrame(rows, "query_id string, query string")


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize("match_all", [False, True])
def test_equals_joined_postings(spark, chunks, asked, stemmed, match_all, monkeypatch):
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())
    got = rows(op.bm25(chunks, asked, 20, match_all, stemmed)), rows(op.prefix_search(chunks, asked, 20, stemmed))
    monkeypatch.setattr(op, "PAIRS", 0)
    assert all(got) and got == (rows(op.bm25(chunks, asked, 20, match_all, stemmed)), rows(op.prefix_search(chunks, asked, 20, stemmed)))


def test_only_the_best_are_exchanged(spark, chunks, asked):
    """Neither tokens nor pairs of query and chunk: 20 chunks a query and task at most, out of some 400."""
    for df in (op.bm25(chunks, asked, 5), op.bm25(chunks, asked, 5, stemmed=True), op.prefix_search(chunks, asked, 5, stemmed=True)):
        df.collect()
        assert 0 < most_rows(df) <= 404


def test_repeated_ids_are_joined(spark, asked):
    twice = spark.createDataFrame([(1, "the tokens"), (1, "the tokens"), (2, "the")], "chunk_id long, content string")
    assert op.counted(twice, asked) is None


def test_words_without_endings_stay():
    for word in ("amazon", "relational", "happi", "happy", "goodness", "hopping", "agreed", "controll", "rate", "bolo", "adoption"):
        assert stem.porter(word) == stem._porter(word)


def test_best_ties_and_bounds():
    best = Best(2, 3)
    best.most = 5
    rng = np.random.default_rng(1)
    rows = [(int(q), int(i), int(rng.integers(0, 4))) for i in rng.permutation(50) for q in (0, 1)]
    for lo in range(0, 100, 7):
        part = np.array(rows[lo : lo + 7])
        best.offer(part[:, 0], part[:, 1], part[:, 2])
    query, ids, key = best.found()
    want = [(q, i, s) for of in (0, 1) for q, i, s in sorted((r for r in rows if r[0] == of), key=lambda r: (r[2], r[1]))[:3]]
    assert list(zip(query.tolist(), ids.tolist(), key.tolist(), strict=True)) == want


def test_few_queries_meet_vectors_where_they_are(spark):
    v = spark.range(0, 500, 1, 4).select("id", F.array(*[F.sin(F.col("id") * (j + 1)) for j in range(6)]).cast("array<float>").alias("embedding"))
    q = v.filter("id < 3").withColumnRenamed("id", "query_id")
    for measure, loop in (("hamming", vectors.hamming_topk), ("cosine", vectors.cosine_topk), ("inner", vectors.inner_product_topk)):
        df = vectors.batch_topk(v, q, 10, measure)
        assert {tuple(r) for r in df.select("query_id", "id", "score", "rank").collect()} == {tuple(r) for r in loop(v, q, 10).select("query_id", "id", "score", "rank").collect()}
        assert most_rows(df) <= 500
