"""Queries of the vector operators: all embeddings are the corpus. The mean vector of each label is a query or, in those
whose names end in _all, every embedding is one; these have no SQL, as all pairs of lists are too slow for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import vectors as op
from corvane.plans.lineage import cut
from corvane.queries.base import query, relation, table

#: Mean vectors, rounded so that both engines start from the same numbers.
_Q = """q AS (SELECT label AS query_id, list(m ORDER BY i) AS qv FROM (
SELECT label, i, round(avg(x), 6) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""
_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_SIGN = "list_transform({0}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
_HAMMING = f"(SELECT query_id, id, CAST(list_sum(list_transform(list_zip(v, qv), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS INT) AS score FROM v, q)"
_COSINE = "(SELECT query_id, id, round(1 - list_cosine_similarity(v, qv), 6) AS score FROM v, q)"
_INNER = "(SELECT query_id, id, round(list_cosine_similarity(v, qv), 6) AS score FROM v, q)"


def _top(scored: str, k: int, order: str = "") -> str:
    return f"SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM {scored}) WHERE rank <= {k}"


def _queries(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("ms"))
    return listed.select(F.col("label").alias("query_id"), F.transform("ms", lambda s: s["m"]).alias("embedding"))


@query(f"SELECT vec_id AS id, array_to_string({_SIGN.format('embedding')}, '') AS bits FROM embeddings")
def binary_quantize(spark, sf_dir):
    words = relation(spark, sf_dir, "vectors").select("id", F.size("embedding").alias("n"), op.quantize(F.col("embedding")).alias("w"))
    bits = F.array_join(F.transform("w", lambda w: F.lpad(F.bin(w), 64, "0")), "")
    return words.select("id", "n", bits.alias("all")).select("id", F.expr("left(all, n)").alias("bits"))


@query(f"WITH {_Q}, {_V} {_top(_HAMMING, 200)}")
def hamming_topk(spark, sf_dir):
    return op.hamming_topk(relation(spark, sf_dir, "vectors"), _queries(spark, sf_dir))


@query(f"WITH {_Q}, {_V} {_top(_COSINE, 50)}")
def cosine_topk(spark, sf_dir):
    return op.cosine_topk(relation(spark, sf_dir, "vectors"), _queries(spark, sf_dir))


@query(f"WITH {_Q}, {_V} {_top(_INNER, 50, 'DESC')}")
def inner_product_topk(spark, sf_dir):
    return op.inner_product_topk(relation(spark, sf_dir, "vectors"), _queries(spark, sf_dir))


@query("SELECT vec_id AS id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS i, round(unnest(v) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)")
def l2_normalize(spark, sf_dir):
    unit = relation(spark, sf_dir, "vectors").select("id", op.l2_normalize(op.doubles(F.col("embedding"))).alias("v"))
    return unit.select("id", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_Q}, {_V}, c AS ({_top(_HAMMING, 200)}), f AS ({_top(_COSINE, 50)}), k AS (SELECT f.* FROM f SEMI JOIN c USING (query_id, id)) SELECT * FROM k UNION ALL SELECT * FROM f WHERE query_id NOT IN (SELECT query_id FROM k)")
def vector_funnel(spark, sf_dir):
    return op.vector_search(relation(spark, sf_dir, "vectors"), _queries(spark, sf_dir))


@query(f"WITH {_Q}, {_V}, c AS ({_top(_HAMMING, 200)}), f AS ({_top(_COSINE, 50)}) SELECT query_id, id FROM c INTERSECT SELECT query_id, id FROM f")
def funnel_intersect(spark, sf_dir):
    v, q = relation(spark, sf_dir, "vectors"), _queries(spark, sf_dir)
    return op.hamming_topk(v, q).select("query_id", "id").intersect(op.cosine_topk(v, q).select("query_id", "id"))


@query(f"WITH {_Q}, {_V} SELECT query_id, 'vector' AS source, id AS doc_id, CAST(score AS DOUBLE) AS score, rank FROM ({_top(_HAMMING, 200)})")
def coarse_channel(spark, sf_dir):
    found = op.hamming_topk(relation(spark, sf_dir, "vectors"), _queries(spark, sf_dir))
    return found.select("query_id", F.lit("vector").alias("source"), F.col("id").alias("doc_id"), F.col("score").cast("double").alias("score"), "rank")


@query(f"""WITH {_Q}, {_V}, s AS (SELECT query_id, concat(CASE WHEN label < 5 THEN '_' ELSE '' END, 'term', id) AS name, label >= 5 AS is_public, round(list_cosine_similarity(v, qv), 6) AS score FROM v JOIN embeddings ON vec_id = id, q)
SELECT query_id, name, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM s
WHERE score >= 0.35 AND (is_public OR score >= 0.35 + 0.1) AND NOT contains('about term7', name)) WHERE rank <= 5""")
def cosine_threshold_expand(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    name = F.concat(F.when(F.col("label") < 5, "_").otherwise(""), F.lit("term"), F.col("vec_id"))
    vocabulary = e.select(name.alias("name"), (F.col("label") >= 5).alias("is_public"), "embedding")
    return op.expand_by_cosine(vocabulary, _queries(spark, sf_dir).withColumn("query", F.lit("about term7")))


def _all(spark, sf_dir):
    """Every embedding as a query."""
    return relation(spark, sf_dir, "vectors").withColumnRenamed("id", "query_id")


def _batch(spark, sf_dir, k, measure):
    return op.batch_topk(relation(spark, sf_dir, "vectors"), _all(spark, sf_dir), k, measure)


@query()
def hamming_topk_all(spark, sf_dir):
    return _batch(spark, sf_dir, 200, "hamming")


@query()
def cosine_topk_all(spark, sf_dir):
    return _batch(spark, sf_dir, 50, "cosine")


@query()
def inner_product_topk_all(spark, sf_dir):
    return _batch(spark, sf_dir, 50, "inner")


@query()
def vector_funnel_all(spark, sf_dir):
    # both lists are read twice, for queries with and without a coarse candidate among the exact ones
    return op.funnel(cut(_batch(spark, sf_dir, 200, "hamming")), cut(_batch(spark, sf_dir, 50, "cosine")))


@query()
def funnel_intersect_all(spark, sf_dir):
    coarse, fine = _batch(spark, sf_dir, 200, "hamming"), _batch(spark, sf_dir, 50, "cosine")
    return coarse.select("query_id", "id").intersect(fine.select("query_id", "id"))


@query()
def coarse_channel_all(spark, sf_dir):
    found = _batch(spark, sf_dir, 200, "hamming")
    return found.select("query_id", F.lit("vector").alias("source"), F.col("id").alias("doc_id"), F.col("score").cast("double").alias("score"), "rank")


@query()
def cosine_threshold_expand_all(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    name = F.concat(F.when(F.col("label") < 5, "_").otherwise(""), F.lit("term"), F.col("vec_id"))
    vocabulary = e.select(name.alias("name"), (F.col("label") >= 5).alias("is_public"), "embedding")
    return op.batch_expand(vocabulary, _all(spark, sf_dir).withColumn("query", F.lit("about term7")))
