"""Queries of fusion, roll-up and metrics: languages are queries, documents are ranked by several orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import fusion as op
from corvane.operators import metrics
from corvane.queries.base import query, relation, table

_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS rank FROM lists)"
_WEIGHTS = "w(source, weight) AS (VALUES ('exact', 0.15), ('fuzzy', 0.07), ('vector', 0.38), ('graph', 0.20), ('symbol', 0.05), ('entity', 0.15))"
_FUSED = f"{_RANKED}, {_WEIGHTS}, fused AS (SELECT query_id, doc_id, round(sum(coalesce(weight, 0)::DOUBLE / (60 + rank)), 9) AS score FROM ranked LEFT JOIN w USING (source) GROUP BY ALL)"
_TOP = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {0})"


def _ranked(spark, sf_dir):
    return op.with_ranks(relation(spark, sf_dir, "lists"))


def _fused(spark, sf_dir):
    weights = op.adaptive_weights(spark).filter("intent = 'mixed'").select("source", "weight")
    return op.rrf(_ranked(spark, sf_dir), weights)


@query(f"WITH {_FUSED} SELECT * FROM fused", ("lists",))
def rrf_weighted(spark, sf_dir):
    return _fused(spark, sf_dir)


@query(f"WITH {_RANKED}, n AS (SELECT query_id, count(DISTINCT source) AS n FROM lists GROUP BY 1) SELECT query_id, doc_id, round(sum(1.0::DOUBLE / n / (60 + rank)), 9) AS score FROM ranked JOIN n USING (query_id) GROUP BY ALL", ("lists",))
def rrf_equal(spark, sf_dir):
    return op.rrf(_ranked(spark, sf_dir))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{s}', {w}::DOUBLE)" for i, ws in op.WEIGHTS.items() for s, w in zip(op.SOURCES, ws, strict=True)) + ") t(intent, source, weight)")
def adaptive_weights(spark, sf_dir):
    return op.adaptive_weights(spark)


@query(f"""WITH {_FUSED}, pool AS (SELECT * FROM {_TOP.format('fused')} WHERE rank <= 50), rr AS (SELECT doc_id, max(quality)::DOUBLE AS rerank FROM labels GROUP BY 1),
mixed AS (SELECT query_id, doc_id, round(0.7 * coalesce(rerank, 0) + 0.3 * score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM pool LEFT JOIN rr USING (doc_id))
SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM {_TOP.format('mixed')}""", ("lists",))
def rerank_blend(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("rerank"))
    langs = relation(spark, sf_dir, "lists").select("query_id", "doc_id").distinct()
    return op.blend(_fused(spark, sf_dir), langs.join(labels, "doc_id"))


@query(f"""WITH {_FUSED}, pool AS (SELECT * FROM {_TOP.format('fused')} WHERE rank <= 50), med AS (SELECT p.query_id, score AS median FROM pool p JOIN (SELECT query_id, count(*) AS n FROM pool GROUP BY 1) c ON p.query_id = c.query_id AND rank = n // 2 + 1),
st AS (SELECT query_id, doc_id, score FROM lists WHERE source = 'graph'), miss AS (SELECT query_id, doc_id FROM {_TOP.format('st')} WHERE rank <= 10 EXCEPT SELECT query_id, doc_id FROM pool)
SELECT query_id, doc_id, score, false AS injected FROM pool UNION ALL SELECT query_id, doc_id, median, true FROM miss JOIN med USING (query_id)""", ("lists",))
def median_inject(spark, sf_dir):
    structural = relation(spark, sf_dir, "lists").filter("source = 'graph'").select("query_id", "doc_id", "score")
    return op.inject(_fused(spark, sf_dir), structural)


@query(f"WITH m AS (SELECT query_id, doc_id, max(score) AS score FROM lists GROUP BY ALL) SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM {_TOP.format('m')} WHERE rank <= 10", ("lists",))
def seed_topk(spark, sf_dir):
    return op.seeds(relation(spark, sf_dir, "lists"))


@query(f"WITH {_FUSED} SELECT query_id, doc_id, score FROM fused WHERE doc_id NOT IN (SELECT chunk_id FROM tombstones)", ("lists", "tombstones"))
def tombstone_anti(spark, sf_dir):
    return op.tombstone_filter(_fused(spark, sf_dir), relation(spark, sf_dir, "tombstones").select(F.col("chunk_id").alias("doc_id"))).select("query_id", "doc_id", "score")


@query("SELECT query_id, path, max(score) AS score, arg_min(doc_id, rank) AS best_doc_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids FROM results GROUP BY query_id, path", ("results",))
def file_rollup(spark, sf_dir):
    out = op.file_rollup(relation(spark, sf_dir, "results"))
    return out.withColumn("doc_ids", F.array_join(F.col("doc_ids").cast("array<string>"), ","))


@query("WITH f AS (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (SELECT query_id, path, max(score) AS score FROM results GROUP BY ALL)) SELECT path, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(score) AS best_score FROM f GROUP BY path", ("results",))
def multi_query_rrf(spark, sf_dir):
    lists = op.file_rollup(relation(spark, sf_dir, "results"), 1_000_000_000).withColumnRenamed("query_id", "list_id")
    return op.multi_query_rrf(lists)


@query("WITH r AS (SELECT query_id, path, doc_id, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, doc_id) AS rank FROM results), n AS (SELECT query_id, count(DISTINCT path) AS n FROM results GROUP BY 1) SELECT query_id, doc_id, round(sum(1.0::DOUBLE / n / (60 + rank)), 9) AS score FROM r JOIN n USING (query_id) GROUP BY ALL", ("results",))
def shard_rrf(spark, sf_dir):
    return op.shard_rrf(relation(spark, sf_dir, "results").select("query_id", F.col("path").alias("shard"), "doc_id", "score"))


@query(r"""WITH asked AS (SELECT query_id, query, list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS a FROM queries)
SELECT query_id, chunk_id, round(len(list_intersect(a, regexp_extract_all(lower(content), '[\p{L}\p{N}]+'))) / len(a), 6) AS score FROM asked, chunks WHERE contains(content, query)""", ("queries", "chunks"))
def overlap_rerank(spark, sf_dir):
    """Pairs are the documents that quote a passage whole: a nested loop of the small query batch against the corpus."""
    q, c = relation(spark, sf_dir, "queries"), relation(spark, sf_dir, "chunks")
    met = c.crossJoin(F.broadcast(q) if q.limit(10_001).count() <= 10_000 else q).filter(F.contains("content", "query"))
    return met.select("query_id", "chunk_id", F.round(op.overlap(F.col("query"), F.col("content")), 6).alias("score"))


_HITS = "h AS (SELECT r.query_id, r.item, r.rank, CASE WHEN q.item IS NULL THEN 0 ELSE 1 END AS rel, n_rel FROM run r LEFT JOIN qrels q USING (query_id, item) JOIN (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY 1) c ON r.query_id = c.query_id)"


def _metric(column: str):
    def run(spark, sf_dir):
        return metrics.per_query(relation(spark, sf_dir, "run"), relation(spark, sf_dir, "qrels")).select("query_id", column)

    run.__name__ = f"metric_{ {'ap': 'map', 'rr': 'mrr'}.get(column, column)}"
    return run


for _column, _expression in {
    "recall": "round(count(*) FILTER (rel = 1 AND rank <= 10) / any_value(n_rel), 6)",
    "precision": "round(count(*) FILTER (rel = 1 AND rank <= 10) / 10, 6)",
    "acc": "CAST(count(*) FILTER (rel = 1 AND rank <= 10) = any_value(n_rel) AS INT)",
    "ndcg": "round(sum(CASE WHEN rel = 1 AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum([1 / log2(i + 1) FOR i IN range(1, 1 + least(any_value(n_rel), 5)::BIGINT)]), 6)",
    "rr": "round(coalesce(1.0::DOUBLE / min(rank) FILTER (rel = 1), 0), 6)",
}.items():
    query(f"WITH {_HITS} SELECT query_id, {_expression} AS {_column} FROM h GROUP BY query_id", ("run", "qrels"))(_metric(_column))
query(f"WITH {_HITS}, p AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM h) SELECT query_id, round(sum(CASE WHEN rel = 1 AND rank <= 10 THEN upto / rank ELSE 0 END) / 10, 6) AS ap FROM p GROUP BY query_id", ("run", "qrels"))(_metric("ap"))


@query("""WITH run AS (SELECT source AS query_id, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
qrels AS (SELECT DISTINCT source AS query_id, d.doc_id AS item FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1), """ + _HITS + """,
m AS (SELECT query_id, count(*) FILTER (rel = 1 AND rank <= 10) / any_value(n_rel) AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (rel = 1), 0) AS rr FROM h GROUP BY 1)
SELECT CAST(length(query_id) AS INT) AS category, count(*) AS n_queries, round(avg(round(recall, 6)), 6) AS recall, round(avg(round(rr, 6)), 6) AS mrr FROM m GROUP BY 1""")
def metric_by_category(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    run = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("item"), F.row_number().over(order).alias("rank"))
    qrels = docs.join(labels.filter("quality = 1"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item"))
    per = metrics.per_query(run, qrels).withColumn("category", F.length("query_id"))
    return metrics.macro(per, ["category"]).select("category", "n_queries", "recall", "mrr")
