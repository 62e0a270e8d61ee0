"""Retrieval metrics of runs (query_id, item, rank) against judgments (query_id, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run with rel (0 or 1) and n_rel, the number of relevant items of the query. Repeated judgments count once."""
    judged = qrels.select("query_id", "item").distinct()
    counts = judged.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    marked = run.join(judged.withColumn("rel", F.lit(1)), ["query_id", "item"], "left")
    return marked.join(counts, "query_id").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, ndcg_k: int = 5, top: int = 3) -> DataFrame:
    """(query_id, recall, precision, acc, ndcg, ap, rr, top_hit, n_rel): acc is 1 if all relevant items are in the first k,
    ap is divided by k, ndcg is at ndcg_k, top_hit tells whether one of the first ``top`` is relevant."""
    h = hits(run, qrels)
    inside = (F.col("rank") <= k) & (F.col("rel") == 1)
    found = F.count(F.when(inside, 1))
    gained = h.withColumn("gain", F.when((F.col("rank") <= ndcg_k) & (F.col("rel") == 1), F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0))
    # relevant items up to each rank, for the average precision
    from pyspark.sql import Window

    upto = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gained = gained.withColumn("prec", F.when(inside, upto / F.col("rank")).otherwise(0.0))
    out = gained.groupBy("query_id").agg(
        F.first("n_rel").alias("n_rel"), found.alias("found"), F.sum("gain").alias("dcg"), F.sum("prec").alias("precs"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_hit"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(ndcg_k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return out.select(
        "query_id", "n_rel",
        F.round(F.col("found") / F.col("n_rel"), 6).alias("recall"), F.round(F.col("found") / k, 6).alias("precision"),
        (F.col("found") == F.col("n_rel")).cast("int").alias("acc"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
        F.round(F.col("precs") / k, 6).alias("ap"), F.round(F.coalesce(1 / F.col("first_hit"), F.lit(0.0)), 6).alias("rr"),
        F.coalesce((F.col("first_hit") <= top).cast("int"), F.lit(0)).alias("top_hit"))


def macro(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over the queries, of all or of each group."""
    names = ("recall", "precision", "acc", "ndcg", "ap", "rr", "top_hit")
    means = [F.round(F.avg(n), 6).alias({"ap": "map", "rr": "mrr", "top_hit": "top_rate"}.get(n, n)) for n in names]
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("n_queries"), F.count(F.when(F.col("recall") == 0, 1)).alias("zero_recall"), *means)


def match_paths(run: DataFrame, expected: DataFrame) -> DataFrame:
    """Judgments by substring: (query_id, item) for run paths that contain an expected path or are contained in it."""
    met = run.join(expected.withColumnRenamed("item", "wanted"), "query_id")
    return met.filter(F.contains("item", "wanted") | F.contains("wanted", "item")).select("query_id", "item").distinct()
