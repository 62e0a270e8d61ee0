"""Fusion, reranking and roll-up of ranked lists (query_id, source, doc_id, score[, rank])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOURCES = ("exact", "fuzzy", "vector", "graph", "symbol", "entity")
WEIGHTS = {
    "code_symbol": (0.20, 0.05, 0.20, 0.20, 0.20, 0.15),
    "mixed": (0.15, 0.07, 0.38, 0.20, 0.05, 0.15),
    "natural": (0.08, 0.07, 0.55, 0.15, 0.0, 0.15),
}


def adaptive_weights(spark: SparkSession) -> DataFrame:
    """(intent, source, weight)."""
    rows = [(intent, s, float(w)) for intent, ws in WEIGHTS.items() for s, w in zip(SOURCES, ws, strict=True)]
    return spark.createDataFrame(rows, "intent string, source string, weight double")


def with_ranks(lists: DataFrame, descending: bool = True, by: tuple[str, ...] = ("query_id", "source")) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score") if descending else F.asc("score"), "doc_id")
    return lists.withColumn("rank", F.row_number().over(order))


def rrf(ranked: DataFrame, weights: DataFrame | None = None, k: int = 60) -> DataFrame:
    """(query_id, doc_id, score): sum of weight / (k + rank) over the sources.

    weights: (source, weight), or (query_id, source, weight); a source without one weighs 0, but its documents stay.
    Without weights all sources of a query weigh the same.
    """
    # lists are unions, of which Spark 4.1 may wrongly take rows of a query to be in one place
    ranked = ranked.repartition("query_id")
    if weights is None:
        n = ranked.groupBy("query_id").agg(F.count_distinct("source").alias("n"))
        weighted = ranked.join(n, "query_id").withColumn("weight", 1 / F.col("n"))
    else:
        on = [c for c in ("query_id", "source") if c in weights.columns]
        weighted = ranked.join(weights, on, "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return weighted.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"))


def top(fused: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def seeds(lists: DataFrame, k: int = 10, mode: str = "raw") -> DataFrame:
    """(query_id, doc_id, score): the k documents with the highest score in any source; in mode 'rank' by best rank."""
    value = F.max("score") if mode == "raw" else F.max(-F.col("rank"))
    return top(lists.groupBy("query_id", "doc_id").agg(value.cast("double").alias("score")), k)


def tombstone_filter(fused: DataFrame, tombstones: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return fused.join(tombstones.select(id_col).distinct(), id_col, "left_anti")


def blend(fused: DataFrame, reranked: DataFrame, pool: int = 50, weight: float = 0.7) -> DataFrame:
    """(query_id, doc_id, score, rank): weight * rerank + (1 - weight) * fused / best fused, over the first pool rows.

    reranked: (query_id, doc_id, rerank); a missing rerank score counts as 0.
    """
    first = top(fused.select("query_id", "doc_id", "score"), pool).withColumnRenamed("rank", "before")
    best = F.max("score").over(Window.partitionBy("query_id"))
    share = F.when(best > 0, F.col("score") / best).otherwise(0.0)
    met = first.withColumn("share", share).join(reranked, ["query_id", "doc_id"], "left")
    mixed = met.select("query_id", "doc_id", F.round(weight * F.coalesce("rerank", F.lit(0.0)) + (1 - weight) * F.col("share"), 6).alias("score"))
    return top(mixed, pool)


def inject(fused: DataFrame, structural: DataFrame, pool: int = 50, k: int = 10) -> DataFrame:
    """fused with the k best structural documents that its first pool rows lack, at the pool's median score."""
    first = top(fused.select("query_id", "doc_id", "score"), pool)
    n = F.count("*").over(Window.partitionBy("query_id"))
    median = first.withColumn("n", n).filter(F.col("rank") == F.floor(F.col("n") / 2) + 1).select("query_id", F.col("score").alias("median"))
    missing = top(structural.select("query_id", "doc_id", "score"), k).join(first, ["query_id", "doc_id"], "left_anti")
    added = missing.join(median, "query_id").select("query_id", "doc_id", F.col("median").alias("score"), F.lit(True).alias("injected"))
    return first.select("query_id", "doc_id", "score", F.lit(False).alias("injected")).unionByName(added)


def file_rollup(results: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, path, score, best_doc_id, doc_ids[, rank]) of results (query_id, path, doc_id, score, rank)."""
    best = F.min_by("doc_id", F.struct(-F.col("score"), F.col("rank")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r.doc_id)
    out = results.groupBy("query_id", "path").agg(F.max("score").alias("score"), best.alias("best_doc_id"), ids.alias("doc_ids"))
    if k is None:
        return out
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def multi_query_rrf(lists: DataFrame, k: int = 60, top_k: int | None = None) -> DataFrame:
    """(path, rrf, best_score): unweighted fusion of several file lists (list_id, path, score, rank)."""
    fused = lists.groupBy("path").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rrf"), F.max("score").alias("best_score"))
    return fused if top_k is None else fused.orderBy(F.desc("rrf"), "path").limit(top_k)


def shard_rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Equal-weight fusion over the shards (query_id, shard, doc_id, score); a query met by one shard keeps its scores."""
    ranked = with_ranks(lists.withColumnRenamed("shard", "source"))
    n = F.size(F.collect_set("source").over(Window.partitionBy("query_id")))
    counted = ranked.withColumn("n", n)
    value = F.when(F.max("n") == 1, F.max("score").cast("double")).otherwise(F.sum(1 / F.col("n") / (k + F.col("rank"))))
    return counted.groupBy("query_id", "doc_id").agg(F.round(value, 9).alias("score"))


def first_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of every key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__at", F.row_number().over(w)).filter("__at = 1").drop("__at")


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has: a reranker that needs no model."""
    from corvane.functions.text import words

    asked = F.array_distinct(words(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(text))) / F.size(asked)).otherwise(0.0)
