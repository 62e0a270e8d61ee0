"""Index maintenance: sync diffs, tombstones, compaction, upserts, tiers, shards, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sync_diff(current: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status): new, removed, same (size and time equal), touched (hash equal) or changed.

    Both tables have (path, content_hash, last_modified, file_size). The hash is looked at only where size or time differ.
    """
    c = current.select("path", *[F.col(x).alias(f"c_{x}") for x in ("content_hash", "last_modified", "file_size")], F.lit(1).alias("c"))
    k = known.select("path", *[F.col(x).alias(f"k_{x}") for x in ("content_hash", "last_modified", "file_size")], F.lit(1).alias("k"))
    stat = F.col("c_last_modified").eqNullSafe(F.col("k_last_modified")) & F.col("c_file_size").eqNullSafe(F.col("k_file_size"))
    status = (
        F.when(F.col("k").isNull(), "new").when(F.col("c").isNull(), "removed").when(stat, "same")
        .when(F.col("c_content_hash").eqNullSafe(F.col("k_content_hash")), "touched").otherwise("changed"))
    return c.join(k, "path", "full_outer").select("path", status.alias("status"))


def needs_update(current: DataFrame, known: DataFrame, columns: tuple[str, ...] = ("content_hash",)) -> DataFrame:
    """current rows that known lacks or has with other values in the columns."""
    k = known.select("path", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(1).alias("__k"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return current.join(k, "path", "left").filter(F.col("__k").isNull() | ~same).select(*current.columns)


def removed_files(known: DataFrame, current: DataFrame) -> DataFrame:
    return known.select("path").subtract(current.select("path"))


def orphans(indexed: DataFrame, live: DataFrame, tombstones: DataFrame) -> DataFrame:
    """chunk ids in the index that are neither registered nor tombstoned."""
    return indexed.select("chunk_id").distinct().join(live.select("chunk_id").union(tombstones.select("chunk_id")), "chunk_id", "left_anti")


def tombstone_files(file_chunks: DataFrame, tombstones: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_chunks, tombstones) after marking all chunks of the paths as deleted."""
    gone = file_chunks.join(paths.select("path").distinct(), "path", "left_semi")
    return file_chunks.join(paths.select("path").distinct(), "path", "left_anti"), tombstones.select("chunk_id").union(gone.select("chunk_id")).distinct()


def compact(table: DataFrame, tombstones: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """table without the rows of tombstoned ids."""
    return table.join(tombstones.select(F.col("chunk_id").alias(id_col)).distinct(), id_col, "left_anti")


def max_chunk_id(live: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(max_id, next_id) over live and tombstoned ids; -1 and 0 if there is none."""
    top = live.agg(F.max("chunk_id").alias("m")).unionAll(tombstones.agg(F.max("chunk_id").alias("m")))
    return top.agg(F.coalesce(F.max("m"), F.lit(-1)).cast("long").alias("max_id")).withColumn("next_id", F.col("max_id") + 1)


def allocate_ids(chunks: DataFrame, live: DataFrame, tombstones: DataFrame) -> DataFrame:
    """chunks (path, chunk_ix, ...) with chunk_id: dense, after all ids so far, in order of path and place.

    Counts per path give each path its first id, so rows are numbered inside their path and no task sorts all of them.
    """
    sizes = chunks.groupBy("path").agg(F.count("*").alias("n"))
    running = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
    within = Window.partitionBy("path").orderBy("chunk_ix")
    numbered = chunks.withColumn("__at", F.row_number().over(within) - 1).join(starts.select("path", "before"), "path")
    return numbered.crossJoin(max_chunk_id(live, tombstones)).withColumn("chunk_id", (F.col("next_id") + F.col("before") + F.col("__at")).cast("long")).drop("__at", "before", "max_id", "next_id")


def upsert_latest(table: DataFrame, updates: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """table with updates: of every key the row that comes first in the order."""
    both = table.unionByName(updates, allowMissingColumns=True)
    return both.withColumn("__at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__at = 1").drop("__at")


def record_access(files: DataFrame, accesses: DataFrame) -> DataFrame:
    """files with last_accessed raised to the latest access (path, ts) of each."""
    latest = accesses.groupBy("path").agg(F.max("ts").alias("__ts"))
    return files.join(latest, "path", "left").withColumn("last_accessed", F.greatest("last_accessed", "__ts")).drop("__ts")


def tier(last_accessed: Column, now: Column, hot_hours: float = 24.0, cold_hours: float = 168.0) -> Column:
    """hot, warm or cold by epoch seconds; never accessed is cold."""
    return (
        F.when(last_accessed.isNull() | (last_accessed < now - cold_hours * 3600), "cold")
        .when(last_accessed >= now - hot_hours * 3600, "hot").otherwise("warm"))


def tier_order(tier_col: Column) -> Column:
    """0 hot, 1 warm or unknown, 2 cold."""
    return F.when(tier_col == "hot", 0).when(tier_col == "cold", 2).otherwise(1)


def shard_of(path: Column, shards: int) -> Column:
    """The shard of a path: a stable hash, the same in every process."""
    return F.pmod(F.xxhash64(path), F.lit(shards))


def status(files: DataFrame, live: DataFrame, tombstones: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """One row of counts."""
    out = files.agg(F.count("*").alias("files"))
    for name, table in (("chunks", live), ("deleted", tombstones), ("symbols", symbols), ("refs", refs)):
        out = out.crossJoin(table.agg(F.count("*").alias(name)))
    return out
