"""File events as streams: debouncing, deduplication, routing. Every operator works on batches and streams alike.

Events are (path, change_type, ts). Watermarks default to a minute; later events are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "path string, change_type string, ts timestamp"
PRIORITY = {"deleted": 3, "modified": 2, "created": 1}


def priority(change: Column) -> Column:
    out = F
    for name, value in PRIORITY.items():
        out = out.when(change == name, F.lit(value))
    return out.otherwise(F.lit(0))


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of event rows from JSON lines that land in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def snapshot_events(current: DataFrame, known: DataFrame) -> DataFrame:
    """Events between two listings (path, mtime, size): what polling a folder sees."""
    c = current.select("path", F.struct("mtime", "size").alias("c"))
    k = known.select("path", F.struct("mtime", "size").alias("k"))
    kind = F.when(F.col("k").isNull(), "created").when(F.col("c").isNull(), "deleted").when(F.col("c") != F.col("k"), "modified")
    return c.join(k, "path", "full_outer").select("path", kind.alias("change_type")).filter("change_type is not null")


def watched(events: DataFrame, ignored: tuple[str, ...] = (".git", ".venv", "__pycache__", "node_modules")) -> DataFrame:
    return events.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(n) for n in ignored])))


def debounce(events: DataFrame, gap: str = "500 milliseconds", watermark: str | None = "1 minute", key: str | None = "path") -> DataFrame:
    """(path, change_type, session_start, session_end, n_events): events with less than the gap between them are one.

    In a session a path keeps its change of the highest priority, and of equals the latest. With key=None the
    session runs over all paths: any event puts off all of them, and the paths are listed within.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming and watermark:
        timed = timed.withWatermark("ts", watermark)
    session = F.session_window("ts", gap).alias("s")
    best = F.max_by("change_type", F.struct(priority(F.col("change_type")).alias("p"), F.col("ts"))).alias("change_type")
    if key is not None:
        out = timed.groupBy(F.col(key).alias("path"), session).agg(best, F.count("*").alias("n_events"))
        return out.select("path", "change_type", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")
    whole = timed.groupBy(F.lit(0).alias("all"), session).agg(F.collect_list(F.struct("path", "change_type", "ts")).alias("events"))
    flat = whole.select("s", F.explode("events").alias("e")).select("s", "e.*")
    if events.isStreaming:  # the second aggregation is left to the batch handler
        return flat.select("path", "change_type", "ts", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"))
    out = flat.groupBy("path", "s").agg(best, F.count("*").alias("n_events"))
    return out.select("path", "change_type", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")


def by_priority(events: DataFrame) -> DataFrame:
    """(path, change_type): the change of the highest priority of every path; deleted is never downgraded."""
    return events.groupBy("path").agg(F.max_by("change_type", F.struct(priority(F.col("change_type")).alias("p"), F.col("ts"))).alias("change_type"))


def last_per_path(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(path, change_type): the last change of every path."""
    return events.groupBy("path").agg(F.max_by("change_type", F.struct(*(order or ["ts"]))).alias("change_type"))


def route(events: DataFrame) -> DataFrame:
    """events with action and force: created and modified are indexed, the latter by force; deleted are removed."""
    action = F.when(F.col("change_type").isin("created", "modified"), "index").when(F.col("change_type") == "deleted", "remove")
    return events.withColumn("action", action).withColumn("force", F.col("change_type") == "modified")


def watch(
    events: DataFrame,
    index: Callable[[DataFrame, int], None],
    remove: Callable[[DataFrame, int], None],
    checkpoint: str,
    name: str | None = None,
    gap: str = "500 milliseconds",
    watermark: str = "1 minute",
    available_now: bool = False,
) -> StreamingQuery:
    """Runs index and remove with the routed, deduplicated paths of every micro-batch. Batches come again after a failure
    with the same number, so handlers that overwrite by number are exactly-once."""

    def each(batch: DataFrame, number: int) -> None:
        routed = route(last_per_path(batch, ["session_end"])).persist()
        try:
            index(routed.filter("action = 'index'").select("path", "force"), number)
            remove(routed.filter("action = 'remove'").select("path"), number)
        finally:
            routed.unpersist()

    writer = debounce(watched(events), gap, watermark).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_jsonl(events: DataFrame, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes events as JSON lines as they come."""
    writer = events.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
