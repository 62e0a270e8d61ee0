"""Queries of index maintenance: documents are the current files, the labelled ones and the benchmark what is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import maintenance as op
from corvane.queries.base import query, relation, table

_LIVE = "live AS (SELECT DISTINCT d.doc_id AS chunk_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 0)"


def _live(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").filter("toxic = 0").select(F.col("doc_id").alias("chunk_id"))
    return relation(spark, sf_dir, "file_chunks").join(labels, "chunk_id", "left_semi")


@query("""SELECT path, CASE WHEN k.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'removed' WHEN c.last_modified = k.last_modified AND c.file_size = k.file_size THEN 'same' WHEN c.content_hash = k.content_hash THEN 'touched' ELSE 'changed' END AS status
FROM current c FULL JOIN known k USING (path)""".replace("FULL JOIN known k USING (path)", "FULL JOIN known k ON c.path = k.path").replace("SELECT path", "SELECT coalesce(c.path, k.path) AS path"), ("current", "known"))
def sync_diff(spark, sf_dir):
    return op.sync_diff(relation(spark, sf_dir, "current"), relation(spark, sf_dir, "known"))


@query("SELECT c.path FROM current c LEFT JOIN known k ON c.path = k.path WHERE k.path IS NULL OR c.content_hash IS DISTINCT FROM k.content_hash", ("current", "known"))
def needs_update(spark, sf_dir):
    return op.needs_update(relation(spark, sf_dir, "current"), relation(spark, sf_dir, "known")).select("path")


@query("SELECT path FROM known EXCEPT SELECT path FROM current", ("current", "known"))
def removed_files_except(spark, sf_dir):
    return op.removed_files(relation(spark, sf_dir, "known"), relation(spark, sf_dir, "current"))


@query(f"WITH {_LIVE} SELECT chunk_id FROM file_chunks EXCEPT (SELECT chunk_id FROM live UNION SELECT chunk_id FROM tombstones)", ("file_chunks", "tombstones"))
def orphan_except(spark, sf_dir):
    return op.orphans(relation(spark, sf_dir, "file_chunks"), _live(spark, sf_dir), relation(spark, sf_dir, "tombstones"))


@query("SELECT coalesce(max(m), -1) AS max_id, coalesce(max(m), -1) + 1 AS next_id FROM (SELECT max(chunk_id) AS m FROM file_chunks UNION ALL SELECT max(chunk_id) FROM tombstones)", ("file_chunks", "tombstones"))
def max_id_union(spark, sf_dir):
    return op.max_chunk_id(relation(spark, sf_dir, "file_chunks"), relation(spark, sf_dir, "tombstones"))


@query("SELECT path, doc_id AS chunk_ix, row_number() OVER (ORDER BY path, doc_id) - 1 + (SELECT max(item_id) + 1 FROM benchmark) AS chunk_id FROM (SELECT source AS path, doc_id FROM documents)")
def allocate_ids(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("chunk_ix"))
    live = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"))
    return op.allocate_ids(chunks, live, live).select("path", "chunk_ix", "chunk_id")


@query("WITH gone AS (SELECT DISTINCT source AS path FROM documents WHERE lang = 'de') SELECT 'live' AS side, chunk_id FROM file_chunks ANTI JOIN gone USING (path) UNION ALL SELECT 'deleted', chunk_id FROM (SELECT chunk_id FROM tombstones UNION SELECT chunk_id FROM file_chunks SEMI JOIN gone USING (path))", ("file_chunks", "tombstones"))
def tombstone_file(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").filter("lang = 'de'").select(F.col("source").alias("path"))
    live, dead = op.tombstone_files(relation(spark, sf_dir, "file_chunks"), relation(spark, sf_dir, "tombstones"), gone)
    return live.select(F.lit("live").alias("side"), "chunk_id").unionByName(dead.select(F.lit("deleted").alias("side"), "chunk_id"))


@query("SELECT path, chunk_id FROM file_chunks ANTI JOIN tombstones USING (chunk_id)", ("file_chunks", "tombstones"))
def compact(spark, sf_dir):
    return op.compact(relation(spark, sf_dir, "file_chunks"), relation(spark, sf_dir, "tombstones")).select("path", "chunk_id")


@query("SELECT path, change_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS at_ FROM file_events) WHERE at_ = 1", ("file_events",))
def upsert_latest(spark, sf_dir):
    e = relation(spark, sf_dir, "file_events")
    return op.upsert_latest(e.filter("change_type = 'created'"), e.filter("change_type <> 'created'"), ["path"], [F.desc("ts"), F.desc("event_id")]).select("path", "change_type", "event_id")


_ACCESS = "a AS (SELECT concat('user', c_custkey) AS path, max(epoch(ts)) AS last_accessed FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'signup' GROUP BY 1), n AS (SELECT max(epoch(ts)) AS now FROM events)"
_TIER = "CASE WHEN last_accessed IS NULL OR last_accessed < now - 168 * 3600 THEN 'cold' WHEN last_accessed >= now - 24 * 3600 THEN 'hot' ELSE 'warm' END"


def _tiers(spark, sf_dir):
    at = F.col("ts").cast("timestamp").cast("double")
    events = table(spark, sf_dir, "events")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("user"), "c_custkey").alias("path"), F.lit(None).cast("double").alias("last_accessed"))
    accesses = events.filter("event_type = 'signup'").select(F.concat(F.lit("user"), "user_id").alias("path"), at.alias("ts"))
    seen = op.record_access(files, accesses)
    return seen.crossJoin(events.agg(F.max(at).alias("now"))).select("path", op.tier(F.col("last_accessed"), F.col("now")).alias("tier"))


@query(f"WITH {_ACCESS} SELECT path, {_TIER} AS tier FROM a, n")
def classify_tiers(spark, sf_dir):
    return _tiers(spark, sf_dir)


@query(f"WITH {_ACCESS}, t AS (SELECT path, {_TIER} AS tier FROM a, n) SELECT path, CAST(CASE tier WHEN 'hot' THEN 0 WHEN 'cold' THEN 2 ELSE 1 END AS INT) AS priority FROM t")
def tier_order(spark, sf_dir):
    return _tiers(spark, sf_dir).select("path", op.tier_order(F.col("tier")).alias("priority"))


@query()
def shard_route(spark, sf_dir):
    """xxhash64 of the path, seed 42, isn't DuckDB's hash; a test checks that it is stable and covers all shards."""
    return relation(spark, sf_dir, "current").select("path", op.shard_of(F.col("path"), 8).alias("shard"))


@query(f"WITH {_LIVE} SELECT (SELECT count(*) FROM known) AS files, (SELECT count(*) FROM file_chunks SEMI JOIN live USING (chunk_id)) AS chunks, (SELECT count(*) FROM tombstones) AS deleted, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM refs) AS refs", ("known", "file_chunks", "tombstones", "refs"))
def index_status(spark, sf_dir):
    r = lambda n: relation(spark, sf_dir, n)
    return op.status(r("known"), _live(spark, sf_dir), r("tombstones"), r("symbols"), r("refs"))
