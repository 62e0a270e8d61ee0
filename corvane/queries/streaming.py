"""Queries of event operators in their batch form; tests hold the streams against it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.queries.base import query, relation
from corvane.sources.files import jsonl
from corvane.streaming import events as op

_PRIO = "CASE change_type WHEN 'deleted' THEN 3 WHEN 'modified' THEN 2 ELSE 1 END"


@query(f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY path ORDER BY ts) + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS fresh FROM file_events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT path, arg_max(change_type, {{'p': {_PRIO}, 't': ts}}) AS change_type, CAST(epoch_us(min(ts)) AS BIGINT) AS started, CAST(epoch_us(max(ts)) + 300000000 AS BIGINT) AS ended, count(*) AS n_events FROM s GROUP BY path, sid""", ("file_events",))
def debounce_sessions(spark, sf_dir):
    out = op.debounce(relation(spark, sf_dir, "file_events"), "5 minutes")
    return out.select("path", "change_type", F.unix_micros("session_start").alias("started"), F.unix_micros("session_end").alias("ended"), "n_events")


@query(f"SELECT path, arg_max(change_type, {{'p': {_PRIO}, 't': ts}}) AS change_type FROM file_events GROUP BY path", ("file_events",))
def event_priority_dedupe(spark, sf_dir):
    return op.by_priority(relation(spark, sf_dir, "file_events"))


@query("SELECT path, arg_max(change_type, {'t': ts, 'e': event_id}) AS change_type FROM file_events GROUP BY path", ("file_events",))
def event_last_per_key(spark, sf_dir):
    return op.last_per_path(relation(spark, sf_dir, "file_events"), ["ts", "event_id"])


@query("SELECT event_id, path, CASE WHEN change_type = 'deleted' THEN 'remove' ELSE 'index' END AS action, change_type = 'modified' AS force FROM file_events", ("file_events",))
def event_route(spark, sf_dir):
    return op.route(relation(spark, sf_dir, "file_events")).select("event_id", "path", "action", "force")


@query("""SELECT concat('{"path":"', path, '","change_type":"', change_type, '","event_id":', event_id, '}') AS json FROM file_events""", ("file_events",))
def events_jsonl(spark, sf_dir):
    return jsonl(relation(spark, sf_dir, "file_events"), ["path", "change_type", "event_id"])
