"""Queries of message and answer operators: conversations and event properties, with code-like text around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import lookups
from corvane.operators import messages as op
from corvane.queries.base import query, relation, table

#: A source file made of every part: the same text in both engines.
_CODE = "concat('import os', chr(10), 'from pkg.', replace(p_name, ' ', '.'), ' import x', chr(10), 'class ', replace(p_name, ' ', '_'), ':', chr(10), '  def _hid', p_size, '(self): pass', chr(10), '  def go', CAST(p_partkey AS VARCHAR(20)), '(self): pass', chr(10), 'import a.', lower(p_type), chr(10))"


def _code(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", F.expr(_CODE).alias("code"))


@query("SELECT p_partkey, concat_ws(' ', replace(p_name, ' ', '_'), CASE WHEN length(concat('go', p_partkey)) > 3 THEN concat('go', p_partkey) END) AS names FROM part")
def extract_defs(spark, sf_dir):
    return _code(spark, sf_dir).select("p_partkey", F.array_join(T.defined_names(F.col("code")), " ").alias("names"))


@query("SELECT p_partkey, concat_ws(' ', concat('pkg.', replace(p_name, ' ', '.')), concat('a.', lower(p_type))) AS modules FROM part")
def extract_imports(spark, sf_dir):
    return _code(spark, sf_dir).select("p_partkey", F.array_join(T.imported_modules(F.col("code")), " ").alias("modules"))


@query("""WITH m AS (SELECT conv_id, turn, concat('src/', lang_, '/f', turn, '.py') AS a, concat('lib', turn % 2, '.go') AS b FROM (SELECT conv_id, turn, left(role, 2) AS lang_ FROM conversations WHERE role = 'assistant')),
u AS (SELECT conv_id, turn, 0 AS pos, a AS path FROM m UNION ALL SELECT conv_id, turn, 1, b FROM m), f AS (SELECT conv_id, path, min({'t': turn, 'p': pos}) AS f FROM u GROUP BY ALL)
SELECT conv_id, path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY f, path) AS INT) AS ord FROM f""")
def extract_paths(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit(" see src/"), F.substring("role", 1, 2), F.lit("/f"), "turn", F.lit(".py and ("), F.lit("lib"), F.col("turn") % 2, F.lit(".go)"))
    return op.paths_of_messages(table(spark, sf_dir, "conversations").withColumn("text", text))


@query("""WITH e AS (SELECT user_id AS conv_id, event_id AS turn, concat(event_type, '/', json_extract_string(props, '$.k'), '.py') AS path FROM events), f AS (SELECT conv_id, path, min(turn) AS f FROM e GROUP BY ALL)
SELECT conv_id, path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY f, path) AS INT) AS ord FROM f""")
def json_paths(spark, sf_dir):
    path = F.concat("event_type", F.lit("/"), F.get_json_object("props", "$.k"), F.lit(".py"))
    text = F.concat(F.lit("["), F.to_json(F.struct(path.alias("path"))), F.lit("]"))
    return op.paths_of_results(table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.lit("tool").alias("role"), text.alias("text")))


#: An answer of a model made of every event: half bare JSON, half JSON within prose.
def _answers(spark, sf_dir):
    body = F.concat(F.lit('{"symbols": ["'), "event_type", F.lit('", "k'), F.get_json_object("props", "$.k"), F.lit('", ""], "concepts": "c'), "user_id", F.lit('", "error_terms": 5, "sub_queries": ["q'), "event_id", F.lit('"]}'))
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("Sure:\n"), body, F.lit("\nDone"))).otherwise(body)
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("find "), "event_type").alias("query"), op.extraction(raw).alias("parts"))


@query("SELECT event_id, concat(event_type, ' k', json_extract_string(props, '$.k')) AS symbols, concat('c', user_id) AS concepts, '' AS error_terms, concat('q', event_id) AS sub_queries FROM events")
def json_normalize(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", *[F.array_join(F.col("parts")[f], " ").alias(f) for f in op.FIELDS])


@query("SELECT event_id, concat_ws('|', concat('find ', event_type), concat('find ', event_type, ' ', event_type, ' k', json_extract_string(props, '$.k')), concat('c', user_id), concat('q', event_id)) AS asked FROM events")
def build_queries(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", F.array_join(op.sub_queries(F.col("query"), F.col("parts")), "|").alias("asked"))


@query(r"SELECT conv_id, turn, regexp_matches(lower(text), '\b(?:and|or)\b.*\b(?:and|or)\b') OR length(text) - length(replace(text, ',', '')) >= 2 AS many FROM conversations")
def fanout_predicate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.many_parts(F.col("text")).alias("many"))


_FOUND = "fo AS (SELECT lang AS query_id, source || CASE WHEN n_chars > 2000 THEN '' ELSE '/short' END AS path, min(doc_id) AS ord FROM documents GROUP BY ALL), ra AS (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (SELECT lang AS query_id, source || CASE WHEN n_chars < 8000 THEN '' ELSE '/long' END AS path, max(n_chars)::DOUBLE AS score FROM documents GROUP BY ALL))"


def _found(spark, sf_dir):
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents")
    found = docs.groupBy(F.col("lang").alias("query_id"), F.concat("source", F.when(F.col("n_chars") > 2000, "").otherwise("/short")).alias("path")).agg(F.min("doc_id").alias("ord"))
    ranked = docs.groupBy(F.col("lang").alias("query_id"), F.concat("source", F.when(F.col("n_chars") < 8000, "").otherwise("/long")).alias("path")).agg(F.max("n_chars").cast("double").alias("score"))
    return found, ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path")))


@query(f"WITH {_FOUND} SELECT query_id, path, CAST(min(prio) AS INT) AS prio, arg_min(ord, prio) AS ord FROM (SELECT query_id, path, 0 AS prio, ord FROM fo UNION ALL SELECT query_id, path, 1, rank FROM ra) GROUP BY ALL")
def ordered_union_dedupe(spark, sf_dir):
    found, ranked = _found(spark, sf_dir)
    return lookups.ordered_union(found, ranked.withColumnRenamed("rank", "ord"))


@query(f"WITH {_FOUND} SELECT fo.query_id, fo.path, coalesce(score, 0) AS score, CAST(0 AS INT) AS prio, ord FROM fo LEFT JOIN ra USING (query_id, path) UNION ALL SELECT query_id, path, score, 1, rank FROM ra ANTI JOIN fo USING (query_id, path)")
def hybrid_merge_fill(spark, sf_dir):
    return lookups.merge_fill(*_found(spark, sf_dir))


@query("SELECT query_id, CAST(task AS INT) AS task, ord, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY task, ord) AS at_ FROM (SELECT lang AS query_id, n_chars % 3 AS task, doc_id AS ord, source AS path, n_chars::DOUBLE AS score FROM documents)) WHERE at_ = 1")
def fanout_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), (F.col("n_chars") % 3).cast("int").alias("task"), F.col("doc_id").alias("ord"), F.col("source").alias("path"), F.col("n_chars").cast("double").alias("score"))
    return lookups.fanout_dedupe(rows)


@query("""WITH p AS (SELECT p_partkey, concat('pkg/', replace(p_name, ' ', '/'), '.py') AS path, p_name FROM part), e AS (SELECT DISTINCT concat('f', p_partkey, '.py') AS from_path, path AS to_path FROM p)
SELECT from_path, to_path, 'import' AS edge_kind, 0.9::DOUBLE AS weight FROM e""")
def history_results(spark, sf_dir):
    files = _code(spark, sf_dir).select(F.concat(F.lit("f"), "p_partkey", F.lit(".py")).alias("path"), F.col("code").alias("content"))
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("pkg/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".py")).alias("path"))
    return op.import_edges(files, paths)
