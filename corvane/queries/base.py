"""Registry of the driver's queries and the relations they stand on, in SQL that Spark and DuckDB both run.

A relation stands for a table of the engine (chunks, symbols, refs, files, ...) over the whole of the given tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_NAME = "concat(replace({0}.p_name, ' ', '_'), '_', CAST({0}.p_partkey AS VARCHAR(20)))"
_KIND = "CASE WHEN p_size < 17 THEN 'class' WHEN p_size < 34 THEN 'function' ELSE 'variable' END"

RELATIONS: dict[str, str] = {
    "chunks": "SELECT doc_id AS chunk_id, source AS path, text AS content FROM {documents}",
    "files": "SELECT concat('docs/', lang, '/', source, '/doc', CAST(doc_id AS VARCHAR(20)), CASE WHEN n_chars < 200 THEN '.PY' WHEN n_chars < 1000 THEN '.min.js' WHEN n_chars < 3000 THEN '.go' ELSE '.txt' END) AS path, text AS content, n_chars AS size FROM {documents}",
    "page_files": "SELECT url AS path, html AS content FROM {pages}",
    "queries": "SELECT item_id AS query_id, text AS query FROM {benchmark}",
    "symbols": f"SELECT CAST(p_partkey AS BIGINT) AS id, {_NAME.format('{part}')} AS name, {_KIND} AS kind, CAST(p_size AS BIGINT) AS chunk_id, p_brand AS path, CAST(p_size AS INT) AS start_line, CAST(p_size + length(p_name) AS INT) AS end_line, CAST(p_partkey AS INT) AS ord FROM {{part}}".replace("{part}.p", "p"),
    "chunk_paths": "SELECT DISTINCT CAST(p_size AS BIGINT) AS chunk_id, concat('file', CAST(p_size AS VARCHAR(20))) AS path FROM {part}",
    "refs": (
        f"SELECT {_NAME.format('a')} AS from_name, a.p_brand AS from_path, {_NAME.format('b')} AS to_name, "
        "CASE l.l_linenumber WHEN 1 THEN 'import' WHEN 2 THEN 'call' WHEN 3 THEN 'inherit' WHEN 4 THEN 'type_ref' ELSE 'mention' END AS ref_kind, "
        "CAST(l.l_linenumber AS INT) AS line, CAST(l.l_partkey AS BIGINT) AS from_symbol_id, CASE WHEN l.l_returnflag = 'A' THEN CAST(l.l_suppkey AS BIGINT) END AS to_symbol_id "
        "FROM {lineitem} l JOIN {part} a ON l.l_partkey = a.p_partkey JOIN {part} b ON l.l_suppkey = b.p_partkey"),
    "graph_queries": f"SELECT CAST(s_suppkey AS BIGINT) AS query_id, CASE WHEN s_acctbal < 3000 THEN concat('find ', {_NAME.format('p')}) ELSE {_NAME.format('p')} END AS query FROM {{supplier}} s JOIN {{part}} p ON s.s_suppkey = p.p_partkey",
    "entity_edges": (
        "SELECT concat('r', CAST(n_regionkey AS VARCHAR(20))) AS from_key, concat('n', CAST(n_nationkey AS VARCHAR(20))) AS to_key, 'import' AS edge_kind, CAST(1 AS DOUBLE) AS weight FROM {nation} "
        "UNION ALL SELECT concat('n', CAST(s_nationkey AS VARCHAR(20))), concat('s', CAST(s_suppkey AS VARCHAR(20))), 'call', CAST(2 AS DOUBLE) FROM {supplier} "
        "UNION ALL SELECT concat('n', CAST(c_nationkey AS VARCHAR(20))), concat('c', CAST(c_custkey AS VARCHAR(20))), 'inherit', CAST(0.5 AS DOUBLE) FROM {customer} "
        "UNION ALL SELECT concat('s', CAST(l_suppkey AS VARCHAR(20))), concat('p', CAST(l_partkey AS VARCHAR(20))), CASE WHEN l_returnflag = 'R' THEN 'call' ELSE 'import' END, CAST(1 AS DOUBLE) FROM {lineitem}"),
    "regions": "SELECT concat('r', CAST(r_regionkey AS VARCHAR(20))) AS start FROM {region}",
    "vectors": "SELECT vec_id AS id, embedding FROM {embeddings}",
    "lists": (
        "SELECT lang AS query_id, 'exact' AS source, doc_id, CAST(n_chars AS DOUBLE) AS score FROM {documents} "
        "UNION ALL SELECT lang, 'vector', doc_id, CAST((doc_id * 7919) % 10007 AS DOUBLE) FROM {documents} "
        "UNION ALL SELECT lang, 'graph', doc_id, CAST(2 * quality + toxic AS DOUBLE) FROM (SELECT DISTINCT doc_id, quality, toxic FROM {labels}) l JOIN (SELECT DISTINCT doc_id, lang FROM {documents}) d USING (doc_id) "
        "UNION ALL SELECT lang, 'other', doc_id, CAST(-doc_id AS DOUBLE) FROM {documents}"),
    "tombstones": "SELECT DISTINCT doc_id AS chunk_id FROM {labels} WHERE toxic = 1",
    "run": "SELECT lang AS query_id, doc_id AS item, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM {documents}",
    "qrels": "SELECT DISTINCT lang AS query_id, d.doc_id AS item FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE quality = 1",
    "current": "SELECT concat('doc', CAST(doc_id AS VARCHAR(20))) AS path, md5(text) AS content_hash, CAST(doc_id AS DOUBLE) AS last_modified, n_chars AS file_size FROM {documents}",
    "known": (
        "SELECT concat('doc', CAST(d.doc_id AS VARCHAR(20))) AS path, CASE WHEN l.toxic = 1 THEN md5(concat(text, '!')) ELSE md5(text) END AS content_hash, "
        "CAST(d.doc_id + 1 - l.quality AS DOUBLE) AS last_modified, n_chars + l.toxic AS file_size FROM {documents} d JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id "
        "UNION ALL SELECT concat('item', CAST(item_id AS VARCHAR(20))), md5(text), CAST(0 AS DOUBLE), CAST(length(text) AS BIGINT) FROM {benchmark}"),
    "file_chunks": "SELECT source AS path, doc_id AS chunk_id FROM {documents}",
    "file_events": "SELECT concat('user', CAST(user_id AS VARCHAR(20))) AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS change_type, ts, event_id FROM {events}",
    "results": "SELECT lang AS query_id, source AS path, doc_id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM {documents}",
    "messages": "SELECT conv_id, turn, role, text FROM {conversations}",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation over the tables of sf_dir; tables are read where they are named, so columns and filters reach the scan."""
    text = RELATIONS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    # names made of parts are many times as large as the columns they are made of, which Catalyst's estimate goes by
    used |= {t: df.hint("merge") for t, df in used.items() if t == "part"}
    return spark.sql(text, **used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ctes(*names: str) -> str:
    """WITH clause of the relations, for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n].format(**{t: t for t in TABLES})})" for n in names) + " "


def query(sql: str | None = None, relations: tuple[str, ...] = ()):
    """Registers a function (spark, sf_dir) -> DataFrame, with DuckDB SQL over the named relations where there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if f.__name__ in REGISTRY:
            raise ValueError(f"{f.__name__} is registered twice")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Spark 4.1 plans a union of equally partitioned lists as partitioned, and adaptive execution may then coalesce
            # one of them only: groups come out twice, or the union fails
            spark.conf.set("spark.sql.unionOutputPartitioning", "false")
            return f(spark, sf_dir)

        REGISTRY[f.__name__] = run
        if sql is not None:
            text = sql.strip()
            with_ = ctes(*relations) if relations else ""
            SQL[f.__name__] = with_[:-1] + ", " + text[5:] if with_ and text[:5].upper() == "WITH " else with_ + text
        return f

    return register
