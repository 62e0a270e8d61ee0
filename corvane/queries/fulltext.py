"""Queries of the full-text operators: documents are chunks, benchmark passages are queries, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import fulltext as op
from corvane.queries.base import query, relation

_TOKENS = r"toks AS (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS term FROM chunks)"
_LEN = r"lens AS (SELECT chunk_id, coalesce(len(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')), 0) AS len FROM chunks), corpus AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM lens)"
_TERMS = r"terms AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM queries))"


def _scored(unit: str, tf: str, having: str = "") -> str:
    return f"""
WITH {_TOKENS}, {_LEN}, {_TERMS}, {tf}, df AS (SELECT {unit}, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT query_id, tf.chunk_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
  FROM terms JOIN df USING ({unit}) JOIN tf USING ({unit}) JOIN lens ON lens.chunk_id = tf.chunk_id CROSS JOIN corpus GROUP BY query_id, tf.chunk_id {having})
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 50"""


_TF = "tf AS (SELECT term, chunk_id, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM terms) GROUP BY ALL)"


@query(r"SELECT chunk_id, array_to_string(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'), ' ') AS tokens FROM chunks", ("chunks",))
def tokenize(spark, sf_dir):
    return relation(spark, sf_dir, "chunks").select("chunk_id", F.array_join(T.words(F.col("content")), " ").alias("tokens"))


@query(r"SELECT chunk_id, CAST(coalesce(len(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')), 0) AS BIGINT) AS len FROM chunks", ("chunks",))
def doc_lengths(spark, sf_dir):
    return op.doc_lengths(relation(spark, sf_dir, "chunks"))


@query(
    r"""SELECT term, chunk_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos::INT) AS positions FROM (
SELECT chunk_id, unnest(t) AS term, (generate_subscripts(t, 1) - 1)::VARCHAR AS pos FROM (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS t FROM chunks)) GROUP BY term, chunk_id""",
    ("chunks",))
def postings(spark, sf_dir):
    out = op.postings(op.tokens(relation(spark, sf_dir, "chunks")))
    return out.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(f"WITH {_TOKENS} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM toks GROUP BY term", ("chunks",))
def doc_freq(spark, sf_dir):
    return op.doc_freq(op.tokens(relation(spark, sf_dir, "chunks")))


@query(_scored("term", _TF), ("chunks", "queries"))
def bm25_topk(spark, sf_dir):
    return op.bm25(relation(spark, sf_dir, "chunks"), relation(spark, sf_dir, "queries"))


@query(_scored("term", _TF, "HAVING count(*) = any_value(n_terms)"), ("chunks", "queries"))
def fts_exact(spark, sf_dir):
    return op.bm25(relation(spark, sf_dir, "chunks"), relation(spark, sf_dir, "queries"), match_all=True)


_PREFIX = _scored(
    "prefix",
    "vocab AS (SELECT DISTINCT term FROM toks), heads AS (SELECT DISTINCT prefix FROM terms), of AS (SELECT term, prefix FROM vocab JOIN heads ON starts_with(term, prefix)), "
    "tf AS (SELECT prefix, chunk_id, count(*) AS tf FROM toks JOIN of USING (term) GROUP BY ALL)",
    "HAVING count(*) = any_value(n_terms)").replace("AS term FROM queries", "AS prefix FROM queries").replace("query_id, term, count(*) OVER", "query_id, prefix, count(*) OVER")


@query(_PREFIX, ("chunks", "queries"))
def fts_prefix(spark, sf_dir):
    return op.prefix_search(relation(spark, sf_dir, "chunks"), relation(spark, sf_dir, "queries"))


@query()
def bm25_stemmed(spark, sf_dir):
    """Porter stems are beyond SQL; tests hold the stemmer and the scores against known values."""
    return op.bm25(relation(spark, sf_dir, "chunks"), relation(spark, sf_dir, "queries"), stemmed=True)


@query("SELECT path, chunk_id FROM chunks ANTI JOIN tombstones USING (chunk_id)", ("chunks", "tombstones"))
def delete_by_ids(spark, sf_dir):
    return op.delete_by_ids(relation(spark, sf_dir, "chunks"), relation(spark, sf_dir, "tombstones")).select("path", "chunk_id")


@query(
    """WITH gone AS (SELECT DISTINCT p_brand AS path FROM part JOIN supplier ON s_suppkey = p_partkey WHERE s_acctbal < 0)
SELECT 'symbols' AS name, count(*) AS n FROM symbols WHERE chunk_id NOT IN (SELECT chunk_id FROM symbols s JOIN gone USING (path))
UNION ALL SELECT 'chunks', count(*) FROM (SELECT DISTINCT path, chunk_id FROM symbols) ANTI JOIN gone USING (path)
UNION ALL SELECT 'refs', count(*) FROM refs WHERE from_path NOT IN (SELECT path FROM gone)
UNION ALL SELECT 'edges', count(*) FROM refs WHERE from_path NOT IN (SELECT path FROM gone)""",
    ("symbols", "refs"))
def delete_cascade(spark, sf_dir):
    symbols, refs = relation(spark, sf_dir, "symbols"), relation(spark, sf_dir, "refs")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    gone = symbols.join(supplier.filter("s_acctbal < 0"), F.col("id") == F.col("s_suppkey")).select("path").distinct()
    tables = {
        "chunks": symbols.select("path", "chunk_id").distinct(), "symbols": symbols, "refs": refs,
        "edges": refs.select(F.concat_ws("\t", "from_path", F.lit("function"), "from_name").alias("from_key"), F.col("to_name").alias("to_key"))}
    left = op.delete_path(tables, gone)
    out = None
    for name, t in left.items():
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out
