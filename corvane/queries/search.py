"""Composite queries: hybrid search in its three qualities over all documents, with all benchmark passages as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.operators import chunking, fulltext, fusion, graph, vectors
from corvane.plans import search as plan
from corvane.plans.plugins import HashEmbedder, embed_table
from corvane.queries.base import query, relation, table
from corvane.queries.fulltext import _LEN, _TERMS, _TF, _TOKENS


def _index(spark: SparkSession, sf_dir: str) -> plan.Index:
    chunks = relation(spark, sf_dir, "chunks")
    embedder = HashEmbedder(64)
    symbols = relation(spark, sf_dir, "symbols")
    refs = relation(spark, sf_dir, "refs").select("from_name", "from_path", "to_name", "ref_kind", "line", "from_symbol_id", "to_symbol_id")
    edges = graph.entity_edges(refs, symbols.drop("path"), chunks.select("chunk_id", "path"))
    return plan.Index(chunks, embed_table(chunks, embedder), symbols, refs, edges, relation(spark, sf_dir, "tombstones"), embedder=embedder)


def _searched(quality: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Embedder and reranker are plug-ins beyond SQL; tests hold the plan against a brute-force version of its parts."""
        return plan.search(_index(spark, sf_dir), relation(spark, sf_dir, "queries"), Config(), quality).drop("snippet")

    run.__name__ = f"search_{quality}"
    return run


for _quality in plan.QUALITIES:
    query()(_searched(_quality))


@query()
def search_files(spark, sf_dir):
    found = plan.search_files(_index(spark, sf_dir), relation(spark, sf_dir, "queries"), Config(), "fast")
    return found.withColumn("doc_ids", F.array_join(F.col("doc_ids").cast("array<string>"), ","))


@query()
def query_expand(spark, sf_dir):
    """All messages, and a question about every supplier's symbol, as queries against the vocabulary of all symbols."""
    embedder = HashEmbedder(64)
    symbols = relation(spark, sf_dir, "symbols")
    vocabulary = symbols.select("name", F.lit(True).alias("is_public"), embedder.embed(F.col("name")).alias("embedding"))
    messages = relation(spark, sf_dir, "messages").select(F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("query_id"), F.col("text").alias("query"))
    about = relation(spark, sf_dir, "graph_queries").select(F.concat(F.lit("q"), "query_id").alias("query_id"), F.concat(F.lit("how does the "), F.replace("query", F.lit("_"), F.lit(" ")), F.lit(" work")).alias("query"))
    return plan.expand(messages.unionByName(about), vocabulary, symbols, embedder)


@query()
def symbol_extract(spark, sf_dir):
    """Symbols of a source file made of every part."""
    code = F.expr("concat('class ', replace(p_name, ' ', '_'), ':', chr(10), '    def go', p_partkey, '(self):', chr(10), '        return make_', p_size, '()', chr(10))")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey", F.lit(".py")).alias("path"), code.alias("content"))
    return chunking.symbols(files)


@query()
def reference_extract(spark, sf_dir):
    code = F.expr("concat('import os', chr(10), 'class ', replace(p_name, ' ', '_'), '(Base):', chr(10), '    def go', p_partkey, '(self):', chr(10), '        return make_', p_size, '()', chr(10))")
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey", F.lit(".py")).alias("path"), code.alias("content"))
    return chunking.references(files)


_BM25 = f"""WITH {_TOKENS}, {_LEN}, {_TERMS}, {_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, tf.chunk_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score
  FROM terms JOIN df USING (term) JOIN tf USING (term) JOIN lens ON lens.chunk_id = tf.chunk_id CROSS JOIN corpus GROUP BY query_id, tf.chunk_id),
fts AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 50),
vs AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
vq AS (SELECT q.query_id, v FROM queries q JOIN vs ON q.query_id = vs.id),
vr AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM (SELECT query_id, vs.id, round(1 - list_cosine_similarity(vs.v, vq.v), 6) AS score FROM vs, vq)) WHERE rank <= 50),
n AS (SELECT query_id, count(DISTINCT s) AS n FROM (SELECT query_id, 'f' AS s FROM fts UNION ALL SELECT query_id, 'v' FROM vr) GROUP BY 1),
fu AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / n / (60 + rank)), 9) AS score FROM (SELECT query_id, chunk_id AS doc_id, rank FROM fts UNION ALL SELECT query_id, id, rank FROM vr) JOIN n USING (query_id) GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu WHERE doc_id NOT IN (SELECT chunk_id FROM tombstones)) WHERE rank <= 10"""


@query(_BM25, ("chunks", "queries", "tombstones"))
def hybrid_search(spark, sf_dir):
    """The flagship: BM25 and cosine lists, reciprocal-rank fusion, tombstones, the ten best of every query."""
    queries = relation(spark, sf_dir, "queries")
    v = relation(spark, sf_dir, "vectors")
    text = fulltext.bm25(relation(spark, sf_dir, "chunks"), queries).select("query_id", F.lit("exact").alias("source"), F.col("chunk_id").alias("doc_id"), "score", "rank")
    asked = queries.join(v, queries["query_id"] == v["id"]).select("query_id", "embedding")
    near = vectors.batch_topk(v, asked, 50, "cosine").select("query_id", F.lit("vector").alias("source"), F.col("id").alias("doc_id"), "score", "rank")
    fused = fusion.rrf(text.unionByName(near))
    gone = relation(spark, sf_dir, "tombstones").select(F.col("chunk_id").alias("doc_id"))
    return fusion.top(fusion.tombstone_filter(fused, gone), 10).select("query_id", "doc_id", "score", "rank")
