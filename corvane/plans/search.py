"""Hybrid search over a batch of queries: channels, adaptive fusion, tombstones, rerank, roll-up; one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.functions import text as T
from corvane.operators import fulltext, fusion, graph, lookups, vectors
from corvane.plans.lineage import cut
from corvane.plans.plugins import Embedder, HashEmbedder, OverlapReranker, Reranker

QUALITIES = ("fast", "balanced", "thorough")
#: What the lists of the fast quality weigh.
FAST_WEIGHTS = {"exact": 0.7, "fuzzy": 0.3}


@dataclass
class Index:
    """The tables that are searched. chunks: (chunk_id, path, content[, start_line, end_line, language]); vectors: (id,
    embedding); symbols, refs, entity_edges as in the graph operators; tombstones: (chunk_id).
    inverted: the kept index of the chunks; without one every search tokenises them."""

    chunks: DataFrame
    vectors: DataFrame | None = None
    symbols: DataFrame | None = None
    refs: DataFrame | None = None
    entity_edges: DataFrame | None = None
    tombstones: DataFrame | None = None
    inverted: fulltext.Inverted | None = None
    embedder: Embedder = field(default_factory=HashEmbedder)
    reranker: Reranker = field(default_factory=OverlapReranker)


def _channel(hits: DataFrame, source: str, id_col: str = "chunk_id") -> DataFrame:
    return hits.select("query_id", F.lit(source).alias("source"), F.col(id_col).alias("doc_id"), F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))


def fts_channels(index: Index, queries: DataFrame, config: Config) -> DataFrame:
    # both lists come from one reading of the chunks
    found = None if index.inverted else fulltext.counted(index.chunks, queries, True, ("exact", "prefix"))
    exact = fulltext.bm25(index.chunks, queries, config.fts_top_k, match_all=True, stemmed=True, kept=index.inverted, found=found)
    fuzzy = fulltext.prefix_search(index.chunks, queries, config.fts_top_k, stemmed=True, kept=index.inverted, found=found)
    return _channel(exact, "exact").unionByName(_channel(fuzzy, "fuzzy"))


def vector_channel(index: Index, queries: DataFrame, config: Config, coarse_only: bool = False) -> DataFrame:
    q = queries.select("query_id", index.embedder.embed(F.col("query")).alias("embedding"))
    table = index.vectors if coarse_only else cut(index.vectors)  # both lists are made of it, and it may be made of the texts
    coarse = vectors.batch_topk(table, q, config.binary_top_k, "hamming")
    if coarse_only:
        return _channel(coarse, "vector", "id")
    return _channel(vectors.funnel(coarse, vectors.batch_topk(table, q, config.ann_top_k, "cosine")), "vector", "id")


def _sent(rows: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Written rows, for the side of a join that goes to all executors, if they are few: counted, not guessed."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def symbol_channel(index: Index, queries: DataFrame, config: Config) -> DataFrame:
    return _channel(lookups.symbol_channel(queries, index.symbols, config.fts_top_k), "symbol")


def graph_channel(index: Index, seeds: DataFrame, config: Config) -> DataFrame:
    """Chunks that references connect to the symbols of the seed chunks; seeds themselves left out."""
    edges = cut(graph.edge_chunks(index.refs, index.symbols).select("from_name", "to_name", "from_chunk", "to_chunk", "ref_kind"))
    named = seeds.select("query_id", F.col("doc_id").alias("chunk_id"), "rank").join(index.symbols.select("chunk_id", "id", "name"), "chunk_id")
    first = fusion.first_by(named, ["query_id", "name"], ["rank", "id"]).select("query_id", F.col("id").alias("symbol_id"), "name", "chunk_id")
    found = cut(graph.traverse(cut(first), edges, None, exclude_seeds=True))
    if config.expand_hops:
        found = graph.one_hop(found, edges, index.symbols)
    found = found.join(seeds.select("query_id", F.col("doc_id").alias("chunk_id")), ["query_id", "chunk_id"], "left_anti")
    return _channel(fulltext.top_k(found, config.fts_top_k), "graph")


def entity_channel(index: Index, seeds: DataFrame, config: Config) -> DataFrame:
    start = lookups.seed_entities(seeds.select("query_id", F.col("doc_id").alias("chunk_id"), "rank"), index.symbols, index.chunks)
    start = cut(start)
    # keys of other kinds, such as variables, are no entities: nothing is reached through them
    known = [T.entity_of_key(F.col(c))["kind"].isin(*lookups.ENTITY_KINDS) for c in ("from_key", "to_key")]
    edges = cut(graph.collapse(index.entity_edges.filter(known[0] & known[1]))).withColumn("edge_ord", F.xxhash64("from_key", "to_key"))
    reached = cut(graph.scored_search(start.select("query_id", F.col("key").alias("node"), F.col("ord").alias("seed_ord")), edges, config.entity_depth))
    e = F.col("e")
    parts = reached.withColumn("e", T.entity_of_key(F.col("node"))).filter("e is not null").select(
        F.col("node").alias("entity_id"), e["file_path"].alias("file_path"), e["kind"].alias("kind"), e["symbol_name"].alias("symbol_name"), e["start_line"].alias("start_line"), e["end_line"].alias("end_line")).distinct()
    at = lookups.entity_chunks(parts, index.symbols, index.chunks).withColumnRenamed("entity_id", "node")
    scored = reached.join(at, "node").groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score"))
    scored = scored.join(seeds.select("query_id", F.col("doc_id").alias("chunk_id")), ["query_id", "chunk_id"], "left_anti")
    return _channel(fulltext.top_k(scored, config.fts_top_k), "entity")


def search(index: Index, queries: DataFrame, config: Config = Config(), quality: str = "thorough", expanded: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, path, score, rank, snippet) of queries (query_id, query), the best top_k of each.

    fast: full text alone, exact lists weighing .7 and prefix lists .3. balanced: also symbols and Hamming distances, with weights
    by the query's intent. thorough: also the two-stage vector channel and the graphs, seeded by the best chunks so far.
    auto: thorough if the index has vectors, else fast. expanded: queries as they were expanded; full text uses the
    original. The symbol channel serves queries that aren't natural language. Fused documents are reranked.
    """
    if quality == "auto":
        quality = "fast" if index.vectors is None or index.vectors.isEmpty() else "thorough"
    if quality not in QUALITIES:
        raise ValueError(f"quality must be auto or one of {QUALITIES}")
    wide = queries if expanded is None else expanded
    intents = queries.select("query_id", T.query_intent(F.col("query")).alias("intent"))
    lists = fts_channels(index, queries, config)
    if quality != "fast" and index.symbols is not None:
        coded = wide.join(intents.filter("intent <> 'natural'").select("query_id"), "query_id", "left_semi")
        lists = lists.unionByName(symbol_channel(index, coded, config))
    if quality != "fast" and index.vectors is not None:
        lists = lists.unionByName(vector_channel(index, wide, config, coarse_only=quality == "balanced"))
    if quality == "thorough" and index.symbols is not None:
        lists = cut(lists.repartition("query_id"))  # seeds, both graphs and the fusion use what has been found so far
        if index.refs is not None:
            lists = lists.unionByName(graph_channel(index, cut(fusion.seeds(lists, config.max_seeds, config.seed_mode)), config))
        if index.entity_edges is not None:
            lists = cut(lists.repartition("query_id"))
            lists = lists.unionByName(entity_channel(index, cut(fusion.seeds(lists, config.max_seeds, config.seed_mode)), config))
    if quality == "fast":
        weights = queries.sparkSession.createDataFrame(list(FAST_WEIGHTS.items()), "source string, weight double")
    else:
        weights = intents.join(fusion.adaptive_weights(queries.sparkSession), "intent").select("query_id", "source", "weight")
    fused = fusion.rrf(lists, weights, config.fusion_k)
    if index.tombstones is not None:
        fused = fusion.tombstone_filter(fused, index.tombstones.select(F.col("chunk_id").alias("doc_id")))
    first = cut(fusion.top(fused, config.rerank_pool))
    # texts are fetched for what is reranked only, which goes to the texts and not they to it
    texts = _sent(first.select("query_id", F.col("doc_id").alias("chunk_id"))).join(index.chunks.select("chunk_id", "content"), "chunk_id").join(wide.select("query_id", "query"), "query_id")
    reranked = texts.select("query_id", F.col("chunk_id").alias("doc_id"), index.reranker.score(F.col("query"), F.col("content")).alias("rerank"))
    first = fusion.blend(first, reranked, config.rerank_pool, config.rerank_weight)
    best = _sent(cut(first.filter(F.col("rank") <= config.top_k).withColumnRenamed("doc_id", "chunk_id")))
    extra = [c for c in ("start_line", "end_line", "language") if c in index.chunks.columns]
    return best.join(index.chunks.select("chunk_id", "path", F.substring("content", 1, 200).alias("snippet"), *extra), "chunk_id").select(
        "query_id", "chunk_id", "path", "score", "rank", "snippet", *extra)


def search_files(index: Index, queries: DataFrame, config: Config = Config(), quality: str = "thorough", k: int = 10) -> DataFrame:
    """(query_id, path, score, best_doc_id, doc_ids, rank): chunk results rolled up by file."""
    from dataclasses import replace

    found = search(index, queries, replace(config, top_k=min(5 * k, 200)), quality)
    return fusion.file_rollup(found.withColumnRenamed("chunk_id", "doc_id"), k)


def expand(queries: DataFrame, vocabulary: DataFrame, symbols: DataFrame, embedder: Embedder, config: Config = Config()) -> DataFrame:
    """(query_id, query) with expansion terms appended.

    Code queries of fewer than 20 words stay. Others get the parts of their identifiers, near names of the vocabulary
    (name, is_public, embedding), which for queries of fewer than 8 words must match a query word, and for longer ones
    the names next to those.
    """
    n = T.word_count(F.col("query"))
    base = queries.select("query_id", "query", n.alias("n"), T.query_intent(F.col("query")).alias("intent"))
    open_ = base.filter("intent <> 'code_symbol' or n >= 20").withColumn("parts", T.expand_identifiers(F.col("query")))
    open_ = open_.withColumn("wide", F.trim(F.concat_ws(" ", "query", F.array_join("parts", " "))))
    q = open_.select("query_id", F.col("wide").alias("query"), embedder.embed(F.col("wide")).alias("embedding"))
    near = vectors.batch_expand(vocabulary, q, config.expansion_top_k, config.expansion_threshold, config.private_margin)
    met = near.join(open_.select("query_id", "n", F.regexp_extract_all(F.lower("query"), F.lit("[a-z]+"), F.lit(0)).alias("ws")), "query_id")
    near = cut(met.filter((F.col("n") >= 8) | T.prefix_match(F.col("name"), F.col("ws"))))
    second = graph.cooccurring(near.filter("n >= 8").select("query_id", "name", "rank"), symbols)
    terms = near.select("query_id", F.lit(0).alias("hop"), "rank", "name").unionByName(second.select("query_id", F.lit(1).alias("hop"), "rank", "name"))
    listed = terms.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "rank", "name"))), lambda t: t["name"]).alias("terms"))
    out = base.join(open_.select("query_id", "parts"), "query_id", "left").join(listed, "query_id", "left")
    none = F.array().cast("array<string>")
    added = F.array_join(F.concat(F.coalesce("parts", none), F.coalesce("terms", none)), " ")
    return out.select("query_id", F.when(added != "", F.concat_ws(" ", "query", added)).otherwise(F.col("query")).alias("query"))
