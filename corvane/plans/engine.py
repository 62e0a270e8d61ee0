"""The public face: build, sync and search an index kept as Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.functions import text as T
from corvane.operators import chunking, fulltext, fusion, graph, lookups, maintenance, messages
from corvane.plans import search as S
from corvane.plans.plugins import Embedder, HashEmbedder, OverlapReranker, Reranker, embed_table
from corvane.plans.store import Store
from corvane.sources import files as sources
from corvane.streaming import events

FILES = "path string, content_hash string, last_modified double, file_size long, tier string, last_accessed double"
CHUNKS = "chunk_id long, path string, chunk_ix int, content string, start_line int, end_line int, language string, chunk_hash string"
SYMBOLS = "id long, chunk_id long, path string, ord int, name string, kind string, start_line int, end_line int, parent_name string, signature string, language string"
REFS = "from_path string, ord int, from_name string, to_name string, ref_kind string, line int, from_symbol_id long, to_symbol_id long"
EDGES = "from_key string, to_key string, edge_kind string, weight double"
VECTORS = "id long, embedding array<float>"
TOMBSTONES = "chunk_id long"
POSTINGS = "term string, chunk_id long, tf long"
LENGTHS = "chunk_id long, len long"


class Engine:
    """Engine(spark, folder) over one warehouse folder; every method that finds something returns a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = Config(), embedder: Embedder | None = None, reranker: Reranker | None = None):
        self.spark, self.config = spark, config
        self.store = Store(spark, folder)
        self.embedder, self.reranker = embedder or HashEmbedder(), reranker or OverlapReranker()

    # ------------------------------------------------------------ tables

    def _read(self, name: str) -> DataFrame:
        schemas = {"files": FILES, "chunks": CHUNKS, "symbols": SYMBOLS, "refs": REFS, "edges": EDGES, "vectors": VECTORS, "tombstones": TOMBSTONES, "postings": POSTINGS, "lengths": LENGTHS}
        return self.store.read(name, schemas[name])

    def live_chunks(self) -> DataFrame:
        return maintenance.compact(self._read("chunks"), self._read("tombstones"))

    def index(self) -> S.Index:
        vectors = self._read("vectors")
        return S.Index(
            self.live_chunks(), vectors if not vectors.isEmpty() else None, self._read("symbols"), self._read("refs"), self._read("edges"),
            self._read("tombstones"), self.inverted(), self.embedder, self.reranker)

    def inverted(self) -> fulltext.Inverted | None:
        """The kept full-text index of the live chunks; None in a folder that was written before there was one."""
        if not (self.store.versions("postings") and self.store.versions("lengths")):
            return None
        tombs = self._read("tombstones")
        return fulltext.Inverted(maintenance.compact(self._read("postings"), tombs), maintenance.compact(self._read("lengths"), tombs))

    def _add_postings(self, fresh: DataFrame) -> None:
        """Adds the postings of new chunks as a segment; the first time those of all chunks."""
        first = self.inverted() is None
        if not first and fresh.isEmpty():
            return
        added = fulltext.inverted((self.live_chunks() if first else fresh).select("chunk_id", "content"))
        keep = self.store.write if first else self.store.append
        keep("postings", added.postings)
        keep("lengths", added.lengths)

    # ------------------------------------------------------------ building

    def listing(self, root: str, glob: str = "*", gitignore: list[tuple[str, str]] | None = None) -> DataFrame:
        """(path, content, content_hash, last_modified, file_size) of the files to index."""
        found = sources.scan(self.spark, root, glob, self.config)
        reason = sources.noise_reason(F.col("path"), F.col("content"), F.col("size"), self.config)
        found = found.filter(reason.isNull())
        if gitignore:
            bad = sources.gitignored(found.select("path"), sources.gitignore_rules(self.spark, gitignore)).filter("ignored").select("path")
            found = found.join(bad, "path", "left_anti")
        return found.select(
            "path", sources.decode(F.col("content")).alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("mtime").alias("last_modified"), F.col("size").alias("file_size"))

    def sync(self, root: str, glob: str = "*", delete_removed: bool = True, with_vectors: bool = True, gitignore: list[tuple[str, str]] | None = None) -> dict[str, int]:
        """Brings the index in line with a folder; returns how many files were new, changed, touched, removed and the same."""
        return self.sync_files(self.listing(root, glob, gitignore), delete_removed, with_vectors)

    def sync_files(self, current: DataFrame, delete_removed: bool = True, with_vectors: bool = True) -> dict[str, int]:
        """sync with a table (path, content, content_hash, last_modified, file_size)."""
        current = current.dropDuplicates(["path"])
        known = self._read("files")
        diff = self.store.write("diff", maintenance.sync_diff(current, known))
        if not delete_removed:
            diff = diff.filter("status <> 'removed'")
        build = current.join(diff.filter("status in ('new', 'changed')").select("path"), "path", "left_semi")
        gone = diff.filter("status in ('changed', 'removed')").select("path")
        old_chunks, tombs = self._read("chunks"), self._read("tombstones")
        tombs = self.store.write("tombstones", tombs.union(maintenance.compact(old_chunks, tombs).join(gone, "path", "left_semi").select("chunk_id")).distinct())
        cut = chunking.chunks(build.select("path", "content"), self.config.max_chunk_chars, self.config.chunk_overlap)
        found_symbols = chunking.symbols(build.select("path", "content"))
        if self.config.chunk_context_header:
            cut = chunking.with_context(cut, found_symbols)
        cut = chunking.tagged(cut).join(build.select("path", "content_hash"), "path")
        cut = cut.withColumn("language", T.detect_language(F.col("path"))).withColumn("chunk_hash", chunking.chunk_hash(F.col("content_hash"), F.col("chunk_ix"))).drop("content_hash")
        fresh = self.store.write("fresh_chunks", maintenance.allocate_ids(cut, old_chunks, tombs).select(*[f.split()[0] for f in CHUNKS.split(", ")]))
        chunks = self.store.write("chunks", old_chunks.unionByName(fresh))
        self._add_postings(fresh)
        if with_vectors:
            self.store.write("vectors", self._read("vectors").unionByName(embed_table(fresh, self.embedder)))
        old_symbols = self._read("symbols").join(gone, "path", "left_anti")
        at = lookups.symbol_chunks(found_symbols, fresh.select("path", "chunk_ix", "chunk_id", "start_line", "end_line")).withColumn("language", T.detect_language(F.col("path")))
        new_symbols = at.withColumn("id", (F.col("chunk_id") * 1_000_000 + F.col("ord")).cast("long"))
        symbols = self.store.write("symbols", old_symbols.unionByName(new_symbols.select(*old_symbols.columns)))
        old_refs = self._read("refs").join(gone.withColumnRenamed("path", "from_path"), "from_path", "left_anti").withColumn("to_symbol_id", F.lit(None).cast("long"))
        new_refs = chunking.references(build.select("path", "content")).withColumn("from_symbol_id", F.lit(None).cast("long")).withColumn("to_symbol_id", F.lit(None).cast("long"))
        refs = graph.resolve_refs(old_refs.unionByName(new_refs), symbols.select("id", "name"))
        refs = self.store.write("refs", refs.select(*old_refs.columns))
        self.store.write("edges", graph.entity_edges(refs, symbols.drop("path"), chunks.select("chunk_id", "path")))
        fresh_files = current.join(diff.filter("status in ('new', 'changed', 'touched')").select("path"), "path", "left_semi")
        before = known.select("path", "tier", "last_accessed")
        # an upsert that keeps tier and access time
        new_files = fresh_files.join(before, "path", "left").select("path", "content_hash", "last_modified", "file_size", F.coalesce("tier", F.lit("warm")).alias("tier"), "last_accessed")
        kept = known.join(diff.filter("status <> 'same'").select("path"), "path", "left_anti") if delete_removed else known.join(fresh_files.select("path"), "path", "left_anti")
        self.store.write("files", kept.unionByName(new_files))
        for name in ("files", "chunks", "symbols", "refs", "edges", "vectors", "tombstones", "diff", "fresh_chunks"):
            self.store.prune(name)
        return {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}

    def index_files_fts_only(self, root: str, glob: str = "*") -> dict[str, int]:
        return self.sync(root, glob, with_vectors=False)

    def remove(self, paths: list[str]) -> None:
        """Tombstones the chunks of files and forgets the files, their symbols and references."""
        gone = self.spark.createDataFrame([(p,) for p in paths], "path string")
        live, tombs = maintenance.tombstone_files(self.live_chunks().select("path", "chunk_id"), self._read("tombstones"), gone)
        self.store.write("tombstones", tombs)
        for name, column in (("files", "path"), ("symbols", "path"), ("refs", "from_path")):
            table = self._read(name)
            self.store.write(name, table.join(gone.withColumnRenamed("path", column), column, "left_anti").select(*table.columns))
        edges = self._read("edges").withColumn("__path", F.split("from_key", "\t")[0])
        self.store.write("edges", edges.join(gone.withColumnRenamed("path", "__path"), "__path", "left_anti").drop("__path"))

    def compact(self) -> None:
        """Drops tombstoned rows from chunks and vectors, then the tombstones."""
        tombs = self._read("tombstones")
        # ids stay above what has been used: the highest one is kept as a tombstone
        top = maintenance.max_chunk_id(self._read("chunks"), tombs).select(F.col("max_id").alias("chunk_id")).filter("chunk_id >= 0")
        top = self.store.write("top_id", top.join(maintenance.compact(self._read("chunks"), tombs), "chunk_id", "left_anti"))
        self.store.write("chunks", maintenance.compact(self._read("chunks"), tombs))
        self.store.write("vectors", maintenance.compact(self._read("vectors"), tombs, "id"))
        kept = self.inverted()
        if kept is not None:
            # segments become one sorted table
            self.store.write("postings", kept.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"))
            self.store.write("lengths", kept.lengths)
            self.store.prune("postings")
            self.store.prune("lengths")
        self.store.write("tombstones", top)

    def record_access(self, accesses: DataFrame) -> None:
        self.store.write("files", maintenance.record_access(self._read("files"), accesses))

    def classify_tiers(self, now: float) -> None:
        tier = maintenance.tier(F.col("last_accessed"), F.lit(now), self.config.hot_hours, self.config.cold_hours)
        self.store.write("files", self._read("files").withColumn("tier", tier))

    # ------------------------------------------------------------ searching

    def _batch(self, queries: str | list[str] | DataFrame) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries
        listed = [queries] if isinstance(queries, str) else queries
        return self.spark.createDataFrame(list(enumerate(listed)), "query_id int, query string")

    def search(self, queries: str | list[str] | DataFrame, quality: str = "thorough", scope: str = "") -> DataFrame:
        found = S.search(self.index(), self._batch(queries), self.config, quality)
        return lookups.scope_filter(found, scope, "post", self.config.top_k).drop("at") if scope else found

    def search_files(self, queries: str | list[str] | DataFrame, quality: str = "thorough", k: int = 10) -> DataFrame:
        return S.search_files(self.index(), self._batch(queries), self.config, quality, k)

    def locate(self, query: str, model: Callable[[str], str] | None = None, k: int = 10) -> DataFrame:
        """(path, rrf, best_score): files for a question; with a model, which answers with JSON, its sub-queries too."""
        asked = self._batch(query)
        if model is not None:
            said = self.spark.createDataFrame([(0, query, model(query))], "query_id int, query string, raw string")
            parts = said.withColumn("parts", messages.extraction(F.col("raw")))
            asked = parts.select(F.posexplode(messages.sub_queries(F.col("query"), F.col("parts"))).alias("query_id", "query"))
        found = S.search_files(self.index(), asked, self.config, "thorough", 2 * k)
        return fusion.multi_query_rrf(found.withColumnRenamed("query_id", "list_id"), self.config.fusion_k, k)

    def match(self, query: str, k: int = 50) -> DataFrame:
        return fulltext.match(self.live_chunks(), query, k, sanitize=self.config.fts_sanitize)

    def symbol(self, name: str, k: int = 10) -> DataFrame:
        return lookups.symbol_search(self._read("symbols"), name, k)

    def refs(self, name: str) -> DataFrame:
        return lookups.cross_refs(self._read("refs"), name)

    def traverse(self, key: str, depth: int = 2) -> DataFrame:
        start = self.spark.createDataFrame([(key,)], "start string")
        return graph.reach(start, graph.collapse(self._read("edges")), depth)

    def regex(self, root: str, pattern: str, k: int = 50) -> DataFrame:
        found = sources.scan(self.spark, root, "*", self.config).select("path", sources.decode(F.col("content")).alias("content"))
        return sources.regex_lines(found, pattern, 50, k)

    def find_files(self, glob: str, k: int = 100) -> DataFrame:
        return sources.find_files(self._read("files"), glob, k)

    def status(self) -> DataFrame:
        return maintenance.status(self._read("files"), self.live_chunks(), self._read("tombstones"), self._read("symbols"), self._read("refs"))

    def watch(self, root: str, event_folder: str, checkpoint: str, available_now: bool = False):
        """Follows events that land as JSON lines in a folder; each micro-batch syncs its files only."""

        def index(paths: DataFrame, number: int) -> None:
            listing = self.listing(root).join(paths.select("path"), "path", "left_semi")
            self.sync_files(listing, delete_removed=False)

        def remove(paths: DataFrame, number: int) -> None:
            gone = [r["path"] for r in paths.collect()]  # a micro-batch of removed paths, bounded by the trigger
            if gone:
                self.remove(gone)

        return events.watch(events.read_events(self.spark, event_folder), index, remove, checkpoint, available_now=available_now)
