"""Lookups, range joins and merges over symbol, reference and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYMBOL_KINDS = ("class", "function", "method", "module")
#: What may be a node of the entity graph.
ENTITY_KINDS = ("file", *SYMBOL_KINDS)


def symbols_by_name(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    out = symbols.filter(F.col("name") == name)
    return out if kind is None else out.filter(F.col("kind") == kind)


def symbols_of_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    return symbols.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def symbol_search(symbols: DataFrame, name: str, k: int = 10) -> DataFrame:
    """Symbols named exactly so or, if there is none, those whose name contains it whatever the case; k at most."""
    exact = symbols.filter(F.col("name") == name)
    like = symbols.filter(F.contains(F.lower("name"), F.lit(name.lower())))
    # the count is one row, so the choice stays inside the plan
    none = exact.agg(F.count("*").alias("n_exact")).filter("n_exact = 0")
    return exact.unionByName(like.crossJoin(none).drop("n_exact")).orderBy("name", "id").limit(k)


def refs_from(refs: DataFrame, name: str) -> DataFrame:
    return refs.filter(F.col("from_name") == name)


def refs_to(refs: DataFrame, name: str) -> DataFrame:
    return refs.filter(F.col("to_name") == name)


def cross_refs(refs: DataFrame, name: str) -> DataFrame:
    """References from and to a name, with their direction."""
    return refs_from(refs, name).withColumn("direction", F.lit("out")).unionByName(refs_to(refs, name).withColumn("direction", F.lit("in")))


def refs_from_each(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs_from for every distinct name of names (name)."""
    return refs.join(names.select(F.col("name").alias("from_name")).distinct(), "from_name", "left_semi")


def refs_to_each(refs: DataFrame, names: DataFrame) -> DataFrame:
    """refs_to for every distinct name of names (name)."""
    return refs.join(names.select(F.col("name").alias("to_name")).distinct(), "to_name", "left_semi")


def cross_refs_each(refs: DataFrame, names: DataFrame) -> DataFrame:
    """(name, ...): cross_refs for every distinct name of names (name)."""
    out = refs_from_each(refs, names).withColumn("name", F.col("from_name")).withColumn("direction", F.lit("out"))
    return out.unionByName(refs_to_each(refs, names).withColumn("name", F.col("to_name")).withColumn("direction", F.lit("in")))


def scope_filter(results: DataFrame, scope: str, mode: str = "post", k: int = 10) -> DataFrame:
    """Results (query_id, path, score, rank) under scope: of the first 3 * k (post), or of all before ranking (pre)."""
    prefix = scope.replace("\\", "/").strip("/") + "/"
    inside = F.startswith(F.translate("path", "\\", "/"), F.lit(prefix))
    rows = results.filter(inside) if mode == "pre" else results.filter(F.col("rank") <= 3 * k).filter(inside)
    order = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def vocabulary(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """(name, kind, is_public): distinct symbols with more than 2 letters, and the stems of path parts that aren't symbols."""
    named = symbols.filter("length(name) > 2").select("name", F.coalesce("kind", F.lit("")).alias("kind")).distinct()
    named = named.withColumn("is_public", ~F.col("name").startswith("_"))
    parts = paths.select("path").distinct().select(F.explode(F.split(F.translate("path", "\\", "/"), "/")).alias("part"))
    stems = parts.select(F.regexp_replace("part", r"\.[^.]*$", "").alias("name")).filter("length(name) > 2").groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    fresh = stems.join(named.select(F.lower("name").alias("low")).distinct(), "low", "left_anti")
    return named.unionByName(fresh.select("name", F.lit("file").alias("kind"), F.lit(True).alias("is_public")))


def symbol_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """symbols (path, ord, start_line, ...) with chunk_id: of the first chunk of the file (path, chunk_ix, chunk_id, start_line,
    end_line) whose lines hold the symbol's start, else of its last chunk."""
    c = chunks.select("path", "chunk_ix", "chunk_id", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    met = symbols.join(c, "path", "left")
    inside = F.col("start_line").between(F.col("c_start"), F.col("c_end"))
    keys = symbols.columns
    out = met.groupBy(*keys).agg(F.min_by("chunk_id", F.when(inside, F.col("chunk_ix"))).alias("first"), F.max_by("chunk_id", "chunk_ix").alias("last"))
    return out.select(*keys, F.coalesce("first", "last").alias("chunk_id"))


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points (path, line, ...) with the name of the innermost symbol around the line; ties keep the first, none gives null."""
    s = symbols.select("path", F.col("name").alias("s_name"), "start_line", "end_line", "ord")
    keys = points.columns
    met = points.join(s, "path", "left")
    inside = F.col("line").between(F.col("start_line"), F.col("end_line"))
    order = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("ord"))
    return met.groupBy(*keys).agg(F.min_by("s_name", F.when(inside, order)).alias("enclosing"))


def overlaps(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(range_id, name) for symbols of the same path that overlap a range (range_id, path, line, end_line)."""
    s = symbols.select("path", "name", F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"))
    met = ranges.join(s, "path").filter(~((F.col("s_end") < F.col("line")) | (F.col("s_start") > F.col("end_line"))))
    return met.select("range_id", "name").distinct()


def entity_chunks(entities: DataFrame, symbols: DataFrame, chunks: DataFrame, k: int = 3) -> DataFrame:
    """(entity_id, chunk_id) of entities (entity_id, file_path, kind, symbol_name, start_line, end_line): a file's are all its
    chunks, a symbol's at most k chunks of the same name, kind and lines in that file."""
    files = entities.filter("kind = 'file'").join(chunks.select(F.col("path").alias("file_path"), "chunk_id"), "file_path").select("entity_id", "chunk_id")
    s = symbols.select(F.col("name").alias("symbol_name"), "kind", "start_line", "end_line", "chunk_id").join(chunks.select("chunk_id", F.col("path").alias("file_path")), "chunk_id")
    met = entities.filter("kind <> 'file'").join(s, ["file_path", "symbol_name", "kind", "start_line", "end_line"])
    order = Window.partitionBy("entity_id").orderBy("chunk_id")
    return files.unionByName(met.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).select("entity_id", "chunk_id"))


def seed_entities(seeds: DataFrame, symbols: DataFrame, chunks: DataFrame, k: int = 25) -> DataFrame:
    """(query_id, key, ord): the file of every seed chunk (query_id, chunk_id, rank) and its symbols, each once. The first symbol
    at place k or behind is the last; files alone don't end the list."""
    met = seeds.join(chunks.select("chunk_id", "path"), "chunk_id")
    files = met.select("query_id", "rank", F.lit(0).cast("long").alias("at"), F.concat_ws("\t", "path", F.lit("file"), F.lit(""), F.lit("0"), F.lit("0")).alias("key"))
    named = met.join(symbols.filter(F.col("kind").isin(*SYMBOL_KINDS)).select("chunk_id", "id", "name", "kind", "start_line", "end_line"), "chunk_id")
    keyed = named.select("query_id", "rank", (F.col("id") + 1).cast("long").alias("at"), F.concat_ws("\t", "path", "kind", "name", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("key"))
    first = files.unionByName(keyed).groupBy("query_id", "key").agg(F.min(F.struct("rank", "at")).alias("f"))
    order = Window.partitionBy("query_id").orderBy("f", "key")
    placed = first.withColumn("ord", F.row_number().over(order))
    last = F.min(F.when((F.col("ord") >= k) & (F.col("f.at") > 0), F.col("ord"))).over(Window.partitionBy("query_id"))
    return placed.withColumn("last", last).filter("last is null or ord <= last").select("query_id", "key", "ord")


def module_paths(modules: DataFrame, paths: DataFrame) -> DataFrame:
    """(module, path): m/o/d.py, else m/o/d/__init__.py, else a file that ends in the last two parts; null if there is none."""
    known = paths.select("path").distinct()
    m = modules.select("module").distinct().withColumn("base", F.translate("module", ".", "/"))
    direct, package = known.withColumnRenamed("path", "direct"), known.withColumnRenamed("path", "package")
    parts = F.split("module", r"\.")
    tail = F.when(F.size(parts) >= 2, F.concat(F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1), F.lit(".py")))
    ends = F.split("path", "/")
    by_tail = known.filter(~F.arrays_overlap(ends, F.array(F.lit(".git"), F.lit("__pycache__")))).filter(F.size(ends) >= 2)
    by_tail = by_tail.withColumn("tail", F.concat(F.element_at(ends, -2), F.lit("/"), F.element_at(ends, -1))).groupBy("tail").agg(F.min("path").alias("by_tail"))
    out = m.withColumn("tail", tail).join(direct, F.concat("base", F.lit(".py")) == F.col("direct"), "left")
    out = out.join(package, F.concat("base", F.lit("/__init__.py")) == F.col("package"), "left").join(by_tail, "tail", "left")
    return out.select("module", F.coalesce("direct", "package", "by_tail").alias("path"))


def merge_fill(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, path, score, prio, ord): found paths (query_id, path, ord) in their order, with the score ranked ones have
    (else 0), then the remaining ranked (query_id, path, score, rank)."""
    first = found.join(ranked.select("query_id", "path", "score"), ["query_id", "path"], "left").select(
        "query_id", "path", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(0).alias("prio"), F.col("ord").cast("long").alias("ord"))
    rest = ranked.join(found.select("query_id", "path"), ["query_id", "path"], "left_anti").select(
        "query_id", "path", "score", F.lit(1).alias("prio"), F.col("rank").cast("long").alias("ord"))
    return first.unionByName(rest)


def ordered_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, path, prio, ord): the paths of both lists (query_id, path, ord), each once, where it stands first."""
    both = first.select("query_id", "path", F.lit(0).alias("prio"), F.col("ord").cast("long").alias("ord")).unionByName(
        second.select("query_id", "path", F.lit(1).alias("prio"), F.col("ord").cast("long").alias("ord")))
    return both.groupBy("query_id", "path").agg(F.min(F.struct("prio", "ord")).alias("f")).select("query_id", "path", "f.prio", "f.ord")


def fanout_dedupe(results: DataFrame) -> DataFrame:
    """One row for each path of results (query_id, task, ord, path, score): the first by task and order."""
    order = Window.partitionBy("query_id", "path").orderBy("task", "ord")
    return results.withColumn("at", F.row_number().over(order)).filter("at = 1").drop("at")


def merge_results(semantic: DataFrame, regex: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, path, line, prio, rank, at): semantic rows first, then regex rows, one for each path and line, k at most."""
    both = semantic.select("query_id", "path", "line", "rank", F.lit(0).alias("prio")).unionByName(regex.select("query_id", "path", "line", "rank", F.lit(1).alias("prio")))
    one = Window.partitionBy("query_id", "path", "line").orderBy("prio", "rank")
    kept = both.withColumn("dup", F.row_number().over(one)).filter("dup = 1").drop("dup")
    order = Window.partitionBy("query_id").orderBy("prio", "rank", "path", "line")
    return kept.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def symbol_candidates(queries: DataFrame, k: int = 12) -> DataFrame:
    """(query_id, name, ord): identifiers of a query that may be symbols, each once whatever the case."""
    from corvane.functions.text import SYMBOL_STOP_WORDS

    tokens = F.regexp_extract_all(F.translate("query", "`", " "), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    each = queries.select("query_id", F.posexplode(tokens).alias("pos", "name"))
    codeish = F.col("name").rlike(r"[A-Z_]") | (F.length("name") >= 4)
    each = each.filter((F.length("name") >= 2) & codeish & ~F.lower("name").isin(*sorted(SYMBOL_STOP_WORDS)))
    first = each.groupBy("query_id", F.lower("name").alias("low")).agg(F.min(F.struct("pos", "name")).alias("f"))
    order = Window.partitionBy("query_id").orderBy("f")
    return first.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= k).select("query_id", F.col("f.name").alias("name"), "ord")


def symbol_channel(queries: DataFrame, symbols: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, chunk_id, score, rank): how many symbols of a chunk a query names."""
    met = symbol_candidates(queries).join(symbols.select("name", "chunk_id"), "name")
    scored = met.filter("chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.count("*").cast("double").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
