"""Graph operators over edge tables: scored traversal, one-hop expansion, breadth-first search, context reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KIND_WEIGHTS = {"call": 1.5, "import": 1.0, "inherit": 0.9, "type_ref": 0.3}
DIRECTION_WEIGHTS = {"backward": 1.3, "forward": 0.6}
UNKNOWN_KIND, UNKNOWN_DIRECTION = 0.3, 0.6
#: One hop more: distance 2 and a decay of a half.
HOP_SHARE = 0.25


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    out = F
    for name, value in table.items():
        out = out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def edge_score(kind: Column, direction: Column, distance: Column) -> Column:
    """weight of the kind * weight of the direction / distance."""
    return _lookup(KIND_WEIGHTS, kind, UNKNOWN_KIND) * _lookup(DIRECTION_WEIGHTS, direction, UNKNOWN_DIRECTION) / distance


def resolve_refs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with to_symbol_id filled, where it is null, by the smallest id of the symbols of that name."""
    first = symbols.groupBy("name").agg(F.min("id").alias("__id"))
    first = spread(first)
    return refs.join(first, refs["to_name"] == first["name"], "left").withColumn("to_symbol_id", F.coalesce("to_symbol_id", "__id")).drop("__id", "name")


def spread(df: DataFrame) -> DataFrame:
    """df, for joins by shuffle: of repetitive names files hold a fraction of their size in memory, so by the size of
    its files a table of symbols passes for one that may be broadcast."""
    return df.hint("merge")


def edge_chunks(refs: DataFrame, symbols: DataFrame, sides: tuple[str, ...] = ("from", "to")) -> DataFrame:
    """refs with from_chunk and to_chunk (or one of them): by symbol id, else of the first symbol of that name."""
    ids = symbols.select("id", "chunk_id")
    first = symbols.groupBy("name").agg(F.min_by("chunk_id", "id").alias("chunk_id"))
    out = refs
    for side in sides:
        by_id = spread(ids.select(F.col("id").alias("__id"), F.lit(False).alias("__none"), F.col("chunk_id").alias("__by_id")))
        by_name = spread(first.select(F.col("name").alias(f"{side}_name"), F.col("chunk_id").alias("__by_name")))
        # rows without an id are spread by their names, or they would all meet in one task
        key = F.coalesce(F.col(f"{side}_symbol_id").cast("long"), F.xxhash64(f"{side}_name"))
        out = out.withColumn("__id", key).withColumn("__none", F.col(f"{side}_symbol_id").isNull()).join(by_id, ["__id", "__none"], "left").drop("__id", "__none").join(by_name, f"{side}_name", "left")
        out = out.withColumn(f"{side}_chunk", F.coalesce("__by_id", "__by_name")).drop("__by_id", "__by_name")
    return out


@dataclass(frozen=True)
class Edges:
    """Edges looked up at their far ends only: forward (from_name, to_chunk, ref_kind), backward (to_name, from_chunk, ref_kind)."""

    forward: DataFrame
    backward: DataFrame


def edge_ends(refs: DataFrame, symbols: DataFrame) -> Edges:
    """edge_chunks() for traversals, which need the chunk of one end a direction."""
    forward, backward = edge_chunks(refs, symbols, ("to",)), edge_chunks(refs, symbols, ("from",))
    return Edges(forward.select("from_name", "to_chunk", "ref_kind"), backward.select("to_name", "from_chunk", "ref_kind"))


def seeds(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, symbol_id, name, chunk_id): symbols named as the whole query or, for queries without one, as a token of it."""
    named = symbols.select(F.col("id").alias("symbol_id"), "name", "chunk_id")
    whole = queries.select("query_id", F.trim("query").alias("name")).join(named, "name")
    tokens = queries.select("query_id", F.split(F.trim("query"), r"\s+").alias("t")).filter("size(t) > 1").select("query_id", F.explode(F.array_distinct("t")).alias("name"))
    tokens = tokens.filter("length(name) >= 2").join(named, "name").join(whole.select("query_id").distinct(), "query_id", "left_anti")
    return whole.unionByName(tokens).select("query_id", "symbol_id", "name", "chunk_id")


def neighbours(seed: DataFrame, edges: DataFrame | Edges, share: float = 1.0) -> DataFrame:
    """(query_id, chunk_id, score) along edges (from_name, to_name, from_chunk, to_chunk, ref_kind): contributions of each seed."""
    ahead, behind = (edges.forward, edges.backward) if isinstance(edges, Edges) else (edges, edges)
    forward = seed.join(ahead, seed["name"] == ahead["from_name"]).select(
        "query_id", F.col("chunk_id").alias("own"), F.col("to_chunk").alias("chunk_id"), (edge_score(F.col("ref_kind"), F.lit("forward"), F.lit(1.0)) * share).alias("score"))
    backward = seed.join(behind, seed["name"] == behind["to_name"]).select(
        "query_id", F.col("chunk_id").alias("own"), F.col("from_chunk").alias("chunk_id"), (edge_score(F.col("ref_kind"), F.lit("backward"), F.lit(1.0)) * share).alias("score"))
    return forward.unionByName(backward).filter("chunk_id is not null and (own is null or own <> chunk_id)").select("query_id", "chunk_id", "score")


def traverse(seed: DataFrame, edges: DataFrame | Edges, k: int | None = None, exclude_seeds: bool = False) -> DataFrame:
    """(query_id, chunk_id, score): 1 for each seed symbol of a chunk and the contributions of the edges to it."""
    base = seed.filter("chunk_id is not null").select("query_id", "chunk_id", F.lit(1.0).alias("score"))
    total = base.unionByName(neighbours(seed, edges)).groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 6).alias("score"))
    if exclude_seeds:
        total = total.join(base.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    if k is None:
        return total
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def one_hop(scored: DataFrame, edges: DataFrame | Edges, symbols: DataFrame) -> DataFrame:
    """scored with the chunks one hop further, at a quarter of their edges' scores; scored chunks keep their score.

    A chunk hands on the same whoever reached it, so edges are added up once for each pair of chunks and not for each query.
    """
    pairs = scored.select("query_id", "chunk_id").distinct()
    names = symbols.select("chunk_id", "name").distinct().join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi")
    steps = neighbours(spread(names.select(F.col("chunk_id").alias("query_id"), "name", "chunk_id")), edges, HOP_SHARE).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
    steps = steps.select(F.col("query_id").alias("own"), F.col("chunk_id").alias("to"), "score")
    further = pairs.withColumnRenamed("chunk_id", "own").join(steps, "own").groupBy("query_id", F.col("to").alias("chunk_id")).agg(F.round(F.sum("score"), 6).alias("score"))
    return scored.select("query_id", "chunk_id", "score").unionByName(further.join(pairs, ["query_id", "chunk_id"], "left_anti"))


def collapse(edges: DataFrame) -> DataFrame:
    """(from_key, to_key, weight): parallel edges of all kinds added up."""
    return edges.groupBy("from_key", "to_key").agg(F.round(F.sum("weight"), 6).alias("weight"))


def upsert_sum(edges: DataFrame, added: DataFrame) -> DataFrame:
    """edges after adding: the weight of an edge (from_key, to_key, edge_kind) accumulates."""
    columns = ["from_key", "to_key", "edge_kind", "weight"]
    both = edges.select(*columns).unionByName(added.select(*columns))
    return both.groupBy("from_key", "to_key", "edge_kind").agg(F.round(F.sum("weight"), 6).alias("weight"))


def entity_edges(refs: DataFrame, symbols: DataFrame, chunk_paths: DataFrame) -> DataFrame:
    """(from_key, to_key, edge_kind, weight): each import, call or inherit reference as edges between files and, where
    the symbols differ, between symbols, both ways, the first symbol of a name standing for it."""
    located = symbols.join(chunk_paths.select("chunk_id", "path"), "chunk_id")
    first = located.groupBy("name").agg(F.min_by(F.struct("path", "kind", "name", "start_line", "end_line"), "id").alias("s"))

    def key(path: Column, kind: Column, name: Column, start: Column, end: Column) -> Column:
        return F.concat_ws("\t", path, kind, name, start.cast("string"), end.cast("string"))

    def of_symbol(s: str) -> Column:
        return key(F.col(f"{s}.path"), F.col(f"{s}.kind"), F.col(f"{s}.name"), F.col(f"{s}.start_line"), F.col(f"{s}.end_line"))

    def of_file(path: Column) -> Column:
        return key(path, F.lit("file"), F.lit(""), F.lit(0), F.lit(0))

    used = refs.filter(F.col("ref_kind").isin("import", "call", "inherit"))
    met = used.join(first.select(F.col("name").alias("from_name"), F.col("s").alias("f")), "from_name", "left").join(
        first.select(F.col("name").alias("to_name"), F.col("s").alias("t")), "to_name")
    pairs = met.select(
        "ref_kind",
        F.explode(F.array(
            F.struct(of_file(F.col("from_path")).alias("a"), of_file(F.col("t.path")).alias("b")),
            F.struct(F.when(F.col("f").isNotNull(), of_symbol("f")).alias("a"), of_symbol("t").alias("b")))).alias("e"))
    pairs = pairs.filter("e.a is not null and e.a <> e.b")
    both = pairs.select("ref_kind", F.explode(F.array(F.struct(F.col("e.a").alias("x"), F.col("e.b").alias("y")), F.struct(F.col("e.b").alias("x"), F.col("e.a").alias("y")))).alias("d"))
    return both.groupBy(F.col("d.x").alias("from_key"), F.col("d.y").alias("to_key"), F.col("ref_kind").alias("edge_kind")).agg(F.count("*").cast("double").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """edges (from_key, to_key, weight) with each one's reverse, self-loops once."""
    reverse = edges.filter("from_key <> to_key").select(F.col("to_key").alias("from_key"), F.col("from_key").alias("to_key"), "weight")
    return edges.select("from_key", "to_key", "weight").unionByName(reverse)


def reach(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): nodes within depth steps of every start at their smallest depth; the start itself left out.

    A level joins only the nodes that the level before has found; what is known is taken out before the next one.
    """
    starts = starts.select("start").distinct()
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    links = edges.select(F.col("from_key").alias("node"), F.col("to_key").alias("next")).distinct()
    for level in range(1, depth + 1):
        step = frontier.join(links, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def scored_search(starts: DataFrame, edges: DataFrame, depth: int = 2, k: int | None = None) -> DataFrame:
    """(query_id, node, score) of edges (from_key, to_key, weight, edge_ord) from seeds (query_id, node, seed_ord).

    A step contributes score of the node before * weight / depth to the node it reaches, unless that is a seed.
    Every node hands on only the contribution of the step that found it first: by order of the node before, then
    of the edge.
    """
    frontier = starts.select("query_id", "node", F.lit(1.0).alias("score"), F.col("seed_ord").cast("long").alias("ord"))
    seen = frontier.select("query_id", "node")
    seeds_only = seen
    gains = None
    for level in range(1, depth + 1):
        e = edges.select(F.col("from_key").alias("node"), F.col("to_key").alias("next"), "weight", "edge_ord")
        step = frontier.join(e, "node").select("query_id", F.col("next").alias("node"), (F.col("score") * F.col("weight") / level).alias("gain"), "ord", "edge_ord")
        step = step.join(seeds_only, ["query_id", "node"], "left_anti")
        gained = step.groupBy("query_id", "node").agg(F.sum("gain").alias("gain"), F.min_by("gain", F.struct("ord", "edge_ord")).alias("score"), F.min(F.struct("ord", "edge_ord")).alias("at"))
        gains = gained.select("query_id", "node", "gain") if gains is None else gains.unionByName(gained.select("query_id", "node", "gain"))
        fresh = gained.join(seen, ["query_id", "node"], "left_anti")
        found = Window.partitionBy("query_id").orderBy("at", "node")
        frontier = fresh.select("query_id", "node", "score", F.row_number().over(found).cast("long").alias("ord"))
        seen = seen.unionByName(frontier.select("query_id", "node"))
    total = gains.groupBy("query_id", "node").agg(F.round(F.sum("gain"), 6).alias("score"))
    if k is None:
        return total
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def related_files(reached: DataFrame, path: Column, k: int | None = None) -> DataFrame:
    """(start, path, node, depth): one row for each other file, with the first of its entities that was reached."""
    located = reached.withColumn("path", path)
    order = Window.partitionBy("start", "path").orderBy("depth", "node")
    out = located.withColumn("at", F.row_number().over(order)).filter("at = 1").select("start", "path", "node", "depth")
    if k is None:
        return out
    rank = Window.partitionBy("start").orderBy("depth", "path")
    return out.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def context(files: DataFrame, edges: DataFrame, max_files: int = 8, max_neighbours: int = 5, max_edges: int = 20) -> DataFrame:
    """(query_id, context): for each query's first files (query_id, path, rank) the strongest neighbours (from_path, to_path,
    kind, name, weight), as text."""
    first = files.filter(F.col("rank") <= max_files)
    met = first.join(edges.filter("from_path <> to_path"), F.col("path") == F.col("from_path"))
    order = Window.partitionBy("query_id", "path").orderBy(F.desc("weight"), "to_path", "name")
    kept = met.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= max_neighbours)
    overall = Window.partitionBy("query_id").orderBy("rank", "at")
    kept = kept.withColumn("all", F.row_number().over(overall)).filter(F.col("all") <= max_edges)
    line = F.when(F.col("name") != "", F.concat_ws("", F.lit("  "), "kind", F.lit(": "), "to_path", F.lit(" :: "), "name")).otherwise(F.concat(F.lit("  file: "), "to_path"))
    sections = kept.groupBy("query_id", "rank", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x.line), "\n").alias("lines"))
    text = F.concat(F.lit("["), "path", F.lit("]\n"), "lines")
    return sections.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x.t), "\n").alias("context"))


def cochange(files: DataFrame, first: int = 8, weight: float = 0.6) -> DataFrame:
    """(from_path, to_path, edge_kind, weight): all pairs of each query's first files (query_id, path, rank)."""
    few = files.filter(F.col("rank") <= first)
    a, b = few.select("query_id", F.col("path").alias("from_path"), F.col("rank").alias("r")), few.select("query_id", F.col("path").alias("to_path"), F.col("rank").alias("s"))
    pairs = a.join(b, "query_id").filter("r < s").groupBy("from_path", "to_path").agg(F.round(F.sum(F.lit(weight)), 6).alias("weight"))
    return pairs.select("from_path", "to_path", F.lit("co_change").alias("edge_kind"), "weight")


def cooccurring(terms: DataFrame, symbols: DataFrame, max_terms: int = 5, max_chunks: int = 30, k: int = 5) -> DataFrame:
    """(query_id, name, rank): other symbols in the chunks of a query's first terms (query_id, name, rank[, query]).

    Queries meet only the beginning of a chunk's names in their order. Before k are found, fewer than k others and the
    query's own terms can stand in the way, so 2 * k and as many as a query has terms are enough of each chunk.
    """
    few = terms.filter(F.col("rank") <= max_terms)
    chunks = few.select("query_id", "name").join(symbols.select("name", "chunk_id"), "name").select("query_id", "chunk_id").distinct()
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    chunks = chunks.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= max_chunks)
    known = terms.select("query_id", F.lower("name").alias("low")).distinct()
    longest = known.groupBy("query_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("longest"))
    listed = symbols.filter((F.length("name") > 2) & F.col("chunk_id").isNotNull() & (F.col("kind").isin("class", "function") | ~F.col("name").startswith("_")))
    listed = listed.groupBy("chunk_id", F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    first = listed.withColumn("place", F.row_number().over(Window.partitionBy("chunk_id").orderBy("name", "low")))
    first = first.crossJoin(F.broadcast(longest)).filter(F.col("place") <= 2 * k + F.col("longest"))
    near = chunks.select("query_id", "chunk_id").join(first.select("chunk_id", "low", "name"), "chunk_id")
    fresh = near.join(known, ["query_id", "low"], "left_anti").groupBy("query_id", "low").agg(F.min(F.struct("chunk_id", "name")).alias("first"))
    pick = Window.partitionBy("query_id").orderBy("first", "low")
    return fresh.withColumn("rank", F.row_number().over(pick)).filter(F.col("rank") <= k).select("query_id", F.col("first.name").alias("name"), "rank")
