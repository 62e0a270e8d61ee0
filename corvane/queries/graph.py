"""Queries of graph operators, lookups and range joins: parts are symbols, line items references, the star schema a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import graph as op
from corvane.operators import lookups
from corvane.queries.base import query, relation, table

_KIND = "CASE ref_kind WHEN 'call' THEN 1.5 WHEN 'import' THEN 1.0 WHEN 'inherit' THEN 0.9 ELSE 0.3 END::DOUBLE"
_EDGES = "edges AS (SELECT r.*, coalesce(f.chunk_id, fn.chunk_id) AS from_chunk, coalesce(t.chunk_id, tn.chunk_id) AS to_chunk FROM refs r LEFT JOIN symbols f ON f.id = from_symbol_id LEFT JOIN symbols fn ON fn.name = from_name LEFT JOIN symbols t ON t.id = to_symbol_id LEFT JOIN symbols tn ON tn.name = to_name)"
_SEEDS = """whole AS (SELECT query_id, s.id AS symbol_id, name, chunk_id FROM graph_queries JOIN symbols s ON trim(query) = name),
toks AS (SELECT DISTINCT query_id, unnest(string_split(trim(query), ' ')) AS name FROM graph_queries WHERE contains(trim(query), ' ')),
seeds AS (SELECT * FROM whole UNION ALL SELECT query_id, s.id, name, chunk_id FROM toks JOIN symbols s USING (name) WHERE length(name) >= 2 AND query_id NOT IN (SELECT query_id FROM whole))"""
_NEAR = f"""near AS (SELECT query_id, to_chunk AS chunk_id, {_KIND} * 0.6 AS score FROM seeds s JOIN edges e ON s.name = e.from_name WHERE to_chunk IS NOT NULL AND to_chunk <> s.chunk_id
UNION ALL SELECT query_id, from_chunk, {_KIND} * 1.3 FROM seeds s JOIN edges e ON s.name = e.to_name WHERE from_chunk IS NOT NULL AND from_chunk <> s.chunk_id)"""
_WALK = f"{_EDGES}, {_SEEDS}, {_NEAR}, walk AS (SELECT query_id, chunk_id, round(sum(score), 6) AS score FROM (SELECT query_id, chunk_id, 1.0::DOUBLE AS score FROM seeds UNION ALL FROM near) GROUP BY ALL)"
_GRAPH = ("symbols", "refs", "graph_queries")


def _rel(spark, sf_dir, *names):
    return [relation(spark, sf_dir, n) for n in names]


def _seeds(spark, sf_dir):
    symbols, queries = _rel(spark, sf_dir, "symbols", "graph_queries")
    return op.seeds(queries, symbols)


def _edges(spark, sf_dir):
    symbols, refs = _rel(spark, sf_dir, "symbols", "refs")
    return op.edge_ends(refs, symbols)


_NAMED = "(SELECT concat(replace(p_name, ' ', '_'), '_', p_partkey) FROM part WHERE p_partkey = 7)"


@query(f"SELECT id, name, kind, chunk_id FROM symbols WHERE name = {_NAMED}", ("symbols",))
def symbol_by_name(spark, sf_dir):
    name = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey = 7").select(F.expr(_NAMED.removeprefix("(SELECT ").split(" FROM ")[0])).first()[0]
    return lookups.symbols_by_name(relation(spark, sf_dir, "symbols"), name).select("id", "name", "kind", "chunk_id")


@query("SELECT id, name FROM (SELECT id, name FROM symbols WHERE contains(lower(name), 'ring') ORDER BY name, id LIMIT 10)", ("symbols",))
def symbol_search(spark, sf_dir):
    return lookups.symbol_search(relation(spark, sf_dir, "symbols"), "Ring").select("id", "name")


_FIRST = "(SELECT concat(replace(p_name, ' ', '_'), '_', p_partkey) FROM part WHERE p_partkey = 0)"


def _name(spark, sf_dir):
    """The name of the first symbol: one row."""
    return relation(spark, sf_dir, "symbols").filter("id = 0").first()["name"]


@query(f"SELECT from_name, to_name, ref_kind, line FROM refs WHERE from_name = {_FIRST}", ("refs",))
def refs_from(spark, sf_dir):
    return lookups.refs_from(relation(spark, sf_dir, "refs"), _name(spark, sf_dir)).select("from_name", "to_name", "ref_kind", "line")


@query(f"SELECT from_name, to_name, ref_kind, line FROM refs WHERE to_name = {_FIRST}", ("refs",))
def refs_to(spark, sf_dir):
    return lookups.refs_to(relation(spark, sf_dir, "refs"), _name(spark, sf_dir)).select("from_name", "to_name", "ref_kind", "line")


@query(f"SELECT from_name, to_name, ref_kind, line, 'out' AS direction FROM refs WHERE from_name = {_FIRST} UNION ALL SELECT from_name, to_name, ref_kind, line, 'in' FROM refs WHERE to_name = {_FIRST}", ("refs",))
def cross_refs(spark, sf_dir):
    return lookups.cross_refs(relation(spark, sf_dir, "refs"), _name(spark, sf_dir)).select("from_name", "to_name", "ref_kind", "line", "direction")


@query("SELECT from_name, to_name, ref_kind, line FROM refs WHERE from_name IN (SELECT name FROM symbols)", ("refs", "symbols"))
def refs_from_all(spark, sf_dir):
    """From the names of all symbols."""
    symbols, refs = _rel(spark, sf_dir, "symbols", "refs")
    return lookups.refs_from_each(refs, symbols).select("from_name", "to_name", "ref_kind", "line")


@query("SELECT from_name, to_name, ref_kind, line FROM refs WHERE to_name IN (SELECT name FROM symbols)", ("refs", "symbols"))
def refs_to_all(spark, sf_dir):
    symbols, refs = _rel(spark, sf_dir, "symbols", "refs")
    return lookups.refs_to_each(refs, symbols).select("from_name", "to_name", "ref_kind", "line")


@query("SELECT from_name AS name, from_name, to_name, ref_kind, line, 'out' AS direction FROM refs WHERE from_name IN (SELECT name FROM symbols) UNION ALL SELECT to_name, from_name, to_name, ref_kind, line, 'in' FROM refs WHERE to_name IN (SELECT name FROM symbols)", ("refs", "symbols"))
def cross_refs_all(spark, sf_dir):
    symbols, refs = _rel(spark, sf_dir, "symbols", "refs")
    return lookups.cross_refs_each(refs, symbols).select("name", "from_name", "to_name", "ref_kind", "line", "direction")


@query("SELECT from_name, to_name, line, coalesce(to_symbol_id, s.id) AS to_symbol_id FROM refs LEFT JOIN symbols s ON s.name = to_name", ("refs", "symbols"))
def resolve_refs(spark, sf_dir):
    symbols, refs = _rel(spark, sf_dir, "symbols", "refs")
    return op.resolve_refs(refs, symbols).select("from_name", "to_name", "line", "to_symbol_id")


@query(f"WITH {_EDGES} SELECT from_name, to_name, line, from_chunk, to_chunk FROM edges", ("refs", "symbols"))
def resolve_edge_chunk(spark, sf_dir):
    symbols, refs = _rel(spark, sf_dir, "symbols", "refs")
    return op.edge_chunks(refs, symbols).select("from_name", "to_name", "line", "from_chunk", "to_chunk")


@query(f"SELECT ref_kind, direction, round({_KIND} * CASE direction WHEN 'backward' THEN 1.3 ELSE 0.6 END::DOUBLE / line, 6) AS score, count(*) AS n FROM refs, (VALUES ('forward'), ('backward'), ('sideways')) d(direction) GROUP BY ALL", ("refs",))
def edge_score(spark, sf_dir):
    refs = relation(spark, sf_dir, "refs").select("ref_kind", "line", F.explode(F.array(*[F.lit(d) for d in ("forward", "backward", "sideways")])).alias("direction"))
    score = F.round(op.edge_score(F.col("ref_kind"), F.col("direction"), F.col("line").cast("double")), 6)
    return refs.groupBy("ref_kind", "direction", score.alias("score")).agg(F.count("*").alias("n"))


@query(f"WITH {_SEEDS} SELECT * FROM seeds", ("symbols", "graph_queries"))
def graph_seeds(spark, sf_dir):
    return _seeds(spark, sf_dir)


@query(f"WITH {_WALK} SELECT * FROM walk", _GRAPH)
def graph_traverse(spark, sf_dir):
    return op.traverse(_seeds(spark, sf_dir), _edges(spark, sf_dir))


@query(f"WITH {_WALK} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM walk) WHERE rank <= 20", _GRAPH)
def graph_search(spark, sf_dir):
    return op.traverse(_seeds(spark, sf_dir), _edges(spark, sf_dir), 20)


_HOP = _NEAR.replace("near AS", "far AS").replace("seeds s", "named s").replace("* 0.6", "* 0.6 * 0.25").replace("* 1.3", "* 1.3 * 0.25")


@query(f"""WITH {_EDGES}, {_SEEDS}, base AS (SELECT DISTINCT query_id, chunk_id FROM seeds), named AS (SELECT DISTINCT query_id, name, symbols.chunk_id FROM base JOIN symbols USING (chunk_id)), {_HOP}
SELECT query_id, chunk_id, 1.0::DOUBLE AS score FROM base UNION ALL SELECT query_id, chunk_id, round(sum(score), 6) FROM (FROM far ANTI JOIN base USING (query_id, chunk_id)) GROUP BY ALL""", _GRAPH)
def graph_one_hop(spark, sf_dir):
    base = _seeds(spark, sf_dir).select("query_id", "chunk_id").distinct().withColumn("score", F.lit(1.0))
    return op.one_hop(base, _edges(spark, sf_dir), relation(spark, sf_dir, "symbols"))


@query("SELECT from_key, to_key, round(sum(weight), 6) AS weight FROM entity_edges GROUP BY ALL", ("entity_edges",))
def edge_collapse(spark, sf_dir):
    return op.collapse(relation(spark, sf_dir, "entity_edges"))


@query("SELECT from_key, to_key, edge_kind, round(sum(weight), 6) AS weight FROM (FROM entity_edges UNION ALL SELECT from_key, to_key, 'call', 3.0::DOUBLE FROM entity_edges WHERE starts_with(from_key, 'n')) GROUP BY ALL", ("entity_edges",))
def edge_upsert_sum(spark, sf_dir):
    edges = relation(spark, sf_dir, "entity_edges")
    added = edges.filter("from_key like 'n%'").select("from_key", "to_key", F.lit("call").alias("edge_kind"), F.lit(3.0).alias("weight"))
    return op.upsert_sum(edges, added)


@query("SELECT to_key, round(sum(weight), 6) AS weight, count(*) AS n FROM (SELECT from_key, to_key, sum(weight) AS weight FROM entity_edges GROUP BY ALL) JOIN regions ON true JOIN (SELECT concat('n', n_nationkey) AS nk, concat('r', n_regionkey) AS rk FROM nation) ON rk = start AND nk = from_key GROUP BY to_key", ("entity_edges", "regions"))
def graph_neighbors(spark, sf_dir):
    edges = op.collapse(relation(spark, sf_dir, "entity_edges"))
    starts = op.reach(relation(spark, sf_dir, "regions"), edges, 1).select(F.col("node").alias("from_key"))
    return starts.join(edges, "from_key").groupBy("to_key").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n"))


_REACH = """links AS (SELECT DISTINCT from_key, to_key FROM entity_edges), d1 AS (SELECT DISTINCT start, to_key AS node FROM regions JOIN links ON from_key = start),
d2 AS (SELECT DISTINCT start, to_key AS node FROM d1 JOIN links ON from_key = node), d3 AS (SELECT DISTINCT start, to_key AS node FROM d2 JOIN links ON from_key = node),
reached AS (SELECT start, node, CAST(min(d) AS INT) AS depth FROM (SELECT *, 1 AS d FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) WHERE node <> start GROUP BY ALL)"""


@query(f"WITH {_REACH} SELECT * FROM reached", ("entity_edges", "regions"))
def bfs_reach(spark, sf_dir):
    return op.reach(relation(spark, sf_dir, "regions"), relation(spark, sf_dir, "entity_edges"), 3)


@query(f"WITH {_REACH} SELECT start, path, node, depth FROM (SELECT start, left(node, 1) AS path, node, depth, row_number() OVER (PARTITION BY start, left(node, 1) ORDER BY depth, node) AS at_ FROM reached) WHERE at_ = 1", ("entity_edges", "regions"))
def related_files(spark, sf_dir):
    return op.related_files(op.reach(relation(spark, sf_dir, "regions"), relation(spark, sf_dir, "entity_edges"), 3), F.substring("node", 1, 1))


@query("""WITH e AS (SELECT from_key, to_key, sum(weight) AS weight FROM entity_edges GROUP BY ALL), a AS (SELECT start AS query_id, to_key AS node, weight AS s FROM regions JOIN e ON from_key = start),
b AS (SELECT query_id, to_key AS node, s * weight / 2 AS g FROM a JOIN e ON from_key = node)
SELECT query_id, node, round(sum(g), 6) AS score FROM (SELECT query_id, node, s AS g FROM a UNION ALL FROM b) WHERE node <> query_id GROUP BY ALL""", ("entity_edges", "regions"))
def entity_bfs_score(spark, sf_dir):
    edges = op.collapse(relation(spark, sf_dir, "entity_edges")).withColumn("edge_ord", F.col("to_key"))
    starts = relation(spark, sf_dir, "regions").select(F.col("start").alias("query_id"), F.col("start").alias("node"), F.lit(0).alias("seed_ord"))
    return op.scored_search(starts, edges, 2)


@query("""WITH loc AS (SELECT s.name, s.kind, s.start_line, s.end_line, c.path, concat_ws(chr(9), c.path, s.kind, s.name, s.start_line, s.end_line) AS key FROM symbols s JOIN chunk_paths c USING (chunk_id)),
met AS (SELECT ref_kind, concat_ws(chr(9), from_path, 'file', '', 0, 0) AS ff, concat_ws(chr(9), t.path, 'file', '', 0, 0) AS tf, f.key AS fk, t.key AS tk FROM refs JOIN loc t ON t.name = to_name LEFT JOIN loc f ON f.name = from_name WHERE ref_kind IN ('import', 'call', 'inherit')),
pairs AS (SELECT ref_kind, ff AS a, tf AS b FROM met UNION ALL SELECT ref_kind, fk, tk FROM met), good AS (FROM pairs WHERE a IS NOT NULL AND a <> b)
SELECT x AS from_key, y AS to_key, ref_kind AS edge_kind, count(*)::DOUBLE AS weight FROM (SELECT ref_kind, a AS x, b AS y FROM good UNION ALL SELECT ref_kind, b, a FROM good) GROUP BY ALL""", ("symbols", "refs", "chunk_paths"))
def entity_edges_build(spark, sf_dir):
    symbols, refs, paths = _rel(spark, sf_dir, "symbols", "refs", "chunk_paths")
    return op.entity_edges(refs, symbols.drop("path"), paths)


def _ranked_files(spark, sf_dir):
    """Each priority's suppliers by number of line items stand for the files of a query."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("query_id"), F.concat(F.lit("s"), "l_suppkey").alias("path")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "path"))).drop("n")


_FILES = "f AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, path) AS rank FROM (SELECT l_returnflag AS query_id, concat('s', l_suppkey) AS path, count(*) AS n FROM lineitem GROUP BY ALL))"


@query(f"""WITH {_FILES}, e AS (SELECT from_key, to_key, sum(weight) AS weight FROM entity_edges GROUP BY ALL),
m AS (SELECT query_id, path, rank, to_key, row_number() OVER (PARTITION BY query_id, path ORDER BY weight DESC, to_key) AS at_ FROM f JOIN e ON path = from_key WHERE rank <= 8),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, at_) AS al FROM m WHERE at_ <= 5),
s AS (SELECT query_id, rank, concat('[', path, ']', chr(10), string_agg(concat('  part: ', to_key, ' :: ', to_key), chr(10) ORDER BY at_)) AS t FROM k WHERE al <= 20 GROUP BY query_id, rank, path)
SELECT query_id, string_agg(t, chr(10) ORDER BY rank) AS context FROM s GROUP BY query_id""", ("entity_edges",))
def graph_context(spark, sf_dir):
    edges = op.collapse(relation(spark, sf_dir, "entity_edges")).select(
        F.col("from_key").alias("from_path"), F.col("to_key").alias("to_path"), F.lit("part").alias("kind"), F.col("to_key").alias("name"), "weight")
    return op.context(_ranked_files(spark, sf_dir), edges)


@query(f"WITH {_FILES} SELECT a.path AS from_path, b.path AS to_path, 'co_change' AS edge_kind, round(count(*) * 0.6::DOUBLE, 6) AS weight FROM f a JOIN f b ON a.query_id = b.query_id AND a.rank < b.rank WHERE a.rank <= 8 AND b.rank <= 8 GROUP BY ALL")
def cochange_pairs(spark, sf_dir):
    return op.cochange(_ranked_files(spark, sf_dir))


@query(f"""WITH {_SEEDS}, c AS (SELECT DISTINCT query_id, chunk_id FROM seeds), near AS (SELECT query_id, c.chunk_id, name, lower(name) AS low FROM c JOIN symbols USING (chunk_id) WHERE length(name) > 2 AND (kind IN ('class', 'function') OR NOT starts_with(name, '_'))),
fresh AS (SELECT query_id, low, min({{'c': chunk_id, 'n': name}}) AS first FROM near ANTI JOIN (SELECT query_id, lower(name) AS low FROM seeds) USING (query_id, low) GROUP BY ALL)
SELECT query_id, first.n AS name, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, low) AS rank FROM fresh) WHERE rank <= 5""", ("symbols", "graph_queries"))
def cooccur_neighbors(spark, sf_dir):
    seeds = _seeds(spark, sf_dir).select("query_id", "name", F.lit(1).alias("rank"))
    return op.cooccurring(seeds, relation(spark, sf_dir, "symbols"))


# ---------------------------------------------------------------- range joins and vocabulary

_SPANS = "pt AS (SELECT event_id, concat('u', user_id) AS path, CAST(floor(epoch(ts) / 60) AS BIGINT) AS line FROM events), sp AS (SELECT concat('e', event_id) AS name, path, line AS start_line, line + 1 + CAST(floor(value) AS BIGINT) AS end_line, event_id AS ord FROM pt JOIN events USING (event_id))"


def _spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("long")
    points = e.select("event_id", F.concat(F.lit("u"), "user_id").alias("path"), minute.alias("line"), "value")
    spans = points.select(F.concat(F.lit("e"), "event_id").alias("name"), "path", F.col("line").alias("start_line"), (F.col("line") + 1 + F.floor("value")).alias("end_line"), F.col("event_id").alias("ord"))
    return points.drop("value"), spans


@query(f"WITH {_SPANS} SELECT event_id, path, line, arg_min(name, {{'s': end_line - start_line, 'o': ord}}) FILTER (line BETWEEN start_line AND end_line) AS enclosing FROM pt JOIN sp USING (path) GROUP BY ALL")
def enclosing_symbol(spark, sf_dir):
    return lookups.enclosing(*_spans(spark, sf_dir))


@query(f"WITH {_SPANS} SELECT pt.event_id AS range_id, count(DISTINCT name) AS n FROM pt JOIN sp USING (path) WHERE NOT (end_line < line OR start_line > line + 5) GROUP BY 1")
def range_overlap(spark, sf_dir):
    points, spans = _spans(spark, sf_dir)
    ranges = points.select(F.col("event_id").alias("range_id"), "path", "line", (F.col("line") + 5).alias("end_line"))
    return lookups.overlaps(ranges, spans).groupBy("range_id").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderpriority AS path, o_orderstatus AS st, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS INT) AS ix FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)),
ch AS (SELECT path, ix, concat(path, ix) AS chunk_id, (ix - 1) * 20 + 1 AS s, ix * 20 + 5 AS e FROM c),
sy AS (SELECT o_orderkey AS ord, o_orderpriority AS path, CAST(floor(o_totalprice / 5000) AS INT) + 1 AS start_line FROM orders)
SELECT sy.ord, sy.path, sy.start_line, coalesce(arg_min(chunk_id, ix) FILTER (start_line BETWEEN s AND e), arg_max(chunk_id, ix)) AS chunk_id FROM sy JOIN ch USING (path) GROUP BY ALL""")
def symbol_chunk_range(spark, sf_dir):
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    pieces = orders.select(F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("st")).distinct()
    pieces = pieces.withColumn("chunk_ix", F.row_number().over(Window.partitionBy("path").orderBy("st")))
    chunks = pieces.select("path", "chunk_ix", F.concat("path", "chunk_ix").alias("chunk_id"), ((F.col("chunk_ix") - 1) * 20 + 1).alias("start_line"), (F.col("chunk_ix") * 20 + 5).alias("end_line"))
    symbols = orders.select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("path"), (F.floor(F.col("o_totalprice") / 5000).cast("int") + 1).alias("start_line"))
    return lookups.symbol_chunks(symbols, chunks)


@query(r"""WITH st AS (SELECT lower(n) AS low, min(n) AS name FROM (SELECT regexp_replace(unnest(string_split(path, '/')), '\.[^.]*$', '') AS n FROM (SELECT DISTINCT path FROM page_files)) WHERE length(n) > 2 GROUP BY 1)
SELECT DISTINCT name, kind, NOT starts_with(name, '_') AS is_public FROM symbols WHERE length(name) > 2 UNION ALL SELECT name, 'file', true FROM st WHERE low NOT IN (SELECT lower(name) FROM symbols WHERE length(name) > 2)""", ("symbols", "page_files"))
def vocab_build(spark, sf_dir):
    return lookups.vocabulary(relation(spark, sf_dir, "symbols"), relation(spark, sf_dir, "page_files"))


@query("SELECT query_id, path, doc_id, score, CAST(at_ AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS at_ FROM (SELECT query_id, concat(path, '/d') AS path, doc_id, score, rank FROM results) WHERE rank <= 30 AND starts_with(path, 'src3/')) WHERE at_ <= 10", ("results",))
def scope_filter(spark, sf_dir):
    results = relation(spark, sf_dir, "results").withColumn("path", F.concat("path", F.lit("/d")))
    return lookups.scope_filter(results, "src3").select("query_id", "path", "doc_id", "score", F.col("at").alias("place"))


@query("""WITH names AS (SELECT query_id, unnest(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM graph_queries),
cand AS (SELECT DISTINCT query_id, name FROM names WHERE length(name) >= 4 AND name <> 'find')
SELECT query_id, chunk_id, count(*)::DOUBLE AS score, CAST(1 AS INT) AS rank FROM cand JOIN symbols USING (name) GROUP BY ALL""", ("graph_queries", "symbols"))
def symbol_channel(spark, sf_dir):
    return lookups.symbol_channel(relation(spark, sf_dir, "graph_queries"), relation(spark, sf_dir, "symbols"))


@query("""WITH p AS (SELECT concat(lower(p_brand), '/', replace(p_name, ' ', '/'), CASE WHEN p_size < 25 THEN '.py' ELSE '/__init__.py' END) AS path FROM part),
k AS (SELECT DISTINCT path FROM p), m AS (SELECT DISTINCT CASE WHEN p_size < 10 THEN replace(p_name, ' ', '.') ELSE concat(lower(p_brand), '.', replace(p_name, ' ', '.')) END AS module FROM part)
SELECT module, coalesce(d.path, i.path, (SELECT min(path) FROM k WHERE ends_with(path, concat('/', array_to_string(string_split(module, '.')[-2:], '/'), '.py')))) AS path
FROM m LEFT JOIN k d ON d.path = concat(replace(module, '.', '/'), '.py') LEFT JOIN k i ON i.path = concat(replace(module, '.', '/'), '/__init__.py')""")
def module_resolve(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    paths = part.select(F.concat(F.lower("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(F.col("p_size") < 25, ".py").otherwise("/__init__.py")).alias("path"))
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    modules = part.select(F.when(F.col("p_size") < 10, dotted).otherwise(F.concat(F.lower("p_brand"), F.lit("."), dotted)).alias("module"))
    return lookups.module_paths(modules, paths)
