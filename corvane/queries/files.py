"""Queries of scans, filters, chunking and scalar text functions: documents and pages stand for files, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.config import BINARY_EXTENSIONS
from corvane.functions import text as T
from corvane.operators import chunking
from corvane.queries.base import query, relation, table
from corvane.sources import files as op


def _files(spark, sf_dir):
    return relation(spark, sf_dir, "files")


@query("SELECT url, list_has_any(string_split(url, '/'), ['en', 'es']) AS excluded FROM pages")
def scan_exclude(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", op.excluded_dir(F.col("url"), ("en", "es")).alias("excluded"))


_EXT = " OR ".join(f"ends_with(lower(path), '{e}')" for e in BINARY_EXTENSIONS)
_MARK = " OR ".join(f"contains(left(content, 1024), '{m}')" for m in ("@generated", "DO NOT EDIT", "auto-generated", "AUTO GENERATED"))


@query(f"SELECT path, CASE WHEN {_EXT} THEN 'extension' WHEN size > 1000000 THEN 'too large' WHEN size = 0 THEN 'empty' WHEN {_MARK} THEN 'generated' END AS reason FROM files", ("files",))
def noise_filter(spark, sf_dir):
    return _files(spark, sf_dir).select("path", op.noise_reason(F.col("path"), F.col("content"), F.col("size")).alias("reason"))


_RULES = (("", "*.txt\n!keep.txt\n/docs/es/\n"), ("docs/en", "!*.txt\nsrc1*/\n"), ("docs/fr/src2", "*.go\n!doc1*.go\n"))


@query(r"""SELECT path, (ends_with(path, '.txt') OR starts_with(path, 'docs/es/')) OR regexp_matches(path, '^docs/en/(.*/)?src1[^/]*/')
 OR (starts_with(path, 'docs/fr/src2/') AND ends_with(path, '.go') AND NOT regexp_matches(path, '/doc1[^/]*\.go$')) AS ignored FROM (SELECT DISTINCT path FROM files)""", ("files",))
def gitignore_match(spark, sf_dir):
    return op.gitignored(_files(spark, sf_dir), op.gitignore_rules(spark, list(_RULES)))


_LANGUAGE = "CASE regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1) WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' END"


@query(f"SELECT path, {_LANGUAGE} AS language FROM files", ("files",))
def detect_language(spark, sf_dir):
    return _files(spark, sf_dir).select("path", T.detect_language(F.col("path")).alias("language"))


@query("SELECT path FROM (SELECT DISTINCT path FROM files WHERE path LIKE 'docs/de/%.go') ORDER BY path LIMIT 100", ("files",))
def find_files(spark, sf_dir):
    return op.find_files(_files(spark, sf_dir), "docs/de/*.go")


_LINES = "ls AS (SELECT path, content, string_split(content, chr(10)) AS l FROM files), lines AS (SELECT path, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM ls)"


@query(f"WITH {_LINES} SELECT path, CAST(line AS INT) AS line, text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS at_ FROM lines WHERE regexp_matches(text, '[0-9]{{3}}[-.][0-9]{{3,4}}')) WHERE at_ <= 50", ("files",))
def regex_lines(spark, sf_dir):
    return op.regex_lines(_files(spark, sf_dir), "[0-9]{3}[-.][0-9]{3,4}")


@query(f"WITH {_LINES} SELECT path, count(*) AS n FROM lines WHERE regexp_matches(text, '(?i)(password|token|the|der)') GROUP BY path ORDER BY n DESC, path LIMIT 50", ("files",))
def grep_count_topk(spark, sf_dir):
    return op.grep_count(_files(spark, sf_dir), ["password", "token", "the", "der"])


@query("SELECT path, array_to_string(list_transform(list_slice(string_split(content, chr(10)), 2, 4), lambda t, i: concat(i + 1, ': ', t)), chr(10)) AS text FROM files", ("files",))
def read_line_range(spark, sf_dir):
    return op.read_range(_files(spark, sf_dir), F.lit(2), F.lit(4))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, concat(sha256(text), ':', doc_id % 10) AS chunk_hash FROM documents")
def chunk_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.chunk_hash(F.sha2("text", 256), F.col("doc_id") % 10).alias("chunk_hash"))


_NAMES = "SELECT concat(initcap_(split_part(p_name, ' ', 1)), split_part(p_name, ' ', 2), '_', p_type, 'X', p_partkey) AS name FROM part"
_CAP = "concat(upper(left(split_part(p_name, ' ', 1), 1)), substr(split_part(p_name, ' ', 1), 2))"


@query(f"""SELECT p_partkey, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(replace(name, '_', ' '), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' '), lambda x: length(x) > 1), ' ') AS parts
FROM (SELECT p_partkey, concat({_CAP}, split_part(p_name, ' ', 2), '_', p_type, 'x', p_partkey) AS name FROM part)""")
def split_identifier(spark, sf_dir):
    name = F.concat(F.initcap(F.split("p_name", " ")[0]), F.split("p_name", " ")[1], F.lit("_"), "p_type", F.lit("x"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.split_identifier(name), " ").alias("parts"))


@query("""SELECT event_id, concat_ws(' ', CASE event_type WHEN 'error' THEN 'database' WHEN 'click' THEN 'request' ELSE 'context' END, CASE event_type WHEN 'error' THEN 'db' WHEN 'click' THEN 'req' ELSE 'ctx' END, event_type, 'handler') AS terms FROM events""")
def abbrev_expand(spark, sf_dir):
    short = F.when(F.col("event_type") == "error", "db").when(F.col("event_type") == "click", "req").otherwise("ctx")
    text = F.concat(F.lit("see "), short, F.lit("_"), "event_type", F.lit("Handler 1"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(T.expand_identifiers(text), " ").alias("terms"))


@query("SELECT query_id, concat_ws(' ', name, split_part(name, '_', 1), split_part(name, '_', 2), CASE WHEN length(split_part(name, '_', 3)) >= 3 THEN split_part(name, '_', 3) END) AS terms FROM (SELECT query_id, replace(query, 'find ', '') AS name, starts_with(query, 'find ') AS f FROM graph_queries) WHERE NOT f", ("graph_queries",))
def grep_terms(spark, sf_dir):
    q = relation(spark, sf_dir, "graph_queries").filter("query not like 'find %'")
    return q.select("query_id", F.array_join(T.grep_terms(F.col("query")), " ").alias("terms"))


@query("SELECT query_id, concat_ws(' ', CASE WHEN f THEN 'find' END, name, split_part(name, '_', 1), split_part(name, '_', 2), CASE WHEN length(split_part(name, '_', 3)) >= 3 THEN split_part(name, '_', 3) END) AS terms FROM (SELECT query_id, replace(query, 'find ', '') AS name, starts_with(query, 'find ') AS f FROM graph_queries)", ("graph_queries",))
def grep_terms_all(spark, sf_dir):
    """All queries, with those of a plain word before the identifier."""
    return relation(spark, sf_dir, "graph_queries").select("query_id", F.array_join(T.grep_terms(F.col("query")), " ").alias("terms"))


_CONCEPT = " ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN [{', '.join(repr(t) for t in tags)}] ELSE [] END," for p, tags in T.CONCEPTS).rstrip(",")


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(flatten([{_CONCEPT}]))), ', ') AS tags FROM (SELECT p_partkey, concat(p_name, CASE WHEN p_size < 10 THEN ' threading.RLock()' WHEN p_size < 20 THEN ' asyncio.Lock lru_cache' WHEN p_size < 30 THEN ' with self._lock: HNSW hamming' WHEN p_size < 40 THEN ' CUDA batch the process' ELSE ' lazy_load' END) AS text FROM part)")
def concept_tags(spark, sf_dir):
    extra = F.when(F.col("p_size") < 10, " threading.RLock()").when(F.col("p_size") < 20, " asyncio.Lock lru_cache").when(F.col("p_size") < 30, " with self._lock: HNSW hamming").when(F.col("p_size") < 40, " CUDA batch the process").otherwise(" lazy_load")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.concept_tags(F.concat("p_name", extra)), ", ").alias("tags"))


@query("SELECT id, concat('// File: ', path, chr(10), CASE WHEN kind <> 'class' THEN concat('// Class: C', chunk_id, chr(10)) ELSE '' END, '// ', upper(left(kind, 1)), substr(kind, 2), ': ', name, chr(10)) AS header FROM symbols", ("symbols",))
def context_header(spark, sf_dir):
    parent = F.when(F.col("kind") != "class", F.concat(F.lit("C"), "chunk_id"))
    return relation(spark, sf_dir, "symbols").select("id", chunking.context_header(F.col("path"), parent, F.col("kind"), F.col("name")).alias("header"))


_INTENT = r"""s AS (SELECT id, q, CAST(len(list_filter(string_split(regexp_replace(trim(q), '\s+', ' ', 'g'), ' '), lambda w: length(w) > 0)) AS INT) AS n FROM src),
c AS (SELECT *, CASE WHEN regexp_matches(q, '[a-z][A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(q, '\b[a-z_]+_[a-z_]+\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(q, '->|::|[\[\](){}.]') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches(q, '\b(async|await|class|def|from|import|lambda|return|yield)\b') THEN 2 ELSE 0 END + CASE WHEN contains(q, '`') THEN 1 ELSE 0 END + CASE WHEN n < 4 THEN 1 ELSE 0 END AS code FROM s),
t AS (SELECT *, CASE WHEN regexp_matches(q, '(?i)\b(are|can|do|does|how|is|should|what|when|where|which|who|why)\b') THEN 2 ELSE 0 END + CASE WHEN n > 5 THEN 2 ELSE 0 END + CASE WHEN code = 0 AND n >= 3 THEN 1 ELSE 0 END AS nat FROM c)
SELECT id, CASE WHEN n > 20 THEN 'natural' WHEN n > 10 THEN 'mixed' WHEN code >= 2 AND nat = 0 THEN 'code_symbol' WHEN nat >= 2 AND code = 0 THEN 'natural' WHEN nat > code THEN 'natural' WHEN code > nat THEN 'code_symbol' ELSE 'mixed' END AS intent FROM t"""


@query(f"WITH src AS (SELECT concat('m', conv_id, '-', turn) AS id, text AS q FROM conversations UNION ALL SELECT concat('q', query_id), query FROM graph_queries UNION ALL SELECT concat('p', p_partkey), concat('how is ', p_name) FROM part), {_INTENT}", ("graph_queries",))
def query_intent(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select(F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("id"), F.col("text").alias("q"))
    b = relation(spark, sf_dir, "graph_queries").select(F.concat(F.lit("q"), "query_id").alias("id"), F.col("query").alias("q"))
    c = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("how is "), "p_name").alias("q"))
    return a.unionByName(b).unionByName(c).select("id", T.query_intent(F.col("q")).alias("intent"))


@query("""SELECT p_partkey, len(list_filter([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)], lambda p: length(p) >= 3 AND len(list_filter(['red', 'ringing', 'stand', 'eco', 'wid'], lambda q: starts_with(q, p) OR starts_with(p, q))) > 0)) > 0 AS matches FROM part""")
def term_prefix_match(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("red", "ringing", "stand", "eco", "wid")])
    term = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.prefix_match(term, words).alias("matches"))


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT name, path, kind, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, concat_ws(chr(9), path, kind, name, start_line, end_line) AS key FROM symbols", ("symbols",))
def entity_key_roundtrip(spark, sf_dir):
    s = relation(spark, sf_dir, "symbols").select(T.entity_key(F.col("path"), F.col("kind"), F.col("name"), F.col("start_line"), F.col("end_line")).alias("key"))
    e = s.withColumn("e", T.entity_of_key(F.col("key")))
    return e.select(F.col("e.symbol_name").alias("name"), F.col("e.file_path").alias("path"), F.col("e.kind").alias("kind"), F.col("e.start_line").alias("start_line"), F.col("e.end_line").alias("end_line"), "key")


@query()
def chunk_text(spark, sf_dir):
    """Sequential packing with overlap; tests hold it against a brute-force version."""
    return chunking.chunks(_files(spark, sf_dir), mode="text")


@query()
def chunk_code(spark, sf_dir):
    return chunking.chunks(_files(spark, sf_dir), mode="code")


_SOURCE = "concat('class ', replace(p_name, ' ', '_'), ':', chr(10), '    def go', p_partkey, '(self):', chr(10), '        def deep(): pass', chr(10), 'define = ', p_size, chr(10), 'export async function run() {')"


@query(rf"""WITH f AS (SELECT p_partkey, string_split({_SOURCE}, chr(10)) AS l FROM part), lines AS (SELECT p_partkey, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line FROM f)
SELECT p_partkey, CAST(line AS INT) AS line FROM lines WHERE regexp_matches(text, '^ {{0,4}}((export\s+)?(async\s+)?(class|def|function))\s')""")
def code_boundaries(spark, sf_dir):
    """Lines that begin definitions, in a source file made of every part."""
    begins = F.udf(lambda text: chunking.boundaries(text.split("\n")), "array<int>")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(begins(F.expr(_SOURCE))).alias("line"))


@query()
def greedy_pack(spark, sf_dir):
    """Order-dependent batching; tests hold it against a brute-force version."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), T.token_estimate(F.col("text")).alias("tokens"))
    return chunking.greedy_batches(docs)


@query(f"""WITH {_LINES}, rx AS (SELECT 'q' AS query_id, path, CAST(line AS INT) AS line, row_number() OVER (ORDER BY path, line) AS rank FROM lines WHERE contains(text, '@')),
se AS (SELECT 'q' AS query_id, path, 1 AS line, row_number() OVER (ORDER BY size DESC, path) AS rank FROM files),
b AS (SELECT *, 0 AS prio FROM se UNION ALL SELECT *, 1 FROM rx), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, line ORDER BY prio, rank) AS dup FROM b) WHERE dup = 1)
SELECT path, line, prio, CAST(at_ AS INT) AS place FROM (SELECT *, row_number() OVER (ORDER BY prio, rank, path, line) AS at_ FROM k) WHERE at_ <= 10""", ("files",))
def merge_semantic_regex(spark, sf_dir):
    from pyspark.sql import Window

    from corvane.operators import lookups

    f = _files(spark, sf_dir)
    regex = op.regex_lines(f, "@", 1_000_000).withColumn("query_id", F.lit("q")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("path", "line")))
    semantic = f.select(F.lit("q").alias("query_id"), "path", F.lit(1).alias("line"), "size").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("size"), "path")))
    return lookups.merge_results(semantic, regex).select("path", "line", "prio", F.col("at").alias("place"))
