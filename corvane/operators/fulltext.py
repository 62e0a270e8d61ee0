"""Inverted index, BM25, and the full-text query language, over plain DataFrames.

Chunks are (chunk_id, content). An index has postings (term, chunk_id, tf, positions), doc_lengths (chunk_id, len)
and the corpus row (n_docs, avgdl). Queries come as a batch (query_id, query). Only the terms of the batch are kept
before anything is grouped, so the shuffle holds the postings of those terms and not the corpus. A batch that can be sent
to all tasks is counted and scored where chunks are, and only the best of each task are exchanged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions.stem import porter, stem
from corvane.functions.text import words
from corvane.operators.best import Best
from corvane.plans.lineage import cut

K1, B = 1.2, 0.75


def tokens(chunks: DataFrame, stemmed: bool = False) -> DataFrame:
    """(chunk_id, pos, term) of every token."""
    out = chunks.select("chunk_id", F.posexplode(words(F.col("content"))).alias("pos", "term"))
    if not stemmed:
        return out
    # distinct terms only go through Python
    stems = out.select("term").distinct().withColumn("stemmed", stem(fold(F.col("term"))))
    return out.join(stems, "term").select("chunk_id", "pos", F.col("stemmed").alias("term"))


def _accents() -> tuple[str, str]:
    """Lower-case letters with marks of the Latin alphabets, and the letters without."""
    plain = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    pairs = [(a, b) for a, b in plain.items() if a != b and a.islower() and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(term: Column) -> Column:
    """A lower-cased term without the marks of Latin letters."""
    return F.translate(term, *_accents())


def doc_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.coalesce(F.size(words(F.col("content"))), F.lit(0)).cast("long").alias("len"))


def corpus(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avgdl"))


def postings(toks: DataFrame) -> DataFrame:
    grouped = toks.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", "chunk_id", "tf", "positions")


@dataclass(frozen=True)
class Inverted:
    """A kept index: postings (term, chunk_id, tf) of folded stems, and lengths (chunk_id, len) of all chunks."""

    postings: DataFrame
    lengths: DataFrame


def inverted(chunks: DataFrame) -> Inverted:
    """The index of chunks. Postings are sorted by term, so that files and row groups are skipped by the terms they hold;
    ranges are cut within a term too, so a term of most chunks is spread over many files."""
    counts = tokens(chunks, stemmed=True).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
    return Inverted(counts.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"), doc_lengths(chunks))


def _within(postings: DataFrame, terms: DataFrame, prefixes: bool = False, limit: int = 500) -> DataFrame:
    """Postings of terms (term): few terms become a filter that reaches the scan. With prefixes, few of them (50) do too,
    as beginnings of terms; with more all postings come back, for the join to choose from."""
    listed = sorted(r["term"] for r in terms.select("term").filter("term is not null").distinct().limit(limit + 1).collect())
    if len(listed) > limit:
        return postings if prefixes else postings.join(terms.select("term").distinct(), "term", "left_semi")
    if not prefixes:
        return postings.filter(F.col("term").isin(listed))
    begins = F.lit(False)
    for head in listed:
        begins = begins | F.col("term").startswith(head)
    return postings.filter(begins) if len(listed) <= 50 else postings


def doc_freq(toks: DataFrame) -> DataFrame:
    return toks.groupBy("term").agg(F.countDistinct("chunk_id").alias("df"), F.count("*").alias("cf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def saturation(tf: Column, length: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def query_terms(queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """(query_id, term, n_terms): distinct terms of every query."""
    terms = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    if stemmed:
        terms = terms.withColumn("term", stem(fold(F.col("term")))).distinct()
    return terms.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best rows of each query by score, then chunk_id, with their rank."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Pairs of query and term of a batch that is sent to all tasks; larger ones are joined.
PAIRS = 200_000


@dataclass(frozen=True)
class Counted:
    """What a batch of queries has in chunks: table (chunk_id, len, and for "exact" and "prefix" the places in terms and how
    often each occurs), how many chunks have each, and the batch itself: query_id and places in terms."""

    table: DataFrame
    terms: list[str]
    asked: list[tuple[object, list[int]]]
    n_docs: int
    avgdl: float
    df: dict[str, np.ndarray]


def counted(chunks: DataFrame, queries: DataFrame, stemmed: bool = False, kinds: tuple[str, ...] = ("exact",), most: int | None = None) -> Counted | None:
    """Counts the terms of a batch, or the terms that they begin, in one reading of chunks, each chunk where it is.

    None if the batch is too large to be sent to all tasks or ids of chunks are null or repeated.
    """
    most = PAIRS if most is None else most
    pairs = query_terms(queries, stemmed).select("query_id", "term").limit(most + 1).collect()
    if len(pairs) > most:
        return None
    terms = sorted({r["term"] for r in pairs})
    at = {t: i for i, t in enumerate(terms)}
    asked: dict[object, list[int]] = {}
    for r in pairs:
        asked.setdefault(r["query_id"], []).append(at[r["term"]])
    sizes = sorted({len(t) for t in terms})
    marks = str.maketrans(*_accents())

    def places(word: str, kind: str) -> tuple[int, ...]:
        if not word:
            return ()
        if stemmed:
            word = porter(word.translate(marks))
        if kind == "exact":
            return (at[word],) if word in at else ()
        return tuple(at[word[:n]] for n in sizes if n <= len(word) and word[:n] in at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, tuple[int, ...]]] = {kind: {} for kind in kinds}
        for whole in batches:
            # some MB of text at once, however long texts are
            bytes_ = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy().astype(np.int64))]
            hi = 0
            while hi < whole.num_rows:
                lo, hi = hi, max(hi + 1, int(np.searchsorted(bytes_, bytes_[hi] + 1_000_000, side="right")) - 1)
                batch = whole.slice(lo, hi - lo)
                # what lies between words() of a lower-cased text; its ends may be empty
                listed = pc.split_pattern_regex(batch.column("text"), r"[^\p{L}\p{N}]+")
                n, parts = batch.num_rows, pc.fill_null(pc.list_value_length(listed), 0).to_numpy().astype(np.int64)
                coded = listed.flatten().dictionary_encode()
                codes, rows, distinct = coded.indices.to_numpy(), np.repeat(np.arange(n), parts), coded.dictionary.to_pylist()
                lens = np.bincount(rows[np.array([w != "" for w in distinct], dtype=bool)[codes]], minlength=n)
                out = [batch.column("chunk_id"), pa.array(lens)]
                for kind in kinds:
                    memory = known[kind]
                    met = [memory[w] if w in memory else places(w, kind) for w in distinct]
                    if len(memory) < 50_000:  # frequent words come early
                        memory.update(zip(distinct, met, strict=True))
                    width = np.array([len(m) for m in met], dtype=np.int64)
                    flat = np.array([x for m in met for x in m], dtype=np.int64)
                    begin = np.r_[0, np.cumsum(width)][:-1]
                    fit = width[codes] > 0 if len(codes) else np.zeros(0, bool)
                    c, r = codes[fit], rows[fit]
                    times = width[c]
                    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    key, tf = np.unique(np.repeat(r, times) * max(1, len(terms)) + flat[np.repeat(begin[c], times) + within], return_counts=True)
                    row, term = np.divmod(key, max(1, len(terms)))
                    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                    out += [pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(out, names=["chunk_id", "len", *(x for kind in kinds for x in (kind, f"{kind}_tf"))])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), T.StructField("len", T.LongType()), *(T.StructField(x, ints) for kind in kinds for x in (kind, f"{kind}_tf"))])
    table = cut(chunks.select("chunk_id", F.lower("content").alias("text")).mapInArrow(count, schema))
    n_docs, n_ids, avgdl = table.agg(F.count("*"), F.count_distinct("chunk_id"), F.avg("len")).first()
    if n_docs != n_ids:
        return None
    df = {}
    for kind in kinds:
        df[kind] = np.zeros(len(terms))
        for r in table.select(F.explode(kind).alias("term")).groupBy("term").count().collect():
            df[kind][r["term"]] = r["count"]
    return Counted(table, terms, list(asked.items()), n_docs, avgdl or 0.0, df)


def _best(found: Counted, queries: DataFrame, k: int, kind: str, match_all: bool) -> DataFrame:
    """(query_id, chunk_id, score, rank): every chunk meets the queries of its terms where it is; a task puts out k rows a query."""
    n_queries, n_terms = len(found.asked), np.array([len(ts) for _, ts in found.asked], dtype=np.int64)
    of = sorted((t, q) for q, (_, ts) in enumerate(found.asked) for t in ts)
    by_term = np.array([q for _, q in of], dtype=np.int64)
    begin = np.searchsorted(np.array([t for t, _ in of], dtype=np.int64), np.arange(len(found.terms) + 1))
    df = found.df[kind]
    weight = np.maximum(np.log((found.n_docs - df + 0.5) / (df + 0.5)), 1e-6)
    avgdl, kind_of_query = found.avgdl, queries.schema["query_id"].dataType
    names, arrow, most = [q for q, _ in found.asked], to_arrow_type(kind_of_query), 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind_of = Best(n_queries, k), None
        for batch in batches:
            kind_of = batch.column("chunk_id").type
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object else ids
            lens, listed = batch.column("len").to_numpy(), batch.column(kind)
            each = pc.list_value_length(listed).to_numpy().astype(np.int64)
            term, tf = listed.flatten().to_numpy(), batch.column(f"{kind}_tf").flatten().to_numpy()
            row = np.repeat(np.arange(len(each)), each)
            value = weight[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[row] / avgdl)))
            times = begin[term + 1] - begin[term]
            # chunks at once: as many as have a table of scores and pairs of term and query of a fixed size
            ends = np.r_[0, np.cumsum(each)]
            total = np.r_[0, np.cumsum(times)][ends] + np.arange(len(ends)) * n_queries
            lo = 0
            while lo < len(each):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
                a, b = ends[lo], ends[hi]
                t = times[a:b]
                within = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                cell = np.repeat(row[a:b] - lo, t) * n_queries + by_term[np.repeat(begin[term[a:b]], t) + within]
                score = np.bincount(cell, np.repeat(value[a:b], t), minlength=(hi - lo) * n_queries).reshape(hi - lo, n_queries)
                hits = np.bincount(cell, minlength=(hi - lo) * n_queries).reshape(hi - lo, n_queries)
                key = -np.floor(score * 1e6 + 0.5).astype(np.int64)
                at, query = np.nonzero(((hits == n_terms) if match_all else (hits > 0)) & (key <= best.bound))
                best.offer(query, ids[lo + at], key[at, query])
                lo = hi
        query, ids, key = best.found()
        if len(query):
            asked = pa.array(names, type=arrow).take(pa.array(query))
            yield pa.RecordBatch.from_arrays([asked, pa.array(ids.tolist(), type=kind_of), pa.array(-key / 1e6)], names=["query_id", "chunk_id", "score"])

    schema = T.StructType([T.StructField("query_id", kind_of_query), T.StructField("chunk_id", found.table.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    return top_k(found.table.select("chunk_id", "len", kind, f"{kind}_tf").mapInArrow(run, schema), k)


def bm25(
    chunks: DataFrame, queries: DataFrame, k: int = 50, match_all: bool = False, stemmed: bool = False, kept: Inverted | None = None, found: Counted | None = None
) -> DataFrame:
    """(query_id, chunk_id, score, rank): BM25 of the query's terms; with match_all only chunks that have them all.

    With a kept index, which is of stems, chunks aren't read. found: the batch's terms, if they have been counted.
    """
    found = found or (counted(chunks, queries, stemmed) if kept is None else None)
    if found is not None:
        return _best(found, queries, k, "exact", match_all)
    terms = query_terms(queries, stemmed or kept is not None)
    wanted = terms.select("term").distinct()
    if kept is not None:
        lengths, tf = kept.lengths, _within(kept.postings, wanted)
    else:
        lengths = doc_lengths(chunks)
        found = tokens(chunks, stemmed).join(F.broadcast(wanted) if _few(wanted) else wanted, "term", "left_semi")
        tf = found.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term").crossJoin(corpus(lengths))
    met = weighted.join(tf, "term").join(lengths, "chunk_id")
    part = idf(F.col("n_docs"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avgdl"))
    scored = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("hits"), F.first("n_terms").alias("n_terms"))
    if match_all:
        scored = scored.filter("hits = n_terms")
    return top_k(scored.select("query_id", "chunk_id", "score"), k)


def _few(table: DataFrame, limit: int = 100_000) -> bool:
    """Whether a narrow table is small enough to be sent to all executors: counted, not guessed."""
    return table.limit(limit + 1).count() <= limit


def prefix_search(chunks: DataFrame, queries: DataFrame, k: int = 50, stemmed: bool = False, kept: Inverted | None = None, found: Counted | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks that for every word of the query have a term which begins with it.

    A prefix counts as one term: its frequency is that of all terms it begins, and so is its document frequency. With
    stemmed, terms and prefixes are folded and stemmed. With a kept index, which is of stems, chunks aren't read.
    found: the batch's prefixes, if they have been counted.
    """
    found = found or (counted(chunks, queries, stemmed, ("prefix",)) if kept is None else None)
    if found is not None:
        return _best(found, queries, k, "prefix", True)
    prefixes = query_terms(queries, stemmed or kept is not None).withColumnRenamed("term", "prefix")
    if kept is not None:
        lengths = kept.lengths
        counts = _within(kept.postings, prefixes.select(F.col("prefix").alias("term")), prefixes=True)
    else:
        lengths = doc_lengths(chunks)
        counts = tokens(chunks, stemmed).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
    # terms meet prefixes of their own beginnings by equality, never by a nested loop
    heads = prefixes.select("prefix").distinct().withColumn("n", F.length("prefix"))
    sizes = heads.agg(F.collect_set("n").alias("sizes"))
    begun = counts.select("term").distinct().crossJoin(sizes).select("term", F.explode("sizes").alias("n")).filter("length(term) >= n")
    of = begun.select("term", F.expr("left(term, n)").alias("prefix")).join(heads.select("prefix"), "prefix")
    tf = counts.join(of, "term").groupBy("prefix", "chunk_id").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("prefix").agg(F.count("*").alias("df"))
    met = prefixes.join(df, "prefix").crossJoin(corpus(lengths)).join(tf, "prefix").join(lengths, "chunk_id")
    part = idf(F.col("n_docs"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avgdl"))
    scored = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("hits"), F.first("n_terms").alias("n_terms"))
    return top_k(scored.filter("hits = n_terms").select("query_id", "chunk_id", "score"), k)


# ---------------------------------------------------------------- query language


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Without:
    left: object
    right: object


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()*^+,])|([^\W]+)|(\S))')


class SyntaxFault(ValueError):
    pass


class Parser:
    """AND, OR, NOT, NEAR(a b, n), "phrases", prefix*, ^first, a + b, parentheses; words side by side are ANDed."""

    def __init__(self, query: str, stemmed: bool = True):
        self.stemmed = stemmed
        self.items: list[tuple[str, str]] = []
        at = 0
        query = query.rstrip()
        while at < len(query):
            m = _LEX.match(query, at)
            at = m.end()
            if m[4]:
                raise SyntaxFault(m[4])
            self.items.append(("phrase", m[1].replace('""', '"')) if m[1] is not None else ("sign", m[2]) if m[2] else ("word", m[3]))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        item = self.peek()
        self.at += 1
        return item

    def expect(self, sign: str) -> None:
        if self.take() != ("sign", sign):
            raise SyntaxFault(sign)

    def parse(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise SyntaxFault(self.peek()[1])
        return tree

    def either(self):
        left = self.both()
        while self.peek() == ("word", "OR"):
            self.take()
            left = Either(left, self.both())
        return left

    def both(self):
        left = self.without()
        while self.peek() == ("word", "AND"):
            self.take()
            left = Both(left, self.without())
        return left

    def without(self):
        left = self.run()
        while self.peek() == ("word", "NOT"):
            self.take()
            left = Without(left, self.run())
        return left

    def run(self):
        left = self.atom()
        while self.peek()[0] in ("word", "phrase") and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek() in (("sign", "("), ("sign", "^")):
            left = Both(left, self.atom())
        return left

    def atom(self):
        kind, value = self.peek()
        if (kind, value) == ("sign", "("):
            self.take()
            inner = self.either()
            self.expect(")")
            return inner
        if (kind, value) == ("word", "NEAR") and self.at + 1 < len(self.items) and self.items[self.at + 1] == ("sign", "("):
            self.at += 2
            phrases, distance = [self.phrase()], 10
            while self.peek()[0] in ("word", "phrase"):
                phrases.append(self.phrase())
            if self.peek() == ("sign", ","):
                self.take()
                kind, value = self.take()
                if not value.isdigit():
                    raise SyntaxFault(value)
                distance = int(value)
            self.expect(")")
            return Near(tuple(phrases), distance)
        return self.phrase()

    def phrase(self) -> Phrase:
        first = self.peek() == ("sign", "^")
        if first:
            self.take()
        terms = self.terms()
        while self.peek() == ("sign", "+"):
            self.take()
            terms += self.terms()
        prefix = self.peek() == ("sign", "*")
        if prefix:
            self.take()
        return Phrase(tuple(terms), prefix, first)

    def terms(self) -> list[str]:
        kind, value = self.take()
        if kind not in ("word", "phrase") or (kind == "word" and value in ("AND", "OR", "NOT")):
            raise SyntaxFault(value)
        found = [w.lower() for w in re.findall(r"[^\W_]+", value)]
        return [porter(w) for w in found] if self.stemmed else found


def _phrase_hits(toks: DataFrame, phrase: Phrase) -> DataFrame:
    """(chunk_id, pos) of every place of the phrase."""
    hits = None
    for i, term in enumerate(phrase.terms):
        last = i == len(phrase.terms) - 1
        match = F.col("term").startswith(term) if phrase.prefix and last else F.col("term") == term
        here = toks.filter(match).select("chunk_id", (F.col("pos") - i).alias("pos"))
        hits = here if hits is None else hits.join(here, ["chunk_id", "pos"], "left_semi")
    if hits is None:
        return toks.limit(0).select("chunk_id", "pos")
    return hits.filter("pos = 0") if phrase.first else hits


def match(chunks: DataFrame, query: str, k: int = 50, stemmed: bool = True, sanitize: bool = False) -> DataFrame:
    """(chunk_id, score, rank) for one query in the query language, best first.

    A query that can't be parsed finds nothing, unless sanitize is set: then its words are ANDed.
    """
    try:
        tree = Parser(query, stemmed).parse()
    except SyntaxFault:
        plain = " ".join(re.findall(r"[^\W_]+", query)) if sanitize else ""
        if not plain:
            return chunks.limit(0).select("chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        tree = Parser(" ".join(f'"{w}"' for w in plain.split()), stemmed).parse()
    toks, lengths = tokens(chunks, stemmed), doc_lengths(chunks)
    leaves: list[Phrase] = []

    def ids(node) -> DataFrame:
        if isinstance(node, Phrase):
            leaves.append(node)
            return _phrase_hits(toks, node).select("chunk_id").distinct()
        if isinstance(node, Near):
            leaves.extend(node.phrases)
            # word positions of the phrases must lie within distance of each other
            found = None
            for i, p in enumerate(node.phrases):
                here = _phrase_hits(toks, p).withColumn(f"e{i}", F.col("pos") + len(p.terms)).withColumnRenamed("pos", f"s{i}")
                found = here if found is None else found.join(here, "chunk_id")
            starts = [F.col(f"s{i}") for i in range(len(node.phrases))]
            ends = [F.col(f"e{i}") for i in range(len(node.phrases))]
            span = (F.greatest(*starts) - F.least(*ends)) if len(starts) > 1 else F.lit(0)
            return found.filter(span <= node.distance).select("chunk_id").distinct()
        left, right = ids(node.left), None
        if isinstance(node, Without):
            kept = len(leaves)
            right = ids(node.right)
            del leaves[kept:]  # what is excluded doesn't score
            return left.join(right, "chunk_id", "left_anti")
        right = ids(node.right)
        return left.join(right, "chunk_id", "left_semi") if isinstance(node, Both) else left.union(right).distinct()

    matched = ids(tree)
    parts = None
    for i, leaf in enumerate(leaves):
        tf = _phrase_hits(toks, leaf).groupBy("chunk_id").agg(F.count("*").alias("tf")).withColumn("leaf", F.lit(i))
        parts = tf if parts is None else parts.unionByName(tf)
    df = parts.groupBy("leaf").agg(F.count("*").alias("df"))
    met = parts.join(df, "leaf").join(matched, "chunk_id", "left_semi").crossJoin(corpus(lengths)).join(lengths, "chunk_id")
    score = F.sum(idf(F.col("n_docs"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("avgdl")))
    scored = met.groupBy("chunk_id").agg(score.alias("score")).withColumn("query_id", F.lit(0))
    return top_k(scored, k).select("chunk_id", "score", "rank")


def delete_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def delete_path(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Removes paths from chunks, symbols, refs and edges (those that go out from a path's entities)."""
    paths = paths.select("path").distinct()
    gone = tables["chunks"].join(paths, "path", "left_semi").select("chunk_id")
    out = dict(tables)
    out["chunks"] = tables["chunks"].join(paths, "path", "left_anti")
    out["symbols"] = tables["symbols"].join(gone, "chunk_id", "left_anti")
    out["refs"] = tables["refs"].join(paths, F.col("from_path") == F.col("path"), "left_anti")
    # the path is the key's part before the first tab: an exact comparison, so that no wildcard can match more
    edges = tables["edges"].withColumn("__path", F.split("from_key", "\t")[0])
    out["edges"] = edges.join(paths, F.col("__path") == F.col("path"), "left_anti").drop("__path")
    return out
