"""The driver's search queries against a slow version: lists by plain loops, fused, reranked and rolled up in Python."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import __spark_entry__ as driver
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.config import Config
from corvane.functions import text as T
from corvane.functions.stem import porter
from corvane.operators import fulltext, fusion
from corvane.plans import search as plan
from corvane.plans.plugins import HashEmbedder
from corvane.queries import search as queries
from corvane.queries.base import relation

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(*fulltext._accents())


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def best(scores: dict[int, float], k: int, sign: int = -1) -> list[tuple[int, float]]:
    return sorted(scores.items(), key=lambda x: (sign * x[1], x[0]))[:k]


class Slow:
    """All documents, all queries and their lists {(query_id, source): [(chunk_id, score), ...]}, best first."""

    def __init__(self, spark):
        docs = relation(spark, SF, "chunks").collect()
        self.path = {r["chunk_id"]: r["path"] for r in docs}
        self.words = {r["chunk_id"]: words(r["content"] or "") for r in docs}
        self.tf = {i: Counter(porter(w.translate(FOLD)) for w in ws) for i, ws in self.words.items()}
        self.average = sum(map(len, self.words.values())) / len(docs)
        asked = relation(spark, SF, "queries")
        self.query = {r["query_id"]: r["query"] for r in asked.collect()}
        self.intent = dict(map(tuple, asked.select("query_id", T.query_intent(F.col("query"))).collect()))
        self.gone = {r["chunk_id"] for r in relation(spark, SF, "tombstones").collect()}
        self.lists = {(q, s): best(self.bm25(q, s == "fuzzy"), 50) for q in self.query for s in ("exact", "fuzzy")}
        symbols = defaultdict(list)
        for r in relation(spark, SF, "symbols").collect():
            symbols[r["name"]].append(r["chunk_id"])
        for q, text in self.query.items():
            if self.intent[q] != "natural":
                named = Counter(c for w in set(re.findall(r"\w+", text)) for c in symbols[w])
                self.lists[q, "symbol"] = best(dict(named), 50)
        embed = HashEmbedder(64).embed
        v = dict(map(tuple, relation(spark, SF, "chunks").select("chunk_id", embed(F.col("content"))).collect()))
        q = dict(map(tuple, asked.select("query_id", embed(F.col("query"))).collect()))
        self.v, self.q = ({k: np.array(x, dtype=np.float64) for k, x in t.items()} for t in (v, q))

    def bm25(self, q: int, prefixes: bool) -> dict[int, float]:
        scores, terms = defaultdict(float), {porter(w.translate(FOLD)) for w in words(self.query[q])}
        hits = Counter()
        for term in terms:
            tf = {i: sum(n for t, n in c.items() if t.startswith(term)) if prefixes else c[term] for i, c in self.tf.items()}
            tf = {i: n for i, n in tf.items() if n}
            idf = max(math.log((len(self.tf) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6)
            for i, n in tf.items():
                hits[i] += 1
                scores[i] += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(self.words[i]) / self.average))
        return {i: round(s, 6) for i, s in scores.items() if hits[i] == len(terms)}

    def hamming(self, q: int) -> list[tuple[int, float]]:
        return best({i: float(((x > 0) != (self.q[q] > 0)).sum()) for i, x in self.v.items()}, 200, 1)

    def cosine(self, q: int) -> list[tuple[int, float]]:
        norm = np.linalg.norm
        fine = best({i: round(1 - float(x @ self.q[q]) / ((norm(x) or 1) * (norm(self.q[q]) or 1)), 6) for i, x in self.v.items()}, 50, 1)
        coarse = {i for i, _ in self.hamming(q)}
        return [x for x in fine if x[0] in coarse] or fine

    def found(self, lists: dict, weights: dict | None, k: int = 20) -> dict[tuple[int, int], tuple[int, float]]:
        """{(query_id, rank): (chunk_id, score)}; ranks are places in lists; weights by source, or by intent."""
        out = {}
        for q, text in self.query.items():
            weigh = weights or dict(zip(fusion.SOURCES, fusion.WEIGHTS[self.intent[q]], strict=True))
            fused = defaultdict(float)
            for (of, source), ranked in lists.items():
                for item in ranked if of == q else ():
                    fused[item[0]] += weigh[source] / (60 + item[-1])
            pool = best({i: round(s, 9) for i, s in fused.items() if i not in self.gone}, 50)
            asked = set(words(text))
            mixed = {i: round(0.7 * len(asked & set(self.words[i])) / len(asked) + (0.3 * s / pool[0][1] if pool[0][1] else 0), 6) for i, s in pool}
            out |= {(q, at): x for at, x in enumerate(best(mixed, k), 1)}
        return out


def placed(lists: dict) -> dict:
    """Lists with the place of each row."""
    return {k: [(i, s, at) for at, (i, s) in enumerate(v, 1)] for k, v in lists.items()}


@pytest.fixture(scope="module")
def slow(spark):
    return Slow(spark)


def same(got, want: dict[tuple[int, int], tuple[int, float]]) -> None:
    rows = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in got}
    assert rows.keys() == want.keys() and len(rows) == len(got) > 0
    assert {k: v[0] for k, v in rows.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(rows[k][1] - want[k][1]) < 2e-6 for k in rows)


def test_search_fast(spark, slow):
    got = driver.queries()["search_fast"](spark, SF).collect()
    same(got, slow.found(placed({k: v for k, v in slow.lists.items() if k[1] in plan.FAST_WEIGHTS}), plan.FAST_WEIGHTS))
    assert all(r["path"] == slow.path[r["chunk_id"]] for r in got)


def test_search_balanced(spark, slow):
    lists = placed(slow.lists | {(q, "vector"): slow.hamming(q) for q in slow.query})
    same(driver.queries()["search_balanced"](spark, SF).collect(), slow.found(lists, None))


def test_search_thorough(spark, slow):
    """Seeds, vectors, fusion and reranking by plain loops; both graph channels, which have tests of their own, from these seeds."""
    index, lists = queries._index(spark, SF), placed(slow.lists | {(q, "vector"): slow.cosine(q) for q in slow.query})
    for source, channel in (("graph", plan.graph_channel), ("entity", plan.entity_channel)):
        seeds = []
        for q in slow.query:
            top = defaultdict(lambda: -math.inf)
            for (of, _), ranked in lists.items():
                for i, score, _ in ranked if of == q else ():
                    top[i] = max(top[i], score)
            seeds += [(q, i, float(s), at) for at, (i, s) in enumerate(best(top, 10), 1)]
        found = defaultdict(list)
        for r in channel(index, spark.createDataFrame(seeds, "query_id long, doc_id long, score double, rank int"), Config()).collect():
            found[r["query_id"], source].append((r["doc_id"], r["score"], r["rank"]))
        assert found
        lists |= found
    same(driver.queries()["search_thorough"](spark, SF).collect(), slow.found(lists, None))


def test_search_files(spark, slow):
    found = slow.found(placed({k: v for k, v in slow.lists.items() if k[1] in plan.FAST_WEIGHTS}), plan.FAST_WEIGHTS, 50)
    want = defaultdict(lambda: defaultdict(list))
    for (q, rank), (i, score) in sorted(found.items()):
        want[q][slow.path[i]].append((i, score))
    got = defaultdict(list)
    for r in driver.queries()["search_files"](spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["path"], r["best_doc_id"], r["doc_ids"], r["rank"]))
    assert got and got == {
        q: [(p, rows[0][0], ",".join(str(i) for i, _ in rows), at) for at, (p, rows) in enumerate(sorted(files.items(), key=lambda f: (-f[1][0][1], f[0]))[:10], 1)]
        for q, files in want.items()}
