"""search_thorough with both graph channels by plain loops, and hand-made cases of the entity graph."""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque

import __spark_entry__ as driver
from test_search_queries import SF, Slow, best, placed, same

from corvane.config import Config
from corvane.operators import graph, lookups
from corvane.plans import search as plan
from corvane.queries import search as queries

KINDS = {"class", "function", "method", "module"}
SYMBOL = "id long, chunk_id long, name string, kind string, start_line int, end_line int"
EDGE = "from_key string, to_key string, edge_kind string, weight double"


class Graphs:
    """Both graph channels of one query from the ids of its seed chunks, best first."""

    def __init__(self, index: plan.Index):
        self.path = {r["chunk_id"]: r["path"] for r in index.chunks.select("chunk_id", "path").collect()}
        self.named, self.inside, self.out, self.into = (defaultdict(list) for _ in range(4))
        for r in sorted(index.symbols.collect(), key=lambda r: r["id"]):
            self.named[r["name"]].append(r)
            self.inside[r["chunk_id"]].append(r)
        for r in index.refs.collect():
            self.out[r["from_name"]].append(r)
            self.into[r["to_name"]].append(r)
        self.edges = defaultdict(Counter)
        for r in index.entity_edges.collect():
            if all(k.split("\t")[1] in KINDS | {"file"} for k in (r["from_key"], r["to_key"])):
                self.edges[r["from_key"]][r["to_key"]] += r["weight"]

    def chunk(self, name: str, of: int | None) -> int | None:
        found = self.named[name]
        return next((r["chunk_id"] for r in found if r["id"] == of), found[0]["chunk_id"] if found else None)

    def steps(self, name: str) -> list[tuple[int | None, float]]:
        forward = [(self.chunk(r["to_name"], r["to_symbol_id"]), graph.KIND_WEIGHTS.get(r["ref_kind"], 0.3) * 0.6) for r in self.out[name]]
        return forward + [(self.chunk(r["from_name"], r["from_symbol_id"]), graph.KIND_WEIGHTS.get(r["ref_kind"], 0.3) * 1.3) for r in self.into[name]]

    def graph(self, seeds: list[int]) -> list[tuple[int, float]]:
        scores, further = defaultdict(float), defaultdict(float)
        first = {}
        for c in seeds:
            for r in self.inside[c]:
                first.setdefault(r["name"], c)
        for name, c in first.items():
            scores[c] += 1
            for to, w in self.steps(name):
                if to not in (None, c):
                    scores[to] += w
        for c in scores:
            for r in self.inside[c]:
                for to, w in self.steps(r["name"]):
                    if to is not None and to not in scores:
                        further[to] += w / 4
        return best({c: round(x, 6) for c, x in (scores | further).items() if c not in seeds}, 50)

    def start(self, seeds: list[int]) -> list[str]:
        keys = {}
        for c in seeds:
            keys[f"{self.path[c]}\tfile\t\t0\t0"] = None
            for r in self.inside[c]:
                key = "\t".join(map(str, (self.path[c], r["kind"], r["name"], r["start_line"], r["end_line"])))
                if r["kind"] in KINDS and key not in keys:
                    keys[key] = None
                    if len(keys) >= 25:
                        return list(keys)
        return list(keys)

    def chunks(self, key: str) -> list[int]:
        path, kind, name, start, end = key.split("\t")
        if kind == "file":
            return [c for c, p in self.path.items() if p == path]
        return [r["chunk_id"] for r in self.named[name] if (r["kind"], str(r["start_line"]), str(r["end_line"]), self.path.get(r["chunk_id"])) == (kind, start, end, path)][:3]

    def entity(self, seeds: list[int]) -> list[tuple[int, float]]:
        start = self.start(seeds)
        seen, gains, scores, waiting = set(start), defaultdict(float), defaultdict(float), deque((k, 1, 1.0) for k in start)
        while waiting:
            key, depth, score = waiting.popleft()
            for to, w in self.edges[key].items():
                if to not in start:
                    gains[to] += score * w / depth
                    if to not in seen and depth < 2:
                        waiting.append((to, depth + 1, score * w / depth))
                    seen.add(to)
        for key, x in gains.items():
            for c in self.chunks(key):
                if c not in seeds:
                    scores[c] += x
        return best({c: round(x, 6) for c, x in scores.items()}, 50)


def test_search_thorough_with_graphs(spark):
    slow, graphs = Slow(spark), Graphs(queries._index(spark, SF))
    lists = placed(slow.lists | {(q, "vector"): slow.cosine(q) for q in slow.query})
    for source, channel in (("graph", graphs.graph), ("entity", graphs.entity)):
        found = {}
        for q in slow.query:
            top = defaultdict(lambda: -math.inf)
            for (of, _), ranked in lists.items():
                for i, score, _ in ranked if of == q else ():
                    top[i] = max(top[i], score)
            found[q, source] = channel([i for i, _ in best(top, 10)])
        assert any(found.values())
        lists |= placed(found)
    same(driver.queries()["search_thorough"](spark, SF).collect(), slow.found(lists, None))


def entities(spark, symbols: list[tuple], links: list[tuple[str, str, float]]) -> list[tuple[int, float]]:
    """The entity channel from chunk 1; symbols (id, chunk_id, name, kind), each chunk in a file f<chunk_id>."""
    key = {name: f"f{c}\t{kind}\t{name}\t1\t2" for _, c, name, kind in symbols}
    edges = [(key.get(a, a), key.get(b, b), "call", w) for a, b, w in links]
    chunks = spark.createDataFrame([(c, f"f{c}", "") for c in sorted({s[1] for s in symbols})], "chunk_id long, path string, content string")
    index = plan.Index(chunks, symbols=spark.createDataFrame([(*s, 1, 2) for s in symbols], SYMBOL), entity_edges=spark.createDataFrame(edges, EDGE))
    seeds = spark.createDataFrame([(1, 1, 1.0, 1)], "query_id long, doc_id long, score double, rank int")
    return [(r["doc_id"], r["score"]) for r in plan.entity_channel(index, seeds, Config()).orderBy("rank").collect()]


def test_variables_are_no_entities(spark):
    symbols = [(1, 1, "A", "class"), (2, 2, "v", "variable"), (3, 3, "C", "class"), (4, 4, "d", "function")]
    assert entities(spark, symbols, [("A", "v", 1.0), ("v", "C", 1.0), ("A", "d", 1.0), ("broken", "C", 1.0), ("A", "broken", 1.0)]) == [(4, 1.0)]


def test_entity_scores_tie_by_chunk(spark):
    symbols = [(1, 1, "A", "class"), (2, 3, "B", "class"), *((10 + i, 2, f"s{i}", "function") for i in range(10))]
    assert entities(spark, symbols, [("A", "B", 1.0), *(("A", f"s{i}", 0.1) for i in range(10))]) == [(2, 1.0), (3, 1.0)]


def test_seed_entities_end_with_a_symbol(spark):
    """With three at most the third is a file; the symbol after it is the last."""
    chunks = spark.createDataFrame([(c, f"f{c}") for c in (1, 2, 3)], "chunk_id long, path string")
    symbols = spark.createDataFrame([(1, 1, "A", "class", 1, 2), (2, 2, "b", "function", 1, 2), (3, 2, "c", "method", 1, 2), (4, 3, "D", "class", 1, 2)], SYMBOL)
    seeds = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 2)], "query_id long, chunk_id long, rank int")
    got = lookups.seed_entities(seeds, symbols, chunks, 3).orderBy("query_id", "ord").collect()
    want = ["f1\tfile\t\t0\t0", "f1\tclass\tA\t1\t2", "f2\tfile\t\t0\t0", "f2\tfunction\tb\t1\t2"]
    assert [(r["query_id"], r["key"], r["ord"]) for r in got] == [(q, k, at) for q in (1, 2) for at, k in enumerate(want, 1)]
    # files alone don't end the list
    bare = lookups.seed_entities(seeds, symbols.filter("id > 4"), chunks, 2).filter("query_id = 1")
    assert bare.count() == 3
