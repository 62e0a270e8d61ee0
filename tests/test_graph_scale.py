"""Graph operators where one chunk holds many symbols and many queries meet it: results by plain loops, rows by Spark's metrics."""

from __future__ import annotations

import __spark_entry__ as driver
import pytest

from corvane.operators import graph

SF = "/root/testdata/sf0.001"
SYMBOL = "id long, name string, kind string, chunk_id long"


def most_rows(df) -> int:
    """The most rows that a step of the plan has put out."""
    most, waiting = 0, [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            waiting.append(node.plan())
        else:
            rows = node.metrics().get("numOutputRows")
            most = max(most, rows.get().value() if rows.isDefined() else 0)
            waiting += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_one_hop_meets_names_once_a_chunk(spark):
    """300 queries in a chunk of 300 symbols: the names of the chunk aren't repeated for every query."""
    symbols = spark.createDataFrame([(i, f"s{i}", "class", i // 300) for i in range(900)], SYMBOL)
    refs = [(f"s{i}", "p", f"s{(i * 7 + 300) % 900}", "call" if i % 2 else "import", 1, i, None) for i in range(900)]
    refs = spark.createDataFrame(refs, "from_name string, from_path string, to_name string, ref_kind string, line int, from_symbol_id long, to_symbol_id long")
    scored = spark.createDataFrame([(q, q % 2, 1.0) for q in range(300)], "query_id long, chunk_id long, score double")
    want = {(q, q % 2): 1.0 for q in range(300)}
    for q in range(300):
        for i in range(900):
            a, b, w = i // 300, (i * 7 + 300) % 900 // 300, 1.5 if i % 2 else 1.0
            for own, to, way in ((a, b, 0.6), (b, a, 1.3)):
                if own == q % 2 and to != own:
                    want[q, to] = want.get((q, to), 0) + w * way / 4
    for edges in (graph.edge_chunks(refs, symbols), graph.edge_ends(refs, symbols)):
        df = graph.one_hop(scored, edges, symbols)
        got = {(r["query_id"], r["chunk_id"]): r["score"] for r in df.collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
        assert most_rows(df) <= 5000


@pytest.mark.parametrize("name", ["graph_traverse", "graph_search", "graph_one_hop"])
def test_symbols_are_not_broadcast_unread(spark, name):
    """By its compressed size a table of symbols looks small enough."""
    plan = driver.queries()[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_cooccurring_meets_the_beginnings_of_chunks(spark):
    symbols = [(i, f"{'_' if i % 11 == 0 else ''}{'Ab' if i % 3 else 'aB'}{i % 97:03d}", ("class", "variable")[i % 2], i % 4) for i in range(1000)]
    symbols += [(2000 + i, f"only{i}", "class", 7 + i // 3) for i in range(6)]
    terms = [(q, symbols[q * 3][1], at) for q in range(300) for at in (1, 2)] + [(900, f"only{i}", i + 1) for i in range(4)]
    terms += [(q, symbols[q * 3 + 4][1], 3) for q in range(300)]
    want = {}
    for q in {t[0] for t in terms}:
        own = {n for t, n, _ in terms if t == q}
        chunks = {c for _, n, _, c in symbols if n in own}
        first = {}
        for c, n in sorted((c, n) for _, n, kind, c in symbols if c in chunks and len(n) > 2 and (kind == "class" or n[0] != "_") and n.lower() not in {x.lower() for x in own}):
            first.setdefault(n.lower(), (c, n))
        for at, (_, n) in enumerate(sorted(first.values())[:5], 1):
            want[q, at] = n
    df = graph.cooccurring(spark.createDataFrame(terms, "query_id long, name string, rank int"), spark.createDataFrame(symbols, SYMBOL))
    assert {(r["query_id"], r["rank"]): r["name"] for r in df.collect()} == want
    assert most_rows(df) < 30_000
