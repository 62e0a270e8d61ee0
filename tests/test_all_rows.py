"""Queries over whole tables, where their namesakes without _all take a part, against brute force and SQL."""

import __spark_entry__ as driver
import pytest
from tools import compare

from corvane.operators import lookups
from corvane.queries.base import relation

SF = "/root/testdata/sf0.01"


def test_grep_terms_of_every_query(spark):
    asked = {r["query_id"]: r["query"] for r in relation(spark, SF, "graph_queries").collect()}
    assert any(q.startswith("find ") for q in asked.values())
    want = {}
    for i, q in asked.items():
        name = q.removeprefix("find ")
        terms = (["find"] if q.startswith("find ") else []) + [name] + [p for p in name.split("_") if len(p) >= 3]
        want[i] = " ".join(dict.fromkeys(terms))
    assert {r["query_id"]: r["terms"] for r in driver.queries()["grep_terms_all"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["grep_terms_all", "refs_from_all", "refs_to_all", "cross_refs_all"])
def test_equals_sql(spark, name):
    assert compare.compare(spark, SF, [name])[name].startswith("ok ")


def test_references_of_every_name(spark):
    rows = [("a", "b", 1), ("b", "a", 2), ("x", "a", 3), ("x", "y", 4), ("a", "a", 5), (None, "b", 6)]
    refs = spark.createDataFrame(rows, "from_name string, to_name string, line int")
    names = spark.createDataFrame([("a",), ("b",), ("b",), ("none",)], "name string")
    got = sorted((r["name"], r["line"], r["direction"]) for r in lookups.cross_refs_each(refs, names).collect())
    each = [(n, r["line"], r["direction"]) for n in ("a", "b", "none") for r in lookups.cross_refs(refs, n).collect()]
    assert got == sorted(each) and len(got) == 8
