"""BM25 and the query language against an embedded full-text engine and worked values."""

import sqlite3

import pytest

from corvane.operators import fulltext as op

DOCS = ["authentication token token user", "user login", "database pool user authenticate", "render", "token x y z w"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(list(enumerate(DOCS, 1)), "chunk_id long, content string").cache()


def test_bm25_known_score(spark, chunks):
    q = spark.createDataFrame([(0, "token user")], "query_id int, query string")
    rows = op.bm25(chunks, q, match_all=True).collect()
    assert [(r["chunk_id"], r["score"]) for r in rows] == [(1, 0.432257)]


@pytest.mark.parametrize(
    "query",
    ["token user", "user", "token OR login", "user NOT login", '"token user"', "authentic*", "auth*", "NEAR(database user, 3)", "NEAR(database authenticate, 1)", "^user", "(token OR render) AND x", "database pool", "zzz"])
def test_language_matches_reference_engine(chunks, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(c, tokenize='porter unicode61')")
    db.executemany("INSERT INTO t(rowid, c) VALUES (?, ?)", list(enumerate(DOCS, 1)))
    want = {i: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (query,))}
    got = {r["chunk_id"]: r["score"] for r in op.match(chunks, query).collect()}
    assert set(got) == set(want)
    if "NEAR" not in query:
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


@pytest.mark.parametrize("query", ["what is x?", "a.b", "foo(bar", "a AND", ""])
def test_syntax_faults_find_nothing(chunks, query):
    assert op.match(chunks, query).count() == 0


def test_sanitize(chunks):
    assert [r["chunk_id"] for r in op.match(chunks, "user login?", sanitize=True).collect()] == [2]


def test_prefix_search(spark, chunks):
    q = spark.createDataFrame([(0, "auth us"), (1, "zz")], "query_id int, query string")
    rows = op.prefix_search(chunks, q).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in rows} == {(0, 1), (0, 3)}


def test_empty_and_null(spark):
    c = spark.createDataFrame([(1, None), (2, "")], "chunk_id long, content string")
    q = spark.createDataFrame([(0, None), (1, "x")], "query_id int, query string")
    assert op.bm25(c, q).count() == 0
    assert {r["len"] for r in op.doc_lengths(c).collect()} <= {0}


def test_delete_path(spark):
    tables = {
        "chunks": spark.createDataFrame([("a_b", 1), ("axb", 2)], "path string, chunk_id long"),
        "symbols": spark.createDataFrame([(1, "s"), (2, "t")], "chunk_id long, name string"),
        "refs": spark.createDataFrame([("a_b", "x"), ("axb", "y")], "from_path string, to_name string"),
        "edges": spark.createDataFrame([("a_b\tfile", "z"), ("axb\tfile", "z")], "from_key string, to_key string"),
    }
    left = op.delete_path(tables, spark.createDataFrame([("a_b",)], "path string"))
    assert {k: v.count() for k, v in left.items()} == {"chunks": 1, "symbols": 1, "refs": 1, "edges": 1}
    assert left["edges"].first()["from_key"].startswith("axb")
