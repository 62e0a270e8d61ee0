"""Scans, chunkers, symbols, references and message operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import chunking, messages
from corvane.sources import files as op


def test_chunk_text_known():
    got = chunking.chunk_text("aaaa\n" * 5, 10, 2)
    assert [c[0] for c in got] == ["aaaa\naaaa\n"] + ["a\naaaa\n"] * 3
    assert [c[1:] for c in got] == [(1, 2), (2, 3), (3, 4), (4, 5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \té", max_size=30), max_size=30), st.integers(5, 60), st.integers(0, 20))
def test_chunk_text_covers_every_line(lines, size, overlap):
    text = "\n".join(lines)
    got = chunking.chunk_text(text, size, overlap)
    if not text.strip():
        assert got == []
        return
    assert got[0][1] == 1 and got[-1][2] == len(text.splitlines())
    for (a, _, end), (b, start, _) in zip(got, got[1:], strict=False):
        tail = a[-overlap:] if overlap else ""
        assert b.startswith(tail) and start <= end + 1
    rest = got[0][0] + "".join(b[len(a[-overlap:] if overlap else "") :] for (a, _, _), (b, _, _) in zip(got, got[1:], strict=False))
    assert rest == text


def test_chunk_code_cuts_at_definitions():
    text = "import x\n\ndef a():\n    pass\n\n\nclass B:\n    y = 1\n"
    assert [c[1:] for c in chunking.chunk_code(text, 29, 0)] == [(1, 2), (3, 6), (7, 8)]
    assert "".join(c[0] for c in chunking.chunk_code(text, 29, 0)) == text
    assert [c[1:] for c in chunking.chunk_ast(text, 40, 0)] == [(1, 4), (5, 8)]


def test_symbols_and_references():
    text = "import os.path\nfrom a.b import c\n\nclass K(Base):\n    def m(self, z: Thing):\n        return helper(z)\n"
    assert [(s[0], s[1], s[2], s[3], s[4]) for s in chunking.symbols_of("x.py", text)] == [("K", "class", 4, 6, None), ("m", "method", 5, 6, "K")]
    refs = chunking.references_of("x.py", text)
    assert {("", "os.path", "import", 1), ("", "a.b.c", "import", 2), ("K", "Base", "inherit", 4), ("m", "helper", "call", 6), ("m", "Thing", "type_ref", 5)} == set(refs)
    go = chunking.symbols_of("x.go", "func Run(a int) {\n  go()\n}\ntype T struct {\n}\n")
    assert [(s[0], s[2], s[3]) for s in go] == [("Run", 1, 3), ("T", 4, 5)]
    js = chunking.references_of("x.ts", "import {a} from './b'\nclass C extends D {\n  go() { call(1) }\n}\n")
    assert ("", "./b", "import", 1) in js and any(r[1] == "D" and r[2] == "inherit" for r in js) and any(r[1] == "call" for r in js)
    assert chunking.symbols_of("broken.py", "def (") == [] and chunking.references_of("a.txt", "x") == []


def test_gitignore(spark):
    rules = op.gitignore_rules(spark, [("", "*.log\nbuild/\n# note\n"), ("sub", "!keep.log\n/top.txt\n")])
    paths = spark.createDataFrame([(p,) for p in ("sub/keep.log", "a.log", "a/build/x", "build", "sub/top.txt", "sub/d/top.txt", "ok.py")], "path string")
    got = {r["path"]: r["ignored"] for r in op.gitignored(paths, rules).collect()}
    assert {p for p, bad in got.items() if bad} == {"sub/keep.log", "a.log", "a/build/x", "sub/top.txt"}


def test_noise(spark):
    rows = [("a.min.js", "x", 1), ("b.py", "", 0), ("c.py", "\0\0ab", 4), ("d.py", "# @generated\n", 13), ("e.py", "ok", 2_000_000), ("f.py", "fine", 4)]
    df = spark.createDataFrame(rows, "path string, content string, size long")
    got = [r["r"] for r in df.select(op.noise_reason(F.col("path"), F.col("content"), F.col("size")).alias("r"), "path").orderBy("path").collect()]
    assert got == ["extension", "empty", "binary", "generated", "too large", None]


def test_regex_lines_and_ranges(spark):
    f = spark.createDataFrame([("a", "x1\ny\nx2"), ("b", None)], "path string, content string")
    assert [(r["line"], r["text"]) for r in op.regex_lines(f, "x", 1).collect()] == [(1, "x1")]
    assert op.read_range(f, F.lit(2), F.lit(9)).filter("path = 'a'").first()["text"] == "2: y\n3: x2"


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("def go():\n  pass\n")
    (tmp_path / "node_modules" / "b.py").write_text("x")
    assert [r["path"] for r in op.scan(spark, str(tmp_path)).select("path").collect()] == ["src/a.py"]


@pytest.mark.parametrize("raw", ['{"symbols": ["a", ""], "concepts": "c", "error_terms": 5}', 'text {"symbols": ["a"], "concepts": "c"} text'])
def test_extraction(spark, raw):
    parts = spark.range(1).select(messages.extraction(F.lit(raw)).alias("p")).first()["p"]
    assert (parts["symbols"], parts["concepts"], parts["error_terms"], parts["sub_queries"]) == (["a"], ["c"], [], [])


def test_extraction_of_noise(spark):
    parts = spark.range(1).select(messages.extraction(F.lit("no json")).alias("p")).first()["p"]
    assert all(parts[f] == [] for f in messages.FIELDS)


def test_greedy_batches(spark):
    rows = spark.createDataFrame([("g", 0, 10), ("g", 1, 10), ("g", 2, 1), ("h", 0, 99)], "grp string, id long, tokens long")
    got = {(r["grp"], r["id"]): r["batch"] for r in chunking.greedy_batches(rows, 20, 32).collect()}
    assert got == {("g", 0): 0, ("g", 1): 0, ("g", 2): 1, ("h", 0): 0}
