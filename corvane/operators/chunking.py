"""Chunkers: text packed by lines, code cut at definitions or by syntax tree; symbols and references of source files.

Chunkers are sequential within a file and run in Arrow batches, one file at a time; nothing is exchanged.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import LANGUAGES, with_concepts

_LANGUAGE_OF = {e: language for language, extensions in LANGUAGES.items() for e in extensions}
CODE_EXTENSIONS = frozenset(_LANGUAGE_OF)
#: What begins a definition at the top level, by family of languages.
BOUNDARY = re.compile(
    "|".join((
        r"(?:export\s+)?(?:async\s+)?(?:class|def|function)\s",
        r"(?:pub\s+)?(?:enum|fn|impl|mod|struct|trait)\s",
        r"(?:type|func)\s",
        r"(?:(?:internal|private|protected|public)\s*)?(?:static\s+)?(?:class|enum|interface|record)\s",
        r"(?:template|namespace)\s",
    )))

Chunk = tuple[str, int, int]


def language_of(path: str) -> str | None:
    return _LANGUAGE_OF.get(path.rsplit("/", 1)[-1].rpartition(".")[2].lower()) if "." in path.rsplit("/", 1)[-1] else None


def chunk_text(text: str, max_chars: int = 800, overlap: int = 100) -> list[Chunk]:
    """(text, first line, last line) of chunks of whole lines up to max_chars; each begins with the last characters of the one before."""
    if not text.strip():
        return []
    out: list[Chunk] = []
    held, size, start, n = [], 0, 1, 0
    for n, line in enumerate(text.splitlines(keepends=True), 1):
        if held and size + len(line) > max_chars:
            whole = "".join(held)
            out.append((whole, start, n - 1))
            tail = whole[-overlap:] if overlap else ""
            start = max(1, n - tail.count("\n"))
            held, size = ([tail] if tail else []), len(tail)
        held.append(line)
        size += len(line)
    out.append(("".join(held), start, n))
    return out


def _assemble(lines: list[str], cuts: list[int], max_chars: int, overlap: int) -> list[Chunk]:
    """Segments between cuts, small neighbours merged, large ones cut by chunk_text."""
    bounds = [*cuts, len(lines)]
    merged: list[list[int]] = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        size = sum(map(len, lines[a:b]))
        if merged and merged[-1][2] + size <= max_chars:
            merged[-1][1:] = [b, merged[-1][2] + size]
        else:
            merged.append([a, b, size])
    out: list[Chunk] = []
    for a, b, size in merged:
        part = "".join(lines[a:b])
        out += [(t, s + a, e + a) for t, s, e in chunk_text(part, max_chars, overlap)] if size > max_chars else [(part, a + 1, b)]
    return out


def boundaries(lines: list[str]) -> list[int]:
    """Lines, from 0, that begin a definition with at most 4 blanks before it."""
    return [i for i, line in enumerate(lines) if len(line) - len(line.lstrip()) <= 4 and BOUNDARY.match(line.lstrip())]


def chunk_code(text: str, max_chars: int = 800, overlap: int = 100) -> list[Chunk]:
    """Cut at definitions found by pattern; without any as chunk_text."""
    lines = text.splitlines(keepends=True)
    cuts = sorted({0, *boundaries(lines)})
    return chunk_text(text, max_chars, overlap) if len(cuts) < 2 else _assemble(lines, cuts, max_chars, overlap)


def chunk_ast(text: str, max_chars: int = 800, overlap: int = 100) -> list[Chunk]:
    """Python cut at the statements of its syntax tree that define something; what lies between goes with the next."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    ends = [n.end_lineno for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    if not ends:
        return []
    lines = text.splitlines(keepends=True)
    return _assemble(lines, sorted({0, *[e for e in ends if e < len(lines)]}), max_chars, overlap)


def smart_chunks(path: str, text: str, max_chars: int = 800, overlap: int = 100) -> list[Chunk]:
    """By syntax tree, else by pattern for code, else by lines."""
    language = language_of(path)
    out = chunk_ast(text, max_chars, overlap) if language == "python" else []
    if not out and language:
        out = chunk_code(text, max_chars, overlap)
    return out or chunk_text(text, max_chars, overlap)


# ---------------------------------------------------------------- symbols and references

Symbol = tuple[str, str, int, int, str | None, str]
_SHAPES = {
    "javascript": r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?P<k>function|class)\s*\*?\s+(?P<n>[\w$]+)|(?:export\s+)?(?:const|let)\s+(?P<v>[\w$]+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
    "typescript": r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?P<k>function|class|interface|enum)\s+(?P<n>[\w$]+)|(?:export\s+)?(?:const|let)\s+(?P<v>[\w$]+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>",
    "go": r"(?P<k>func)\s+(?:\([^)]*\)\s*)?(?P<n>\w+)|type\s+(?P<t>\w+)\s+(?:struct|interface)",
    "java": r"(?:(?:public|private|protected|static|final|abstract)\s+)*(?P<k>class|interface|enum|record)\s+(?P<n>\w+)|(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ]+\s+(?P<m>\w+)\s*\(",
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?P<k>fn|struct|enum|trait|impl|mod)\s+(?:<[^>]*>\s*)?(?P<n>\w+)",
    "c": r"(?:[\w*]+\s+)+\*?(?P<m>\w+)\s*\([^;]*$|(?P<k>struct|enum)\s+(?P<n>\w+)\s*\{",
    "cpp": r"(?P<k>class|struct|enum|namespace)\s+(?P<n>\w+)|(?:[\w:*&<>]+\s+)+\*?(?P<m>[\w:]+)\s*\([^;]*$",
}
_KINDS = {"fn": "function", "func": "function", "function": "function", "mod": "module", "namespace": "module", "record": "class", "struct": "struct"}


def symbols_of(path: str, text: str) -> list[Symbol]:
    """(name, kind, first line, last line, parent, signature) in order of the text."""
    language = language_of(path)
    if language == "python":
        return _python_symbols(text)
    shape = _SHAPES.get(language or "")
    if not shape:
        return []
    pattern, lines, out, open_ = re.compile(rf"^\s*(?:{shape})"), text.splitlines(), [], []
    depth = 0
    for i, line in enumerate(lines, 1):
        found = pattern.match(line)
        if found:
            g = found.groupdict()
            name = g.get("n") or g.get("v") or g.get("t") or g.get("m")
            word = g.get("k") or ("struct" if g.get("t") else "method" if g.get("m") else "function")
            if name not in ("if", "for", "while", "switch", "return", "else"):
                parent = next((out[k][0] for k, d in reversed(open_) if out[k][1] in ("class", "interface", "impl", "struct", "trait", "enum")), None)
                kind = _KINDS.get(word, word)
                out.append([name, "method" if kind == "function" and parent else "function" if kind == "method" and not parent else kind, i, i, parent, line.strip()])
                open_.append((len(out) - 1, depth))
        depth += line.count("{") - line.count("}")
        while open_ and depth <= open_[-1][1] and ("}" in line or i > out[open_[-1][0]][2]):
            out[open_.pop()[0]][3] = i
    for k, _ in open_:
        out[k][3] = len(lines)
    return [tuple(s) for s in out]


def _python_symbols(text: str) -> list[Symbol]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = text.splitlines(), []

    def go(node: ast.AST, parent: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                out.append((child.name, kind, child.lineno, child.end_lineno, parent, lines[child.lineno - 1].rstrip()))
                go(child, child.name, isinstance(child, ast.ClassDef))
            else:
                go(child, parent, in_class)

    go(tree, None, False)
    return out


_PRIMITIVES = frozenset("Any None Optional String bool boolean byte bytes char dict double error float float32 float64 int int32 int64 list long number object rune set short str string tuple uint void".split())
_CALL = re.compile(r"(?<![\w.$])(?:new\s+)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_NOT_CALLS = frozenset("catch class def elif else for fn func function if import interface new return sizeof super switch while with".split())
_IMPORTS = {
    "javascript": r"(?:import\b.*?from\s*|require\()\s*['\"]([^'\"]+)['\"]", "typescript": r"(?:import\b.*?from\s*|require\()\s*['\"]([^'\"]+)['\"]",
    "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;",
}
_INHERITS = re.compile(r"\b(?:extends|implements)\s+([\w.$]+(?:\s*,\s*[\w.$]+)*)")


def _enclosing(symbols: list[Symbol], line: int) -> str:
    around = [s for s in symbols if s[2] <= line <= s[3]]
    return min(around, key=lambda s: s[3] - s[2])[0] if around else ""


def references_of(path: str, text: str) -> list[tuple[str, str, str, int]]:
    """(from_name, to_name, kind, line): imports, calls, base classes and type annotations of Python; imports, calls and base
    types of JavaScript, TypeScript, Go and Java. Types of the language itself are left out."""
    language = language_of(path)
    symbols = symbols_of(path, text)
    out: list[tuple[str, str, str, int]] = []
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                out += [("", a.name, "import", node.lineno) for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out += [("", f"{node.module}.{a.name}" if node.module else a.name, "import", node.lineno) for a in node.names]
            elif isinstance(node, ast.Call):
                called = ast.unparse(node.func) if isinstance(node.func, ast.Name | ast.Attribute) else ""
                if called:
                    out.append((_enclosing(symbols, node.lineno), called.rsplit(".", 1)[-1], "call", node.lineno))
            elif isinstance(node, ast.ClassDef):
                out += [(node.name, ast.unparse(b).rsplit(".", 1)[-1], "inherit", node.lineno) for b in node.bases if isinstance(b, ast.Name | ast.Attribute)]
            elif isinstance(node, ast.arg | ast.AnnAssign) and isinstance(node.annotation, ast.Name | ast.Attribute):
                out.append((_enclosing(symbols, node.lineno), ast.unparse(node.annotation).rsplit(".", 1)[-1], "type_ref", node.lineno))
        return sorted({r for r in out if r[1] not in _PRIMITIVES}, key=lambda r: (r[3], r[2], r[1], r[0]))
    if language not in _IMPORTS:
        return []
    imports = re.compile(_IMPORTS[language])
    for i, line in enumerate(text.splitlines(), 1):
        found = imports.search(line)
        if found:
            out.append(("", found[1], "import", i))
            continue
        for names in _INHERITS.findall(line):
            out += [(_enclosing(symbols, i), n.strip(), "inherit", i) for n in names.split(",")]
        declared = {s[0] for s in symbols if s[2] == i}
        for name in _CALL.findall(line):
            last = name.rsplit(".", 1)[-1]
            if last not in _NOT_CALLS and last not in declared:
                out.append((_enclosing(symbols, i), last, "call", i))
    return sorted({r for r in out if r[1] not in _PRIMITIVES}, key=lambda r: (r[3], r[2], r[1], r[0]))


# ---------------------------------------------------------------- DataFrame forms


def _expand(files: DataFrame, each, schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """(path, ord, ...) of what each(path, content) lists for every file; null contents list nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (path, i, *row)
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if path is not None and text is not None
                for i, row in enumerate(each(path, text))
            ]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, schema)


def chunks(files: DataFrame, max_chars: int = 800, overlap: int = 100, mode: str = "smart") -> DataFrame:
    """(path, chunk_ix, content, start_line, end_line) of files (path, content); mode: smart, code or text."""
    cut = {"smart": lambda p, t: smart_chunks(p, t, max_chars, overlap), "code": lambda _, t: chunk_code(t, max_chars, overlap), "text": lambda _, t: chunk_text(t, max_chars, overlap)}[mode]
    return _expand(files, cut, "path string, chunk_ix int, content string, start_line int, end_line int",
                   ["path", "chunk_ix", "content", "start_line", "end_line"], [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()])


def symbols(files: DataFrame) -> DataFrame:
    """(path, ord, name, kind, start_line, end_line, parent_name, signature)."""
    return _expand(files, symbols_of, "path string, ord int, name string, kind string, start_line int, end_line int, parent_name string, signature string",
                   ["path", "ord", "name", "kind", "start_line", "end_line", "parent_name", "signature"],
                   [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()])


def references(files: DataFrame) -> DataFrame:
    """(from_path, ord, from_name, to_name, ref_kind, line)."""
    out = _expand(files, references_of, "path string, ord int, from_name string, to_name string, ref_kind string, line int",
                  ["path", "ord", "from_name", "to_name", "ref_kind", "line"], [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()])
    return out.withColumnRenamed("path", "from_path")


def context_header(path: Column, parent: Column, kind: Column, name: Column) -> Column:
    """Lines that tell the file and, where there is one, the class and the symbol."""
    return F.concat_ws("\n", F.concat(F.lit("// File: "), path), F.concat(F.lit("// Class: "), parent), F.concat(F.lit("// "), F.initcap(kind), F.lit(": "), name), F.lit(""))


def with_context(chunk_table: DataFrame, symbol_table: DataFrame) -> DataFrame:
    """chunks whose content begins with the context of their first line: that of the first symbol in order around it."""
    s = symbol_table.select("path", F.col("start_line").alias("s"), F.col("end_line").alias("e"), "ord", "name", "kind", "parent_name")
    met = chunk_table.join(s, "path", "left")
    inside = F.col("start_line").between(F.col("s"), F.col("e"))
    first = met.groupBy(*chunk_table.columns).agg(F.min_by(F.struct("parent_name", "kind", "name"), F.when(inside, F.col("ord"))).alias("f"))
    header = context_header(F.col("path"), F.col("f.parent_name"), F.col("f.kind"), F.col("f.name"))
    return first.withColumn("content", F.concat(header, "content")).drop("f")


def tagged(chunk_table: DataFrame) -> DataFrame:
    return chunk_table.withColumn("content", with_concepts(F.col("content")))


def chunk_hash(file_hash: Column, chunk_ix: Column) -> Column:
    return F.concat_ws(":", file_hash, chunk_ix.cast("string"))


def greedy_batches(texts: DataFrame, max_tokens: int = 8192, max_items: int = 32) -> DataFrame:
    """(grp, id, batch): items (grp, id, tokens) of every group put in order into batches of at most max_tokens and max_items;
    an item beyond max_tokens is cut to it."""

    def run(frame):
        frame = frame.sort_values("id")
        out, total, n, batch = [], 0, 0, 0
        for t in frame["tokens"].clip(upper=max_tokens):
            if n and (total + t > max_tokens or n >= max_items):
                batch, total, n = batch + 1, 0, 0
            total, n = total + t, n + 1
            out.append(batch)
        return frame.assign(batch=out)[["grp", "id", "batch"]]

    return texts.select("grp", "id", "tokens").groupBy("grp").applyInPandas(run, "grp string, id long, batch long")
