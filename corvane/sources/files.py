"""File tables: scan, exclusion rules, gitignore, literal and regex line search, line ranges, sinks."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.config import Config


def scan(spark: SparkSession, root: str, glob: str = "*", config: Config = Config()) -> DataFrame:
    """(path, mtime, size, content) of the files under root, without excluded directories. content is read only if used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace("path", rf"^(file:)?/*{re.escape(base.lstrip('/'))}/", "")
    out = files.select(relative.alias("path"), (F.col("modificationTime").cast("double")).alias("mtime"), F.col("length").alias("size"), "content")
    return out.filter(~excluded_dir(F.col("path"), config.exclude_dirs))


def decode(content: Column) -> Column:
    """UTF-8 text; faulty bytes become replacement characters."""
    return F.decode(F.encode(F.make_valid_utf8(content.cast("string")), "UTF-8"), "UTF-8")


def excluded_dir(path: Column, names: tuple[str, ...] = Config.exclude_dirs) -> Column:
    """Whether some component of the path is one of the names; ``*`` in a name stands for anything, all else is literal."""
    plain, wild = [n for n in names if "*" not in n], [n for n in names if "*" in n]
    found = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in plain])) if plain else F.lit(False)
    for name in wild:
        found = found | path.rlike("(^|/)" + ".*".join(re.escape(part) for part in name.split("*")).replace(".*", "[^/]*") + "(/|$)")
    return found


def noise_reason(path: Column, content: Column, size: Column, config: Config = Config(), null_bytes: Column | None = None) -> Column:
    """Why a file isn't indexed, or null: extension, too large, empty, binary, generated; the first that holds.

    content is text or bytes; null_bytes, where given, is the share of NUL in its first bytes.
    """
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.lit(False)
    for e in config.exclude_extensions:
        extension = extension | name.endswith(e)
    if null_bytes is None:
        sample = F.hex(F.substring(content.cast("binary"), 1, config.binary_sample_bytes))
        pairs = F.regexp_replace(sample, "(..)", "$1 ")
        null_bytes = F.regexp_count(pairs, F.lit("00 ")) / F.greatest(F.length(sample) / 2, F.lit(1))
    head = F.substring(content.cast("string"), 1, 1024)
    generated = F.lit(False)
    for marker in config.generated_markers:
        generated = generated | F.contains(head, F.lit(marker))
    return (
        F.when(extension, "extension").when(size > config.max_file_size_bytes, "too large").when(size == 0, "empty")
        .when(null_bytes > config.binary_null_threshold, "binary").when(generated, "generated"))


def gitignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression for a path below the file's directory, whether it re-includes); None for blanks and comments."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negate = line.startswith("!")
    line = line[1:] if negate else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out = ""
    i = 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i:]:
            end = line.index("]", i + 1)
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), negate


def gitignore_rules(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """(dir, ord, regex, negate) of gitignore files (directory, text)."""
    rows = []
    for folder, text in files:
        for ord_, line in enumerate(text.splitlines()):
            made = gitignore_regex(line)
            if made:
                rows.append((folder.strip("/"), ord_, *made))
    return spark.createDataFrame(rows, "dir string, ord int, regex string, negate boolean")


def gitignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored): in each directory above a path the last rule that matches decides; any directory that ignores it wins."""
    above = paths.select("path").distinct().withColumn("parts", F.split("path", "/"))
    depth = F.sequence(F.lit(0), F.size("parts") - 1)
    dirs = above.select("path", F.explode(F.transform(depth, lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))).alias("dir"))
    met = dirs.join(rules, "dir").withColumn("rest", F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)")))
    hit = met.filter(F.regexp_like("rest", "regex")).groupBy("path", "dir").agg(F.max_by("negate", "ord").alias("negate"))
    bad = hit.filter("not negate").select("path").distinct().withColumn("ignored", F.lit(True))
    return above.select("path").join(bad, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def find_files(paths: DataFrame, glob: str, k: int = 100) -> DataFrame:
    """Paths that match the glob, the first k in order."""
    regex = fnmatch.translate(glob.replace("**/", "*")).removesuffix(r"\Z").removesuffix(r"\z").replace("(?s:", "(?s:", 1)
    return paths.select("path").distinct().filter(F.col("path").rlike(f"^{regex}$")).orderBy("path").limit(k)


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text) of every line, counted from 1."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def regex_lines(files: DataFrame, pattern: str, per_file: int = 50, k: int | None = None) -> DataFrame:
    """Lines that match, the first per_file of each path; files without a match aren't split."""
    found = lines(files.filter(F.col("content").rlike(f"(?m){pattern}"))).filter(F.col("text").rlike(pattern))
    order = Window.partitionBy("path").orderBy("line")
    out = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= per_file).drop("at")
    return out if k is None else out.orderBy("path", "line").limit(k)


def grep_count(files: DataFrame, terms: list[str], k: int = 50) -> DataFrame:
    """(path, n): files by number of lines with one of the first 8 terms, whatever the case."""
    pattern = "(?i)(" + "|".join(re.escape(t) for t in terms[:8]) + ")"
    hits = F.size(F.filter(F.split("content", "\n"), lambda t: t.rlike(pattern)))
    counted = files.select("path", hits.cast("long").alias("n")).filter("n > 0").groupBy("path").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.desc("n"), "path").limit(k)


def read_range(files: DataFrame, start: Column, end: Column) -> DataFrame:
    """(path, text): lines start to end, inclusive and from 1, each with its number."""
    part = F.slice(F.split("content", "\n"), start, F.greatest(end - start + 1, F.lit(0)))
    numbered = F.transform(part, lambda t, i: F.concat((i + start).cast("string"), F.lit(": "), t))
    return files.select("path", F.array_join(numbered, "\n").alias("text"))


def batch_read(files: DataFrame, wanted: DataFrame, max_files: int = 20, max_lines: int = 200) -> DataFrame:
    """read_range over requests (path, start, end), the first max_files of them, max_lines each at most."""
    few = wanted.orderBy("path", "start").limit(max_files)
    met = files.join(few, "path").withColumn("end", F.least("end", F.col("start") + max_lines - 1))
    return read_range(met, F.col("start"), F.col("end"))


def jsonl(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(json): every row as a JSON object."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in order or rows.columns])).alias("json"))


def parse_matches(text: DataFrame) -> DataFrame:
    """(path, line, text) of lines 'path:line: text' in a column raw."""
    each = text.select(F.explode(F.split("raw", "\n")).alias("l")).filter(F.col("l").rlike(r"^.+?:\d+:"))
    return each.select(F.regexp_extract("l", r"^(.+?):(\d+):\s?(.*)$", 1).alias("path"), F.regexp_extract("l", r"^(.+?):(\d+):\s?(.*)$", 2).cast("int").alias("line"), F.regexp_extract("l", r"^(.+?):(\d+):\s?(.*)$", 3).alias("text"))
