"""Shared pieces: checkpoints, row packing and vectorised tokenising of Arrow text batches."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised kernels (several 8-byte arrays of this length exist).
CHUNK_BYTES = 1 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="corvane-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pack(df: DataFrame) -> Column:
    """All columns of df as one struct, so that working columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def nulls_last(c: Column) -> Column:
    """Sort key that puts nulls after all values, usable inside min/max of structs."""
    return F.struct(c.isNull().alias("missing"), c.alias("value"))


# ---------------------------------------------------------------- vectorised text kernels

_rng = np.random.default_rng(20240521)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        step = np.full(size, _BASE if kind == "base" else _INVERSE, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash gets the hash of any span of values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power("base", len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal spans have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * _power("inverse", len(prefix))[start])


def text_chunks(column: pa.Array):
    """Splits a string array into (first row, last row, bytes, row offsets) chunks of about CHUNK_BYTES."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[65:91] = True
_LETTER[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of the first word of every row, with the total at the end).

    Words are runs of bytes other than ASCII white space or, with letters_only, runs of ASCII letters,
    digits and non-ASCII bytes. In scripts that are written without spaces (UTF-8 lead bytes from 0xE3)
    every character is a word of its own. No word crosses a row.
    """
    inside = _LETTER[data] if letters_only else ~_SPACE[data]
    n = len(data)
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    if n and (data >= 0xE3).any():
        lead = np.flatnonzero(data >= 0xE3)
        begins[lead] = True
        begins[np.minimum(lead + np.where(data[lead] >= 0xF0, 4, 3), n)] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside
    starts = np.flatnonzero(inside & (~before[:-1] | begins[:-1]))
    after = np.zeros(n + 1, dtype=bool)
    after[:-1] = inside
    ends = np.flatnonzero(inside & (~after[1:] | begins[1:])) + 1
    prefix = prefix_hash(_BYTE[data])
    return span_hash(prefix, starts, ends), np.searchsorted(starts, offsets)


#: Rows of a narrow table (ids, hashes) up to which it is sent whole to every executor: 32 MB or so.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, marked for broadcast if it has at most ``limit`` rows (counted), else left to a shuffle join.

    df should be cheap to count: a checkpoint or a written table of a few columns.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", limit: int | None = None) -> DataFrame:
    """Rows of docs whose id isn't in the only column of gone; rows with a null id stay."""
    gone = sized(checkpoint(gone.toDF("__gone")), limit)
    packed = docs.select(col(id_col).alias("__id"), pack(docs).alias("__row"))
    return packed.join(gone, packed["__id"] == gone["__gone"], "left_anti").select("__row.*")


#: Words of 64 bits of the largest filter that members() sends to every executor: 2**20 rows of two longs, 64 Mbit.
FILTER_WORDS = 1 << 20


def flagged(rows: DataFrame, keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """rows with a column member: true for all rows whose column h is in keys (h) and for few others, false for a null h.

    keys becomes a table of 64-bit words, one bit a hash, which is broadcast: it has as many rows as there are words with
    a bit, ``words`` at most, however many keys there are. So rows are judged where they are. With k keys about
    k / (64 * words) of the other rows are taken for members; nothing is ever missed.
    """
    bits = 64 * words
    place = F.pmod(F.xxhash64("h", F.lit(29)), F.lit(bits))
    bit = F.pmod(place, F.lit(64)).cast("int")
    one = F.lit(1).cast("long")
    table = keys.filter("h is not null").groupBy(F.shiftright(place, 6).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", one, bit)).alias("__bits"))
    placed = rows.withColumn("__word", F.shiftright(place, 6)).withColumn("__bit", F.when(F.col("h").isNotNull(), bit))
    met = placed.join(F.broadcast(table), "__word", "left")
    member = F.call_function("shiftright", F.col("__bits"), F.col("__bit")).bitwiseAND(one) == 1
    return met.withColumn("member", F.coalesce(member, F.lit(False))).drop("__word", "__bit", "__bits")


def members(rows: DataFrame, keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The rows that flagged() takes for members, with their columns."""
    return flagged(rows, keys, words).filter("member").drop("member")
