"""BPE encoding and decoding over a distinct-word table.

Texts are split into words in Spark by the tokenizer's own pattern; merges never cross those words. Encoding:

1. The documents of a partition become chunks of about ``CHUNK_WORDS`` words: the chunk's distinct words, each of which has
   a slot, and for every document the slots of its words in order.
2. (slot, word) pairs of all chunks are exchanged by word and sorted. Equal words are neighbours then, and each distinct word
   of the corpus is encoded once, where it first comes.
3. Ids go back to their slots and chunks to the same place, by chunk; the ids are joined back by position. A slot
   without ids is an error, so nothing is ever encoded twice or left out in silence. Chunks are made once for each
   of the two exchanges, which costs less than to keep them; that both are the same is checked by a digest.

So of documents only slots move (a byte or two a word), and nothing is broadcast.

Decoding is the mirror image: rows become chunks with their distinct ids, these are joined with the table (id, piece) of the
vocabulary, and the pieces are joined back by position. The table is broadcast if it is small (counted) and exchanged
otherwise. A broadcast join keeps the order of its rows, so then texts are put together without any exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common, tokens

#: White space as the tokenizer's regex engine has it; Java's \s is ASCII only.
_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
JAVA_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def split_words(text: Column) -> Column:
    """The words of a text, which concatenate to it; null for null, an empty array for an empty text."""
    return F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))


def _ids(encoding, words: list[str]) -> list[list[int]]:
    single, ranks, out = encoding._core_bpe.encode_single_piece, encoding._mergeable_ranks, []
    for word in words:
        raw = word.encode()
        known = ranks.get(raw)
        out.append([known] if known is not None else single(raw))
    return out


#: Words of a chunk: a document is never cut. A chunk is held by one task, with its distinct words' ids.
CHUNK_WORDS = 4_000_000
#: Ids of a chunk when decoding; it isn't exchanged, so it may be smaller.
CHUNK_TOKENS = 1_000_000
#: Bits of the number of a slot, of the number of a chunk in its partition, and of the partition.
_SLOT, _IN_PART, _PART = 28, 14, 21


#: Stands for the slot of the row that carries a chunk's check.
_CHECK = (1 << _SLOT) - 1


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit integers as bytes: all lowest bytes, then all second ones, and so on, which compress well."""
    planes = np.concatenate([np.array([len(a) for a in arrays], np.int32), *[a.astype(np.int32) for a in arrays]]).view(np.uint8).reshape(-1, 4).T.tobytes()
    return b"\0" + planes if len(planes) < 256 else b"\1" + zstandard.ZstdCompressor(level=3).compress(planes)


def _unsqueeze(blob: bytes, n: int) -> list[np.ndarray]:
    """The n arrays that _squeeze put together."""
    planes = blob[1:] if blob[:1] == b"\0" else zstandard.ZstdDecompressor().decompress(blob[1:])
    flat = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    return np.split(flat[n:], np.cumsum(flat[: n - 1])) if n > 1 else [flat[n:]]


class _Chunk:
    """Documents as slots of their distinct words. Batches are dictionary-coded as they come, so their words aren't held."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        lists = batch.column("words")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        self.parts.append((batch.column("doc_id"), np.asarray(lists.is_valid()), np.diff(offsets), coded))
        self.size += len(coded)

    def close(self, name: int) -> "_Chunk":
        ids, valid, sizes, coded = zip(*self.parts, strict=True)
        self.name, self.parts = name, []
        self.ids, self.valid, self.sizes = pa.concat_arrays(ids), np.concatenate(valid), np.concatenate(sizes)
        whole = pa.chunked_array(coded).unify_dictionaries()
        self.slots, self.words = np.concatenate([np.asarray(c.indices) for c in whole.chunks]), whole.chunk(0).dictionary
        if len(self.words) >= _CHECK:
            raise ValueError("too many distinct words in one document")
        data = self.words.buffers()
        self.check = int.from_bytes(hashlib.blake2b(bytes(data[1])[: 4 * (len(self.words) + 1)] + bytes(data[2] or b""), digest_size=7).digest(), "big")
        return self

    def documents(self) -> bytes:
        ids = self.ids.fill_null(0).to_numpy().view(np.int32)
        return _squeeze(ids, np.asarray(self.ids.is_valid()), self.valid, self.sizes, self.slots)


def _chunks(batches: Iterator[pa.RecordBatch], chunk_words: int) -> Iterator[_Chunk]:
    now, name, part = _Chunk(), 0, None
    for batch in batches:
        for piece in _slices(batch, batch.column("words"), chunk_words):
            if part is None:
                part = piece.column("part")[0].as_py()
            now.add(piece)
            if now.size >= chunk_words:
                yield now.close((part << _IN_PART) + name)
                now, name = _Chunk(), name + 1
            if name >> _IN_PART or part >> _PART:
                raise ValueError("too many chunks in a partition, or partitions")
    if now.parts:
        yield now.close((part << _IN_PART) + name)
    del now
    # workers are kept for later tasks: they give back what they don't use
    pa.default_memory_pool().release_unused()


def _pairs(chunk_words: int):
    """(at, word) of every slot, and of every chunk its check; at holds the chunk in its upper bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, chunk_words):
            first = chunk.name << _SLOT
            yield pa.RecordBatch.from_arrays([pa.array([first + _CHECK]), pa.array([str(chunk.check)])], names=["at", "word"])
            for lo in range(0, len(chunk.words), 50_000):
                some = chunk.words.slice(lo, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + lo, first + lo + len(some))), some], names=["at", "word"])

    return run


_ROWS = "chunk long, kind int, n_words long, check long, blob binary"


def _rows(*rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["chunk", "kind", "n_words", "check", "blob"])


def _documents(chunk_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, chunk_words):
            yield _rows((chunk.name, 1, len(chunk.words), chunk.check, chunk.documents()))

    return run


#: Pairs whose ids go back together: one row for each chunk that they belong to.
_FLUSH = 250_000


def _encode_words(tokenizer: str):
    """Ids of pairs that come sorted by word: rows of slots, numbers of ids and ids for a chunk."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
        """held: (at, index of the word, ids of every new word, all their ids) of some batches."""
        at, which, sizes, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        starts, real = np.cumsum(sizes) - sizes, at & _CHECK != _CHECK
        at, which = at[real], which[real]
        order = np.argsort(at)
        at, which = at[order], which[order]
        rows, cuts = [], np.flatnonzero(np.r_[True, at[1:] >> _SLOT != at[:-1] >> _SLOT, True]) if len(at) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            size, start = sizes[which[lo:hi]], starts[which[lo:hi]]
            ends = np.cumsum(size)
            ids = flat[np.arange(ends[-1]) - np.repeat(ends - size - start, size)]
            rows.append((int(at[lo] >> _SLOT), 0, None, None, _squeeze(np.diff(at[lo:hi] & _CHECK, prepend=0), size, ids)))
        return _rows(*rows) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, last, last_ids, held, pairs, words_held = tokens.byte_bpe(tokenizer), None, [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            here, coded = batch.column("at").to_numpy(), batch.column("word").dictionary_encode()
            words, indices = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
            checks = np.flatnonzero(here & _CHECK == _CHECK)
            if len(checks):
                yield _rows(*[(int(here[i] >> _SLOT), 0, None, int(words[indices[i]]), None) for i in checks])
            if pairs >= _FLUSH:
                if (out := flush(held)) is not None:
                    yield out
                held, pairs, words_held = [], 0, 0
            # the first word of a batch may be the last of the batch before
            same = words[0] == last
            lists = _ids(encoding, words[same:])
            if same:
                lists = lists if held else [last_ids, *lists]
            shift = words_held - (same and bool(held))
            held.append((here, indices + shift, np.array([len(x) for x in lists], np.int64), np.fromiter((i for x in lists for i in x), np.int32)))
            last, last_ids = words[-1], lists[-1] if lists else last_ids
            pairs, words_held = pairs + len(here), words_held + len(lists)
        if held and (out := flush(held)) is not None:
            yield out
        pa.default_memory_pool().release_unused()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) from a stream sorted by (chunk, kind): of every chunk first the ids of its slots, then its documents."""
    now, check, parts = None, None, []
    for batch in batches:
        columns = [batch.column(c) for c in ("chunk", "kind", "n_words", "check", "blob")]
        for i in range(batch.num_rows):
            chunk, kind, n_words, found, blob = (c[i].as_py() for c in columns)
            if chunk != now:
                now, check, parts = chunk, None, []
            if kind == 0:
                check = found if blob is None else check
                if blob is not None:
                    parts.append(_unsqueeze(blob, 3))
                continue
            slots = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(p[0]) for p in parts]])
            if found != check or len(slots) != n_words or not np.array_equal(np.sort(slots), np.arange(n_words)):
                raise RuntimeError("the documents differ between two reads: checkpoint them first")
            none = np.zeros(0, np.int32)
            sizes, data = np.concatenate([none, *[p[1] for p in parts]]).astype(np.int64), np.concatenate([none, *[p[2] for p in parts]])
            order = np.argsort(slots)
            before = (np.cumsum(sizes) - sizes)[order]
            starts = np.r_[0, np.cumsum(sizes[order])]
            flat = data[np.arange(starts[-1]) - np.repeat(starts[:-1] - before, sizes[order])]
            ids, has_id, has_words, size, words = _unsqueeze(blob, 5)
            ids = pa.array(np.ascontiguousarray(ids).view(np.int64), mask=has_id == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(words), mask=pa.array(has_words == 0))
            whole = pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "slots"])
            for some in _slices(whole, lists):
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), _gather(some.column("slots"), starts, flat)], names=["doc_id", "ids"])
            parts = []
            pa.default_memory_pool().release_unused()


def _gather(column: pa.Array, starts: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Lists of slots as lists of ids: those of slot s are flat[starts[s] : starts[s + 1]]."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    where = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    size = starts[where + 1] - starts[where]
    ends = np.r_[0, np.cumsum(size)]
    ids = flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[where], size)]
    return pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]], pa.int32()), pa.array(ids, pa.int32()), mask=column.is_null() if column.null_count else None)


#: Words or ids of a batch that are worked on at once.
SLICE = 300_000


def _slices(batch: pa.RecordBatch, column: pa.Array, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many list elements, one row at least."""
    bounds = np.asarray(column.offsets).astype(np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _slots_and_ids(docs: DataFrame, tokenizer: str, chunk_words: int) -> DataFrame:
    """What _joined makes documents of."""
    words = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), split_words(F.col("text")).alias("words"))
    # the work is by the word, not by the byte that moves: as many tasks as read the texts
    tasks = min(max(words.rdd.getNumPartitions(), 1), 10_000)
    pairs = words.mapInArrow(_pairs(chunk_words), "at long, word string").repartition(tasks, "word").sortWithinPartitions("word")
    both = pairs.mapInArrow(_encode_words(tokenizer), _ROWS).unionByName(words.mapInArrow(_documents(chunk_words), _ROWS))
    return both.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind")


def encode(docs: DataFrame, tokenizer: str = tokens.BYTE_BPE, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, ids) of every row, repeated rows included; null ids for a null text, none for an empty one.

    tokenizer: a tiktoken rank file of a byte-level vocabulary that splits by ``tokens.PATTERN``. An empty table gives
    an empty result; extra columns are ignored, whatever their names. docs is read twice, so it should be a scan or something
    as cheap, and both reads must give the same partitions; if they don't, an error says so.
    """
    return _slots_and_ids(docs, tokenizer, chunk_words).mapInArrow(_joined, "doc_id long, ids array<int>")


def vocabulary(spark: SparkSession, tokenizer: str = tokens.BYTE_BPE) -> DataFrame:
    """(id, piece): the bytes that each id stands for."""
    ranks = tokens.ranks(tokenizer)
    table = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": pa.array(list(ranks), pa.binary())})
    return spark.createDataFrame(table)


def _packed(kept: list[str], chunk_tokens: int):
    """(chunk, ids, payload): the distinct ids of some rows, and the rows as a table whose column ids has their slots."""
    at = kept.index("ids")

    def one(held: list[pa.RecordBatch], name: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("ids").chunk(0)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        slots = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), coded.indices.cast(pa.int32()), mask=lists.is_null() if lists.null_count else None)
        sink = pa.BufferOutputStream()
        table = table.select(kept).set_column(at, "ids", slots)
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        ids = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), ids, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "ids", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name, part = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in _slices(batch, batch.column("ids"), chunk_tokens):
                held.append(piece)
                size += len(piece.column("ids").flatten())
                if size >= chunk_tokens:
                    yield one(held, (part << 32) + name)
                    held, size, name = [], 0, name + 1
        if held:
            yield one(held, (part << 32) + name)

    return run


def _texts(column: pa.Array, listed: pa.Array) -> pa.Array:
    """The texts of lists of slots of listed; the last one is empty and stands for nulls."""
    bounds = np.asarray(column.offsets).astype(np.int64)
    slots = column.values.slice(bounds[0], bounds[-1] - bounds[0]).fill_null(len(listed) - 1)
    pieces = listed.take(slots)
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[: len(slots) + 1] if len(slots) else np.zeros(1, np.int64)
    data = pieces.buffers()[2] if len(slots) else pa.py_buffer(b"")
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends[bounds - bounds[0]].tobytes()), data])
    try:
        text = raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())
    return pc.if_else(column.is_null(), pa.scalar(None, pa.string()), text) if column.null_count else text


def _spelt(kept: list[str]):
    """The rows of each chunk with their texts, from a stream (chunk, pos, id, piece, payload) sorted within a chunk."""
    at = kept.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cuts = [0, *(np.flatnonzero(np.asarray(batch.column("payload").is_valid())) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                held.append(batch.slice(lo, hi - lo))
                payload = held[-1].column("payload")[hi - lo - 1]
                if not payload.is_valid:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                held = []
                ids = table.column("id").chunk(0)
                listed = pa.concat_arrays([table.column("piece").chunk(0).fill_null(b"").cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
                for rows in pa.ipc.open_stream(payload.as_buffer()):
                    for some in _slices(rows, rows.column(at)):
                        lists = some.column(at)
                        offsets = np.asarray(lists.offsets).astype(np.int64)
                        values = ids.take(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
                        back = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), values, mask=lists.is_null() if lists.null_count else None)
                        columns = [*some.columns[:at], back, *some.columns[at + 1 :], _texts(lists, listed)]
                        yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text"])

    return run


def decode(encoded: DataFrame, tokenizer: str = tokens.BYTE_BPE, broadcast_rows: int = common.BROADCAST_ROWS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """encoded, which has a column ids, with a column text: what the ids stand for; null for null ids.

    Unknown and null ids give nothing. A character may be spread over several tokens, so bytes are put together before they
    are read as UTF-8; faulty bytes become replacement characters. A column text that encoded has is replaced; other
    columns come back as they are, whatever their names. An empty table gives an empty result.
    """
    kept = [c for c in encoded.columns if c != "text"]
    rows = encoded.select(*[common.col(c) if c != "ids" else F.col("ids").cast("array<int>").alias("ids") for c in kept])
    return _decoded(rows.mapInArrow(_packed(kept, chunk_tokens), _PACKED), rows.schema, tokenizer, broadcast_rows)


_PACKED = "chunk long, ids array<int>, payload binary"


def _decoded(packed: DataFrame, schema: T.StructType, tokenizer: str, broadcast_rows: int) -> DataFrame:
    each = packed.select("chunk", F.size("ids").alias("n"), "payload", F.posexplode_outer("ids").alias("pos", "id"))
    # the rows of a chunk travel with the last of its ids
    each = each.select("chunk", "pos", "id", F.when(F.coalesce("pos", F.lit(-1)) == F.col("n") - 1, F.col("payload")).alias("payload"))
    pieces, small = vocabulary(packed.sparkSession, tokenizer), len(tokens.ranks(tokenizer)) <= broadcast_rows
    met = each.join(F.broadcast(pieces) if small else pieces, "id", "left").select("chunk", "pos", "id", "piece", "payload")
    if not small:
        met = met.repartition("chunk").sortWithinPartitions("chunk", "pos")
    return met.mapInArrow(_spelt(schema.names), T.StructType([*schema.fields, T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, tokenizer: str = tokens.BYTE_BPE) -> DataFrame:
    """(doc_id, n_tokens, ids, text_hash): the ids of every row and the hash of the text decoded from them.

    Just decode(encode(docs)), but that the end of the one and the beginning of the other share a Python worker.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    pack = _packed(schema.names, CHUNK_TOKENS)
    packed = _slots_and_ids(docs, tokenizer, CHUNK_WORDS).mapInArrow(lambda batches: pack(_joined(batches)), _PACKED)
    decoded = _decoded(packed, schema, tokenizer, common.BROADCAST_ROWS)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.xxhash64("text").alias("text_hash"))
