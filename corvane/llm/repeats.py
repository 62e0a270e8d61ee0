"""Suffix-array dedup of passages by streaming over a run-length index.

Words are runs of characters other than ASCII white space (characters of scripts without spaces stand for
themselves). A passage is repeated if its ``min_words`` words stand in some other document too. The steps:

1. Every window of ``min_words`` words belongs to the group named by the smallest hash among its ``GRAM``-word
   grams. Consecutive windows of one group form a piece. Equal windows are in pieces of the same group,
   so groups can be searched on their own and a group of one document only is done with.
2. Of each distinct piece one occurrence is fetched; its smallest and greatest document are aggregates.
3. Groups are put together in blocks; for each block the Burrows-Wheeler transform of its pieces' words is built
   and kept as runs with sampled run ends (`RunLengthIndex`). The pieces stream through it from left to right: at
   every position the samples tell how many words it shares with the suffix sorted just above it, and where that
   suffix stands. Sharing ``min_words`` or more links the two; linked positions of different documents are marked.
4. Marks go from the distinct piece to all its occurrences and are merged per document.

A group with more words than an index may have is not put in a block: each of its windows is counted by its hash,
which is as exact and can be spread over any number of tasks.

All steps shuffle hashes and positions; of texts only those of documents with repeated groups move, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import common

MIN_WORDS, GRAM = 50, 12
#: Words of pieces that one index is built for, and of the largest group that is put in one.
BLOCK_WORDS, GROUP_WORDS = 400_000, 1_000_000


class RunLengthIndex:
    """Run-length compressed Burrows-Wheeler transform of a sequence of integers, with sampled run ends.

    Kept are, in proportion to the runs: symbol and first row of every run, the suffix-array samples at both ends, the
    sample above every run head with the longest common prefix of the two, and symbol counts. The suffix array itself
    and the ranks it is built from are dropped. ``text`` is kept only if asked for: `matching_statistics` compares with it.
    """

    def __init__(self, text: np.ndarray, keep_text: bool = False):
        self.alphabet, text = np.unique(np.asarray(text), return_inverse=True)
        text = np.append(text.astype(np.int64) + 1, 0)  # a smallest end symbol of its own
        n = len(text)
        sa, levels = self._suffix_array(text)
        bwt = text[sa - 1]
        head = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        end = np.r_[head[1:], n] - 1
        self.n, self.run_symbol, self.run_start = n, bwt[head], head
        self.sample_head, self.sample_end = sa[head], sa[end]
        above = np.r_[sa[0], sa[head[1:] - 1]]
        prefix = self._common_prefix(levels, self.sample_head, above)
        prefix[0] = 0
        # in text order, for the stream
        order = np.argsort(self.sample_head)
        self.at, self.above, self.prefix = self.sample_head[order], above[order], prefix[order]
        self.first_row = np.r_[0, np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))]
        self._ranks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.text = text if keep_text else None

    @staticmethod
    def _suffix_array(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Prefix doubling; the ranks of every level are returned to compare spans with."""
        n, width = len(text), 1
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        levels = [rank.astype(np.int32)]
        while True:
            second = np.zeros(n, dtype=np.int64)
            second[: n - width] = rank[width:] + 1
            key = rank * (n + 1) + second
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order, levels
            levels.append(rank.astype(np.int32))
            width *= 2

    @staticmethod
    def _common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, length = len(levels[0]), np.zeros(len(a), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + length, b + length
            inside = (x < n) & (y < n)
            same = levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
            length += (inside & same) * (1 << k)
        return length

    @property
    def runs(self) -> int:
        return len(self.run_start)

    def stream(self, least: int, step: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, positions above): where the text itself matches the suffix sorted just above for ``least`` or more.

        These are the matching statistics of the text against itself. They are read from left to right, ``step`` positions
        at once, from the samples alone: between two sampled run heads a position's match is that of the position before
        it, less one symbol, and its neighbour the next position of the neighbour before.
        """
        for lo in range(0, self.n, step):
            position = np.arange(lo, min(lo + step, self.n))
            last = np.searchsorted(self.at, position, side="right") - 1
            on = position - self.at[last]
            hit = self.prefix[last] - on >= least
            yield position[hit], (self.above[last] + on)[hit]

    def _rows_of(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the symbol and how many of it there are before each."""
        if symbol not in self._ranks:
            runs = np.flatnonzero(self.run_symbol == symbol)
            size = np.r_[self.run_start[1:], self.n][runs] - self.run_start[runs]
            self._ranks[symbol] = runs, np.r_[0, np.cumsum(size)]
        return self._ranks[symbol]

    def _step(self, row: int, symbol: int) -> int:
        """Row of symbol + the suffix at row, where the transform has the symbol at row."""
        runs, before = self._rows_of(symbol)
        k = int(np.searchsorted(self.run_start[runs], row, side="right")) - 1
        return int(self.first_row[symbol] + before[k] + row - self.run_start[runs[k]])

    def matching_statistics(self, pattern: list[int]) -> list[tuple[int, int]]:
        """For each position of pattern: (length, place in the text) of its longest match.

        Streams from right to left. While the transform continues the match one backward step is enough; where
        it doesn't, the match restarts from the nearest end of a run of the symbol, above or below, whichever
        shares more with what has been matched.
        """
        out: list[tuple[int, int]] = []
        row, place, length = 0, self.n - 1, 0
        for wanted in reversed(pattern):
            symbol = int(np.searchsorted(self.alphabet, wanted)) + 1
            known = symbol <= len(self.alphabet) and self.alphabet[symbol - 1] == wanted
            runs = self._rows_of(symbol)[0] if known else ()
            if not len(runs):
                row, place, length = 0, self.n - 1, 0
                out.append((0, 0))
                continue
            run = int(np.searchsorted(self.run_start, row, side="right")) - 1
            if self.run_symbol[run] == symbol:
                row, place, length = self._step(row, symbol), place - 1, length + 1
            else:
                best = None
                for k in (int(np.searchsorted(runs, run)) - 1, int(np.searchsorted(runs, run))):
                    if 0 <= k < len(runs):
                        below = runs[k] > run
                        to = int(self.run_start[runs[k]] if below else np.r_[self.run_start[1:], self.n][runs[k]] - 1)
                        sample = int(self.sample_head[runs[k]] if below else self.sample_end[runs[k]])
                        same = min(length, self._agree(place, sample, length))
                        if best is None or same > best[0]:
                            best = (same, to, sample)
                same, to, sample = best
                row, place, length = self._step(to, symbol), sample - 1, same + 1
            out.append((length, place))
        return out[::-1]

    def _agree(self, a: int, b: int, most: int) -> int:
        x, y = self.text[a : a + most], self.text[b : b + most]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        return int(differ[0]) if len(differ) else m


def marked(pieces: list[np.ndarray], low: np.ndarray, high: np.ndarray, min_words: int) -> list[tuple[int, int, int, int]]:
    """(piece, from word, to word, owner) for each maximal span of a piece made of windows of min_words words that
    another owner has too. low and high are the smallest and greatest owner of each piece; the owner given is the smallest
    or greatest of the first window, and one that the piece hasn't alone."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    n = int(sizes.sum()) + len(pieces)
    piece_of = np.repeat(np.arange(len(pieces)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.int64)
    _, symbols = np.unique(symbols, return_inverse=True)
    symbols = symbols.astype(np.int64) + len(pieces) + 1
    symbols[ends] = np.arange(len(pieces))  # separators differ, so that no match crosses one
    index = RunLengthIndex(symbols)
    # positions with equal windows are a chain of links; its top names the class
    top = np.arange(n + 1)
    for position, above in index.stream(min_words):
        top[position] = above
    while True:
        next_ = top[top]
        if (next_ == top).all():
            break
        top = next_
    # a window of a piece that several owners have is repeated without any link
    begins = ends - sizes
    window = np.flatnonzero(np.arange(n) + min_words <= ends[piece_of])
    klass, piece = top[window], piece_of[window]
    least, most = np.full(n + 1, np.iinfo(np.int64).max), np.full(n + 1, -1)
    np.minimum.at(least, klass, low[piece])
    np.maximum.at(most, klass, high[piece])
    hit = least[klass] != most[klass]
    starts, klass = window[hit], klass[hit]
    found = []
    if not len(starts):
        return found
    first = np.flatnonzero(np.r_[True, (starts[1:] - starts[:-1] > min_words) | (piece_of[starts[1:]] != piece_of[starts[:-1]])])
    last = np.r_[first[1:], len(starts)] - 1
    for f, i, j in zip(first, starts[first], starts[last], strict=True):
        k = piece_of[i]
        other = least[klass[f]] if least[klass[f]] != low[k] else most[klass[f]]
        found.append((int(k), int(i - begins[k]), int(j - begins[k] + min_words), int(other)))
    return found


def _window_groups(word: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(row, first word within the row, number of words, group, hash of the words) of every piece."""
    span = min_words - GRAM + 1 if min_words > GRAM else 1
    gram = min(GRAM, min_words)
    n = len(word)
    empty = np.zeros(0, dtype=np.int64)
    if n < min_words:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    prefix = common.prefix_hash(word)
    at = np.arange(n - gram + 1)
    least = common.span_hash(prefix, at, at + gram)
    done = 1
    while done < span:  # minimum over span grams, in doubling steps
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    valid = np.arange(len(least)) + min_words <= first[1:][row]
    at = np.flatnonzero(valid)
    if not len(at):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    group, row = least[at], row[at]
    head = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (row[1:] != row[:-1])])
    tail = np.r_[head[1:], len(at)] - 1
    start, end = at[head], at[tail] + min_words
    return row[head], start - first[row[head]], end - start, group[head], common.span_hash(prefix, start, end)


def pieces(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(g, p, dk, doc_id, s, n): group, hash of the words, document key, id, first word and number of words."""
    narrow = docs.filter("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("dk"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in common.text_chunks(batch.column("text")):
                row, start, size, group, key = _window_groups(*common.words(data, offsets), min_words)
                rows = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group.view(np.int64)), pa.array(key.view(np.int64)), batch.column("dk").take(rows),
                     batch.column("doc_id").take(rows), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["g", "p", "dk", "doc_id", "s", "n"])

    return narrow.mapInArrow(run, "g long, p long, dk long, doc_id long, s int, n int")


def _fetch(docs: DataFrame, wanted: DataFrame, filter_words: int) -> DataFrame:
    """(g, p, low, high, big, words): the words of the wanted pieces, as hashes, with all but dk, s and n of wanted."""
    lists = wanted.groupBy("dk").agg(F.collect_list(F.struct("g", "p", "low", "high", "big", "s", "n")).alias("want"))
    texts = docs.filter("text is not null").select(F.xxhash64("doc_id", "text").alias("h"), "text")
    # texts without a wanted piece stay where they are
    texts = common.members(texts, wanted.select(F.col("dk").alias("h")), filter_words)
    owner = pa.struct([("dk", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want")
            bounds = np.asarray(want.offsets)
            fields = want.values
            s, n = np.asarray(fields.field("s")).astype(np.int64), np.asarray(fields.field("n")).astype(np.int64)
            for lo, hi, data, offsets in common.text_chunks(batch.column("text")):
                word, first = common.words(data, offsets)
                word = (word >> np.uint64(1)).view(np.int64)
                a, b = int(bounds[lo]), int(bounds[hi])
                rows = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                begin, size = first[rows] + s[a:b], n[a:b]
                ends = np.r_[0, np.cumsum(size)]
                flat = word[np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, size)] if b > a else word[:0]
                kept = [fields.field(c).slice(a, b - a) for c in ("g", "p", "low", "high", "big")]
                kept[2:4] = [c.cast(owner) for c in kept[2:4]]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["g", "p", "low", "high", "big", "words"])

    # a row repeated with equal id and text is one document: it gives its pieces more than once
    joined = texts.join(lists, texts.h == lists.dk).select("text", "want")
    return joined.mapInArrow(run, f"g long, p long, low {_OWNER}, high {_OWNER}, big boolean, words array<long>")


_OWNER = "struct<dk:long,doc_id:long>"
_MARKS = "g long, p long, a int, b int, other long, other_id long"


def _search(min_words: int, block_words: int):
    """Marks of groups that arrive one after the other, of at most so many words each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            g, words = np.asarray(batch.column("g")), np.asarray(batch.column("words").value_lengths())
            heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if batch.num_rows else ()
            for head in heads:
                begins_group = not held or held[-1].column("g")[-1].as_py() != g[head] if head == 0 else True
                if begins_group and size + int(words[at:head].sum()) >= block_words:
                    held.append(batch.slice(at, head - at))
                    yield from _marks(held, min_words)
                    held, size, at = [], 0, head
            if batch.num_rows:
                held.append(batch.slice(at))
                size += int(words[at:].sum())
        if held:
            yield from _marks(held, min_words)

    return run


def _marks(held: list[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    if not table.num_rows:
        return
    lists = table.column("words").chunk(0)
    flat, bounds = lists.flatten().to_numpy(), np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]
    ends = [table.column(c).chunk(0) for c in ("low", "high")]
    keys = np.concatenate([np.asarray(e.field("dk")) for e in ends])
    owners, first, owner = np.unique(keys, return_index=True, return_inverse=True)
    ids = pa.concat_arrays([e.field("doc_id") for e in ends]).take(pa.array(first))
    rows = table.num_rows
    found = marked([flat[bounds[i] : bounds[i + 1]] for i in range(rows)], owner[:rows], owner[rows:], min_words)
    if not found:
        return
    at, other = pa.array([f[0] for f in found]), [f[3] for f in found]
    yield pa.RecordBatch.from_arrays(
        [table.column("g").take(at).combine_chunks(), table.column("p").take(at).combine_chunks(), pa.array([f[1] for f in found], pa.int32()),
         pa.array([f[2] for f in found], pa.int32()), pa.array(owners[other], pa.int64()), ids.take(pa.array(other))],
        names=["g", "p", "a", "b", "other", "other_id"])


def _big_marks(words: DataFrame, min_words: int) -> DataFrame:
    """Marks of groups too large for an index: one for each window that several owners have, by the window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            size = np.asarray(lists.value_lengths())
            flat, bounds = lists.flatten().to_numpy(), np.r_[0, np.cumsum(size)]
            prefix = common.prefix_hash(flat.view(np.uint64))
            many = np.maximum(size - min_words + 1, 0)
            row = np.repeat(np.arange(len(size)), many)
            a = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(many)][:-1], many)
            start = bounds[row] + a
            h = common.span_hash(prefix, start, start + min_words)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), *[batch.column(c).take(take) for c in ("g", "p", "low", "high")], pa.array(a.astype(np.int32))],
                names=["h", "g", "p", "low", "high", "a"])

    windows = common.checkpoint(words.select("g", "p", "low", "high", "words").mapInArrow(run, f"h long, g long, p long, low {_OWNER}, high {_OWNER}, a int"))
    owners = windows.groupBy("h").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least.dk <> most.dk")
    met = windows.join(owners, "h")
    other = F.when(F.col("least.dk") != F.col("low.dk"), F.col("least")).otherwise(F.col("most"))
    return met.select("g", "p", "a", (F.col("a") + min_words).alias("b"), other.alias("o")).select("g", "p", "a", "b", F.col("o.dk").alias("other"), F.col("o.doc_id").alias("other_id"))


def repeated_passages(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    block_words: int = BLOCK_WORDS,
    group_words: int = GROUP_WORDS,
    filter_words: int = common.FILTER_WORDS,
) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, match_doc_id): every maximal passage of a document whose windows of
    min_words words are all in some other document too; match_doc_id is one of those, for some of the windows.

    Words count from 0, the end is exclusive. Rows with equal id and text are one document, so a row repeated
    as it is marks nothing; equal texts under different ids mark each other whole. Rows with a null id take part
    and give rows with a null doc_id. Null, empty and short texts have no passages. Extra columns are ignored.
    An empty table gives an empty result. Blocks hold about ``block_words`` words; groups of more than ``group_words``
    words of distinct pieces are searched by window hashes instead.
    """
    docs = docs.select("doc_id", "text")
    every = pieces(docs, min_words)
    groups = every.groupBy("g").agg(F.min("dk").alias("a"), F.max("dk").alias("b")).filter("a <> b").select(F.col("g").alias("h"))
    # pieces of groups with several documents, and of a few others that the filter lets through
    met = common.checkpoint(common.members(every.withColumn("h", F.col("g")), common.checkpoint(groups), filter_words).drop("h"))
    owner = F.struct("dk", "doc_id")
    distinct = met.groupBy("g", "p").agg(F.min(owner).alias("low"), F.max(owner).alias("high"), F.min(F.struct("dk", "s", "n")).alias("one"))
    distinct = common.checkpoint(distinct)
    sums = distinct.groupBy("g").agg(F.min("low.dk").alias("a"), F.max("high.dk").alias("b"), F.sum("one.n").alias("words")).filter("a <> b")
    wanted = distinct.join(sums.select("g", (F.col("words") > group_words).alias("big")), "g").select("g", "p", "low", "high", "big", "one.*")
    wanted = common.checkpoint(wanted)
    words = _fetch(docs, wanted, filter_words)
    blocks = words.filter("not big").drop("big").repartition("g").sortWithinPartitions("g")
    marks = blocks.mapInArrow(_search(min_words, block_words), _MARKS)
    if not wanted.filter("big").isEmpty():
        marks = marks.unionByName(_big_marks(_fetch(docs, wanted.filter("big"), filter_words), min_words))
    marks = marks.groupBy("g", "p", "a", "b").agg(F.min(F.struct("other", "other_id")).alias("m")).select("g", "p", "a", "b", "m.*")
    # an occurrence may be the very document that its mark names: then another document with the piece is named
    spans = met.join(marks, ["g", "p"]).join(distinct.select("g", "p", "low", "high"), ["g", "p"])
    match = F.when(F.col("other") != F.col("dk"), F.col("other_id")).when(F.col("low.dk") != F.col("dk"), F.col("low.doc_id")).otherwise(F.col("high.doc_id"))
    return _merge(spans.select("dk", "doc_id", (F.col("s") + F.col("a")).alias("start"), (F.col("s") + F.col("b")).alias("end"), match.alias("match")))


def _merge(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document become one: what counts is which words are covered."""
    order = Window.partitionBy("dk").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        spans.withColumn("island", island)
        .groupBy("dk", "island")
        .agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("match").alias("match_doc_id"))
        .select("doc_id", F.col("start_word").cast("long"), F.col("end_word").cast("long"), (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"), "match_doc_id")
    )
