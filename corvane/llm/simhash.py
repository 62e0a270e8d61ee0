"""SimHash near-dedup with deletion-variant signatures.

A document's signature has ``bits`` bits, the signs of a random projection of its words (lower-cased runs
of letters and digits; weight: square root of the count). It is cut into ``segments`` pieces, or into more
if ``max_distance`` needs them: two signatures which differ in at most ``2 * pieces - 1`` bits have some piece
that differs by at most one bit. Every piece is indexed once for each of its bits, with that bit deleted; two documents meet
where a variant is equal: at all of them if their pieces are equal, at just one if these differ in one bit.

Candidates are verified by the Hamming distance of the whole signatures. Every pair within ``max_distance`` is found.

The greater the distance, the shorter are the pieces and the more signatures share a variant by chance: with distance 19
N * N / 60 or so pairs of N distinct signatures do. Signatures that share one are sorted by word count, and compared with those
next to them whose counts may be within the ratio, by one word of the signature first. ``max_distance=7, segments=4`` has
variants of 31 bits and serves 10**10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

#: Production parameters: 6 pieces at least, for distance 19 there are 10 of 12 or 13 bits; 19 of 128 is an angle of 27 degrees.
BITS, SEGMENTS, MAX_DISTANCE, MIN_RATIO = 128, 6, 19, 0.8

_ROWS = 8192


def _signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures as two uint64 per row, number of words per row)."""
    rows = len(offsets) - 1
    word, first = common.words(data, offsets, letters_only=True)
    counts = np.diff(first)
    out = np.zeros((rows, 2), dtype=np.uint64)
    if not len(word):
        return out, counts
    total = np.zeros((rows, BITS), dtype=np.float32)
    for lo in range(0, rows, 4096):
        hi = min(lo + 4096, rows)
        # occurrences of one word in one row become one weighted feature: 12 bits of row, 52 of word, sorted
        row = np.repeat(np.arange(hi - lo, dtype=np.uint64), counts[lo:hi])
        feature = np.sort((row << np.uint64(52)) | (word[first[lo] : first[hi]] >> np.uint64(12)))
        if not len(feature):
            continue
        head = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]])
        weight = np.sqrt(np.diff(np.r_[head, len(feature)])).astype(np.float32)
        feature = feature[head]
        row = (feature >> np.uint64(52)).astype(np.int64)
        feature &= np.uint64((1 << 52) - 1)
        for at in range(0, len(feature), _ROWS):
            to = min(at + _ROWS, len(feature))
            raw = np.empty((to - at, 2), dtype=np.uint64)
            raw[:, 0] = common.mix(feature[at:to])
            raw[:, 1] = common.mix(feature[at:to] + np.uint64(0xD1B54A32D192ED03))
            sign = np.unpackbits(raw.view(np.uint8), axis=1).astype(np.float32)
            sign -= 0.5
            r, w = row[at:to], weight[at:to]
            cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                total[lo + r[i]] += w[i:j] @ sign[i:j]
    out[:] = np.packbits(total > 0, axis=1).view(np.uint64)
    return out, counts


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in common.text_chunks(batch.column("low")):
            signature, counts = _signatures(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array(signature[:, 0].view(np.int64)),
                    pa.array(signature[:, 1].view(np.int64)),
                    pa.array(counts.astype(np.int64)),
                ],
                names=["doc_id", "high", "low", "n_words"],
            )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, high, low, n_words): the signature of every document that has at least one word.

    Null texts and texts without a word have no signature: they are near duplicates of nothing.
    """
    narrow = docs.filter(common.col(text_col).isNotNull()).select(
        common.col(id_col).cast("long").alias("doc_id"), F.lower(common.col(text_col)).alias("low")
    )
    return narrow.mapInArrow(_sign_batches, "doc_id long, high long, low long, n_words long").filter("n_words > 0")


def _bit_range(segment: int, segments: int) -> tuple[int, int]:
    return segment * BITS // segments, (segment + 1) * BITS // segments


def _take(high: Column, low: Column, start: int, stop: int) -> Column:
    """Bits start to stop (exclusive), counted from the top of the 128, as a long."""
    mask = (1 << (stop - start)) - 1
    if stop <= 64:
        return F.shiftrightunsigned(high, 64 - stop).bitwiseAND(F.lit(mask))
    if start >= 64:
        return F.shiftrightunsigned(low, 128 - stop).bitwiseAND(F.lit(mask))
    upper = high.bitwiseAND(F.lit((1 << (64 - start)) - 1))
    return F.shiftleft(upper, stop - 64).bitwiseOR(F.shiftrightunsigned(low, 128 - stop))


def _halves(segments: int) -> list[tuple[int, int, int]]:
    """(start, middle, stop) of every segment."""
    ranges = [_bit_range(s, segments) for s in range(segments)]
    return [(start, (start + stop) // 2, stop) for start, stop in ranges]


def _near(high: np.ndarray, low: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, max_distance: int, min_ratio: float) -> np.ndarray:
    """Whether signatures a and b (indexes) are within max_distance and their word counts within min_ratio."""
    bits = np.bitwise_count(high[a] ^ high[b]).astype(np.int16) + np.bitwise_count(low[a] ^ low[b])
    return (bits <= max_distance) & (np.minimum(n[a], n[b]) >= min_ratio * np.maximum(n[a], n[b]))


def _forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of every node's component."""
    root = np.arange(nodes)
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while not (root[root] == root).all():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


#: Seeds of a bucket of many near copies that are compared with it at once.
_SMALL = 64
#: Signatures of such a bucket that as many seeds are compared with at once.
_WIDE = 4096
#: Neighbouring rows that are compared with those a step further at once, so that they stay in the cache.
_TILE = 4096
#: Pairs found for each row of a tile (of a bucket: half of them) from which on a bucket is one of many near copies.
_DENSE = 8


def _reached(left: np.ndarray, high: np.ndarray, low: np.ndarray, n: np.ndarray, max_distance: int, min_ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what the near pairs of left (indexes) connect.

    Signatures without a near one are found and dropped many at once; from the others a breadth-first search compares
    each newly reached signature with those not yet reached only, so many near copies cost little more than their number.
    """
    while len(left):
        seeds = left[:_SMALL]
        near = np.zeros(len(seeds), dtype=np.int64)
        for at in range(0, len(left), _WIDE):
            near += _near(high, low, n, seeds[:, None], left[None, at : at + _WIDE], max_distance, min_ratio).sum(axis=1)
        # each is near itself
        reached, left = seeds[near > 1].tolist(), np.r_[seeds[near > 1], left[len(seeds) :]]
        for seed in reached:
            if not (left[:_SMALL] == seed).any():
                continue  # reached from an earlier one
            left, fresh = left[left != seed], [seed]
            while fresh and len(left):
                at = fresh.pop()
                ok = _near(high, low, n, np.full(len(left), at), left, max_distance, min_ratio)
                yield np.full(int(ok.sum()), at), left[ok]
                fresh += left[ok].tolist()
                left = left[~ok]


def _stepped(bucket: np.ndarray, reach: np.ndarray, high: np.ndarray, low: np.ndarray, n: np.ndarray, max_distance: int, min_ratio: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(near pairs of each row with the next reach rows, numbers of the buckets that have too many of them and are left out).

    Rows are sorted by bucket (numbered from 0). All of a tile meet the rows a step further at once, whether these are within
    reach or not: a near pair is one in any case. high is compared first, which nearly all pairs fail.
    """
    found, dense = [], np.zeros(int(bucket[-1]) + 1, dtype=bool)
    bits, counted = np.empty(_TILE, np.uint64), np.empty(_TILE, np.uint8)

    def steps(at: int, ahead: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = 1
        while step <= (most := int(ahead.max())):
            within = np.flatnonzero(ahead >= step)
            start, stop = at + int(within[0]), at + int(within[-1]) + 1
            for k in range(step, min(step + 16, most + 1)):
                size = min(stop, len(bucket) - k) - start
                apart = np.bitwise_xor(high[start : start + size], high[start + k : start + k + size], out=bits[:size])
                x = start + np.flatnonzero(np.bitwise_count(apart, out=counted[:size]) <= max_distance)
                if len(x):
                    yield x, x + k
            step += 16

    for at in range(0, len(bucket), _TILE):
        of, ahead = bucket[at : at + _TILE], reach[at : at + _TILE].copy()
        ahead[dense[of]] = 0
        held, size, sure, count = [], 0, [], 0

        def verify() -> None:
            nonlocal held, size, sure, count
            x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            ok = _near(high, low, n, x, y, max_distance, min_ratio)
            sure.append((x[ok], y[ok]))
            held, size, count = [], 0, count + int(ok.sum())
            if count > _DENSE * len(of):
                x, y = (np.concatenate(c) for c in zip(*sure, strict=True))
                # a pair counts for the bucket of its first row
                many = np.bincount(bucket[x] - of[0], minlength=int(of[-1] - of[0]) + 1) > _DENSE // 2 * np.bincount(of - of[0])
                dense[of[0] : of[-1] + 1] |= many
                kept = ~dense[bucket[x]]
                sure, count = [(x[kept], y[kept])], int(kept.sum())
                ahead[dense[of]] = 0

        for pair in steps(at, ahead):
            held.append(pair)
            size += len(pair[0])
            if size > 2 * _DENSE * len(of):
                verify()
        if held:
            verify()
        found += sure
    return found, np.flatnonzero(dense)


def _links(g: np.ndarray, other: np.ndarray, width: np.ndarray, high: np.ndarray, low: np.ndarray, n: np.ndarray, max_distance: int, min_ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all signatures that verified pairs of the same variant bucket connect, and none that near pairs don't.

    A bucket holds the signatures with one g and one value of the other half but for a deleted bit, sorted by word count: what may
    be within min_ratio of a signature comes next to it. Those are compared step by step, all buckets at once, and buckets
    of many near copies by a breadth-first search. No pair is left undecided.
    """
    rows = len(g)
    none = np.zeros(0, np.int64)
    if rows < 2:
        return none, none
    by_n = np.lexsort((n, g))
    group = np.cumsum(np.r_[0, np.diff(g[by_n]) != 0])
    other, width, high, low, n = other[by_n], width[by_n], high[by_n], low[by_n], n[by_n]
    # where word counts of a group get too large for that of a row; a little further on, as pairs are verified anyway
    limit = np.full(rows, rows)
    if min_ratio > 0:
        counts, most = np.r_[n, n / min_ratio * (1 + 1e-9) + 1], (1 << 40) - 1
        counts = (np.r_[group, group] << 40) | np.minimum(counts, most).astype(np.int64)
        limit = np.searchsorted(counts[:rows], counts[rows:], side="right")
    place = int(rows).bit_length()
    a, b = none, none
    for bit in range(int(width.max())):
        have = np.flatnonzero(width > bit)
        rest = other[have] & ~np.int64(1 << bit)
        if int(group[-1]).bit_length() + int(rest.max()).bit_length() + place > 62:
            rest = np.unique(rest, return_inverse=True)[1]
        key = (group[have] << int(rest.max()).bit_length()) | rest
        # sorted by bucket, then by word count
        order = np.sort((key << place) | have)
        at, key = order & ((1 << place) - 1), order >> place
        end = np.searchsorted(order, (key << place) + limit[at])
        bucket = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        found, dense = _stepped(bucket, end - np.arange(1, len(at) + 1), high[at], low[at], n[at], max_distance, min_ratio)
        found = [(at[x], at[y]) for x, y in found]
        for k in dense:
            found += _reached(at[np.searchsorted(bucket, k) : np.searchsorted(bucket, k, side="right")], high, low, n, max_distance, min_ratio)
        a, b = (np.concatenate([old, *(pair[i] for pair in found)]) for i, old in enumerate((a, b)))
        if len(a) > 4 * rows:
            root = _forest(rows, a, b)
            a = np.flatnonzero(root != np.arange(rows))
            b = root[a]
    return by_n[a], by_n[b]


#: Rows of complete groups that are searched at once.
_CHUNK = 100_000
#: Rows of a group that one task holds; larger groups are split into blocks and every two blocks meet.
GROUP_ROWS = 200_000


def _bits(high: np.ndarray, low: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Bits start to stop (exclusive) of signatures, as int64."""
    mask = np.uint64((1 << (stop - start)) - 1)
    if stop <= 64:
        return ((high >> np.uint64(64 - stop)) & mask).view(np.int64)
    if start >= 64:
        return ((low >> np.uint64(128 - stop)) & mask).view(np.int64)
    return (((high << np.uint64(stop - 64)) | (low >> np.uint64(128 - stop))) & mask).view(np.int64)


def near_links(nodes: DataFrame, segments: int = SEGMENTS, max_distance: int = MAX_DISTANCE, min_ratio: float = MIN_RATIO, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): edges whose connected components are those of all pairs of nodes (rep, n, high, low) that have signatures
    within max_distance and word counts within min_ratio.

    There are as many pieces as make every such pair share a variant, and segments at least.

    Two pieces that differ in at most one bit agree in one of their halves. So the variants' index is laid out in two
    levels: a signature is exchanged once for each half of each piece, to where all with the same half meet, and the
    variants (one bit of the other half deleted) are matched for equality there. That is two rows for each piece instead
    of one for each of its bits. Rows of a half that more than ``group_rows`` signatures share are dealt to blocks, and
    every two blocks meet in a task of their own: no task holds more than two blocks, and no pair is left out. What comes
    back is a spanning forest, so a group of thousands of near copies gives as many edges and not as many as it has pairs.
    """
    high, low = F.col("high"), F.col("low")
    segments = max(segments, max_distance // 2 + 1)
    halves = [x for start, middle, stop in _halves(segments) for x in (((start, middle), (middle, stop)), ((middle, stop), (start, middle)))]
    sent = [F.lit(k << 40).bitwiseOR(_take(high, low, *kept)) for k, (kept, _) in enumerate(halves)]
    each = nodes.select("rep", "n", "high", "low", F.explode(F.array(*sent)).alias("g"))
    # as many groups as halves have values, at most: the large ones among them are few
    large = each.groupBy("g").count().filter(F.col("count") > group_rows).select("g", F.ceil(F.col("count") / group_rows).cast("long").alias("blocks"))
    large = common.sized(common.checkpoint(large))
    block, other = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.col("other")
    met = each.join(large, "g", "left").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
    pair = F.when(F.col("blocks").isNull(), F.lit(0).cast("long")).otherwise(F.least(block, other) * F.col("blocks") + F.greatest(block, other))
    names = ("g", "pair", "rep", "n", "high", "low")
    met = met.select("g", pair.alias("pair"), "rep", "n", "high", "low")

    def search(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        c = {k: np.concatenate([h[k] for h in held]) for k in names}
        # a signature comes several times: its node is one
        rep, node = np.unique(c["rep"], return_inverse=True)
        high, low, half = c["high"].view(np.uint64), c["low"].view(np.uint64), c["g"] >> 40
        rest, width = np.zeros(len(half), np.int64), np.zeros(len(half), np.int64)
        for k in np.unique(half):
            at, (start, stop) = np.flatnonzero(half == k), halves[k][1]
            rest[at], width[at] = _bits(high[at], low[at], start, stop), stop - start
        # the word without the piece tells more of two signatures that share it: it is compared first
        word = np.array([kept[0] < 64 for kept, _ in halves])[half]
        high, low = np.where(word, low, high), np.where(word, high, low)
        group = np.cumsum(np.r_[False, (c["g"][1:] != c["g"][:-1]) | (c["pair"][1:] != c["pair"][:-1])])
        a, b = _links(group, rest, width, high, low, c["n"], max_distance, min_ratio)
        root = _forest(len(rep), node[a], node[b])
        linked = np.flatnonzero(root != np.arange(len(rep)))
        return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            if size >= _CHUNK:
                # the last group may go on in this batch
                ended = np.flatnonzero((columns["g"] != held[-1]["g"][-1]) | (columns["pair"] != held[-1]["pair"][-1]))
                goes_on = int(ended[0]) if len(ended) else batch.num_rows
                held.append({k: v[:goes_on] for k, v in columns.items()})
                columns = {k: v[goes_on:] for k, v in columns.items()}
                if goes_on == batch.num_rows:
                    size += goes_on
                    continue
                yield search(held)
                held, size = [], 0
            held.append(columns)
            size += len(columns["g"])
        if held:
            yield search(held)

    return met.repartition("g", "pair").sortWithinPartitions("g", "pair").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of every connected component of the undirected edges (a, b).

    Each round hooks every node to the smallest root in its neighbourhood and then halves the paths
    (pointer jumping), so the number of rounds grows with the logarithm of the longest chain.
    Each round ends in a reliable checkpoint; the loop ends when no label changes.
    """
    both = common.checkpoint(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct())
    labels = common.checkpoint(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")))
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        hooked = labels.join(seen, "node").select("node", "root", F.least("root", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("root").alias("far"))
        new = common.checkpoint(hooked.join(jump, "near", "left").select("node", F.least("near", "far").alias("new"), "root"))
        if new.filter("new <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", F.col("new").alias("root"))
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    segments: int = SEGMENTS,
    max_distance: int = MAX_DISTANCE,
    min_ratio: float = MIN_RATIO,
) -> DataFrame:
    """(doc_id, kept_id, distance): every document that has a near duplicate which is kept instead of it.

    Groups are the connected components of "signatures within max_distance, word counts within a ratio
    of min_ratio"; the document with the smallest id is kept. distance is between the two signatures, so
    within a chain it may be more than max_distance. Equal signatures of equal word counts are one node of
    the graph, so a group of any number of copies costs one node; of different counts they are several, under the same ratio. Documents without a word (null, empty, punctuation
    only) and documents with a null id are never in the result; a row repeated with the same id is one
    document. Extra columns are ignored, whatever their names. An empty table gives an empty result.
    """
    signed = common.checkpoint(signatures(docs, id_col, text_col).filter("doc_id is not null"))
    nodes = signed.groupBy("high", "low", F.col("n_words").alias("n")).agg(F.min("doc_id").alias("rep"))
    nodes = common.checkpoint(nodes)
    roots = components(near_links(nodes, segments, max_distance, min_ratio))
    # a component's smallest representative is its smallest document, as a representative is its node's smallest
    kept = nodes.select("rep", F.col("high").alias("kept_high"), F.col("low").alias("kept_low"))
    member = nodes.join(roots, nodes.rep == roots.node, "left").select("high", "low", "n", F.coalesce("root", "rep").alias("kept_id"))
    member = member.join(kept.withColumnRenamed("rep", "kept_id"), "kept_id")
    distance = F.bit_count(F.col("high").bitwiseXOR(F.col("kept_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("kept_low")))
    return (
        signed.select("doc_id", "high", "low", F.col("n_words").alias("n")).join(member, ["high", "low", "n"]).filter("doc_id <> kept_id")
        .groupBy("doc_id").agg(F.min("kept_id").alias("kept_id"), F.min(distance).alias("distance"))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of docs without those of near_duplicates; rows with a null id, text or no word stay.

    Columns come back as they are, whatever their names; all rows of an id that goes go. An empty table stays empty."""
    return common.without_ids(docs, near_duplicates(docs, id_col, text_col, **parameters).select("doc_id"), id_col)
