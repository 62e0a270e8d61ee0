"""Vector bin packing for instruction data, by the dot-product heuristic.

An example needs tokens, one segment and loss-bearing tokens; a bin (one training sequence) has a limit on
each of the three. Bins are filled one after the other: of the examples that still fit, the one with the
largest dot product between its needs and the bin's room, both relative to the limits, goes in next, so
that a bin which is short of loss tokens attracts examples rich in them. A bin is closed when nothing fits.

Examples are packed in shards of about ``shard_examples``, chosen by a hash of the id, each on its own: the
work grows with the data, only the last bin of a shard is partly filled for want of examples, and no
example moves between executors more than once. Within a shard examples with equal needs are one class.

An example beyond a limit by itself is cut into consecutive parts that fit; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common, tokens

#: Limits of a bin: tokens, segments, loss-bearing tokens.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 32, 3072
SHARD_EXAMPLES = 20_000


def pack_vectors(needs: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of every item. needs: (n, d) within limits; ties go to the item that comes first."""
    n = len(needs)
    bins = np.zeros(n, dtype=np.int64)
    if not n:
        return bins
    classes, inverse = np.unique(needs, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    order = np.argsort(inverse, kind="stable")
    start = np.searchsorted(inverse[order], np.arange(len(classes)))
    left = np.bincount(inverse, minlength=len(classes))
    taken = np.zeros(len(classes), dtype=np.int64)
    relative = classes / limits
    alive = np.arange(len(classes))
    room, current, empty = limits.astype(np.float64).copy(), 0, True
    remaining = n
    live, live_relative = classes, relative
    while remaining:
        fits = (live <= room).all(axis=1) & (left[alive] > 0)
        if not fits.any():
            if empty:
                raise ValueError("an item is larger than a bin")
            current, room, empty = current + 1, limits.astype(np.float64).copy(), True
            keep = left[alive] > 0
            alive = alive[keep]
            live, live_relative = classes[alive], relative[alive]
            continue
        score = np.where(fits, live_relative @ (room / limits), -1.0)
        k = alive[int(np.argmax(score))]
        bins[order[start[k] + taken[k]]] = current
        taken[k] += 1
        left[k] -= 1
        remaining -= 1
        room -= classes[k]
        empty = False
    return bins


def _cut(spans: list[tuple[int, bool]], max_tokens: int, max_loss: int) -> list[tuple[int, int]]:
    """(tokens, loss tokens) of consecutive parts of an example whose turns have spans (tokens, is loss)."""
    parts, tokens_in, loss_in = [], 0, 0
    for size, loss in spans:
        while size:
            take = min(size, max_tokens - tokens_in, max_loss - loss_in if loss else size)
            if take <= 0:
                parts.append((tokens_in, loss_in))
                tokens_in = loss_in = 0
                continue
            tokens_in, loss_in, size = tokens_in + take, loss_in + take * loss, size - take
    if tokens_in or not parts:
        parts.append((tokens_in, loss_in))
    return parts


def examples_from_conversations(conversations: DataFrame, tokenizer: str = tokens.BYTE_BPE) -> DataFrame:
    """(id, spans): each conversation with the token counts of its turns in order; assistant turns bear loss.

    A null text is an empty turn; a null turn number comes first; rows with a null conv_id form one example
    with a null id; repeated rows are turns of their own.
    """
    narrow = conversations.select(F.col("conv_id").cast("long").alias("id"), "turn", "role", "text")
    counted = tokens.with_lengths(narrow, tokenizer)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.col("n_tokens").alias("size"))
    turns = counted.groupBy("id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select("id", F.transform("turns", lambda t: F.struct(t.size.alias("size"), (t.role == "assistant").alias("loss"))).alias("spans"))


def examples_from_documents(docs: DataFrame, tokenizer: str = tokens.BYTE_BPE) -> DataFrame:
    """(id, spans): each row of docs, all of whose tokens bear loss."""
    counted = tokens.with_lengths(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), tokenizer)
    return counted.select("id", F.array(F.struct(F.col("n_tokens").alias("size"), F.lit(True).alias("loss"))).alias("spans"))


def pack(
    examples: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    shard_examples: int = SHARD_EXAMPLES,
) -> DataFrame:
    """(id, part, bin_id, tokens, segments, loss_tokens): one row for each example or part of one.

    bin_id holds the shard in its upper and the bin within the shard in its lower 32 bits. Examples without
    tokens take a segment. Repeated examples are packed once each. An empty table gives an empty result.
    """
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be at least 1")
    limits = np.array([max_tokens, max_segments, max_loss], dtype=np.int64)
    examples = common.checkpoint(examples)
    shards = max(1, -(-examples.count() // shard_examples))
    # ids travel as strings: pandas would turn integers with a null among them into floats
    sharded = examples.select(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(shards)).alias("shard"), F.col("id").cast("string"), "spans")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for example, spans in zip(frame["id"], frame["spans"], strict=True):
            for part, (size, loss) in enumerate(_cut([(s["size"], bool(s["loss"])) for s in spans], max_tokens, max_loss)):
                rows.append((example, part, size, 1, loss))
        out = pd.DataFrame(rows, columns=["id", "part", "tokens", "segments", "loss_tokens"])
        out = out.sort_values(["tokens", "loss_tokens", "id", "part"], ascending=[False, False, True, True], kind="stable", ignore_index=True)
        bins = pack_vectors(out[["tokens", "segments", "loss_tokens"]].to_numpy(np.int64), limits)
        out["bin_id"] = bins + (int(frame["shard"].iloc[0]) << 32)
        return out[["id", "part", "bin_id", "tokens", "segments", "loss_tokens"]]

    # shards are little data and much work: as many tasks as shards, which adaptive execution doesn't put together
    sharded = sharded.repartition(min(shards, 100_000), "shard")
    packed = sharded.groupBy("shard").applyInPandas(run, "id string, part int, bin_id long, tokens long, segments long, loss_tokens long")
    return packed.withColumn("id", F.col("id").cast("long"))


def pack_conversations(conversations: DataFrame, tokenizer: str = tokens.BYTE_BPE, **limits) -> DataFrame:
    """(conv_id, part, bin_id, tokens, segments, loss_tokens) of conversations (conv_id, turn, role, text).

    Assistant turns bear loss. Null texts are turns without tokens, null turn numbers come first, turns of equal
    number are ordered by role and length; rows with a null conv_id are one example with a null id. Repeated rows are turns
    of their own. A turn longer than a bin is cut into parts. Extra columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    return pack(examples_from_conversations(conversations, tokenizer), **limits).withColumnRenamed("id", "conv_id")


def pack_documents(docs: DataFrame, tokenizer: str = tokens.BYTE_BPE, max_loss: int = MAX_TOKENS, **limits) -> DataFrame:
    """(doc_id, part, bin_id, tokens, segments, loss_tokens) of documents (doc_id, text).

    Documents bear loss on every token, so their loss limit is the token limit unless set otherwise. Rows with a
    null or empty text take a segment without tokens; rows with a null id and repeated rows are packed once each; texts longer
    than a bin are cut into parts. Extra columns are ignored, whatever their names. An empty table gives an empty result.
    """
    return pack(examples_from_documents(docs, tokenizer), max_loss=max_loss, **limits).withColumnRenamed("id", "doc_id")
