"""Tokenizers, by path: tiktoken rank files, tokenizers JSON files and sentencepiece models."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: How byte-level BPE splits text before the merges (the published pattern of its 50k vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LONG_SPACE = re.compile(r"\s{2000,}")


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str):
    import tiktoken

    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def encode_bytes_bpe(encoding, text: str) -> list[int]:
    """encode_ordinary, but for very long runs of white space, on which its regex engine runs out of stack.

    A run is one piece but for its last character if more text follows: just as the pattern has it.
    """
    if len(text) < 2000 or not _LONG_SPACE.search(text):
        return encoding.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoding.encode_ordinary(text[at : run.start()])
        out += encoding._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return out + encoding.encode_ordinary(text[at:])


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids for the tokenizer file at path, kept for the life of a worker."""
    if path.endswith(".tiktoken"):
        encoding = byte_bpe(path)
        return lambda text: encode_bytes_bpe(encoding, text)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: model.encode(text, num_threads=1)


def with_lengths(df: DataFrame, tokenizer: str = BYTE_BPE, text_col: str = "text") -> DataFrame:
    """df's columns but for the text, and n_tokens: the encoded length; 0 for null and empty texts. A column n_tokens
    that df has is replaced."""
    kept = [c for c in df.columns if c not in (text_col, "n_tokens")]
    narrow = df.select(*[common.col(c) for c in kept], common.col(text_col).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            n = np.array([len(encode(t)) if t else 0 for t in batch.column("__text").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(n)], names=[*kept, "n_tokens"])

    schema = narrow.drop("__text").withColumn("n_tokens", F.lit(0).cast("long")).schema
    return narrow.mapInArrow(count, schema)
