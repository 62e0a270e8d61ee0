"""Token counts: exact histogram of encoded lengths with suffix sums.

Documents shrink to one row for each distinct length, whose number is bounded by the longest document and
not by the corpus. Over those rows suffix sums answer, for every context limit at which an answer changes,
how many documents and tokens there are beyond it and what is left after truncation to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import common, tokens


def length_histogram(docs: DataFrame, tokenizer: str = tokens.BYTE_BPE, text_col: str = "text") -> DataFrame:
    """(length, n_docs): how many rows have each encoded length. Null and empty texts have length 0."""
    lengths = tokens.with_lengths(docs.select(common.col(text_col).alias("text")), tokenizer)
    return lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """One row for each distinct length L, taken as a context limit, with exact answers:

    n_docs; docs_at_least and tokens_at_least (documents of length L or more); truncated_total, the tokens
    left when every document is cut to L; lost_tokens, those cut off; quantile, the share of documents of
    at most L tokens. An empty table gives an empty result.
    """
    up = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col("length") * F.col("n_docs")
    sums = histogram.select(
        "length",
        "n_docs",
        F.sum("n_docs").over(up).alias("docs_at_least"),
        F.sum(mass).over(up).alias("tokens_at_least"),
        F.sum("n_docs").over(whole).alias("all_docs"),
        F.sum(mass).over(whole).alias("all_tokens"),
    )
    lost = F.col("tokens_at_least") - F.col("length") * F.col("docs_at_least")
    return sums.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - lost).alias("truncated_total"),
        lost.alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """(context_limit, total_tokens, truncated_total, longer_docs) for any limits, from the suffix sums.

    The answer at a limit follows from the smallest length that is at least the limit: below it no document
    ends between the two, so only the documents of that length or more lose tokens.
    """
    totals = sums.agg(F.sum(F.col("length") * F.col("n_docs")).alias("total_tokens"))
    wanted = limits.toDF("context_limit").distinct()
    met = F.broadcast(wanted).join(sums, F.col("length") >= F.col("context_limit"), "left")
    first = met.groupBy("context_limit").agg(F.min_by(F.struct("length", "n_docs", "docs_at_least", "tokens_at_least"), "length").alias("s"))
    lost = F.coalesce(F.col("s.tokens_at_least") - F.col("context_limit") * F.col("s.docs_at_least"), F.lit(0))
    longer = F.coalesce(F.when(F.col("s.length") == F.col("context_limit"), F.col("s.docs_at_least") - F.col("s.n_docs")).otherwise(F.col("s.docs_at_least")), F.lit(0))
    total = F.coalesce("total_tokens", F.lit(0))
    return first.crossJoin(F.broadcast(totals)).select(
        "context_limit", total.alias("total_tokens"), (total - lost).alias("truncated_total"), longer.alias("longer_docs"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """(length): the smallest length that at least a share q of the documents doesn't exceed."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))


def token_histogram(docs: DataFrame, tokenizer: str = tokens.BYTE_BPE) -> DataFrame:
    """suffix_sums of the lengths of all rows of docs (text), repeated ones included.

    Null and empty texts have length 0. Extra columns are ignored, whatever their names. An empty table gives an empty result.
    """
    return suffix_sums(length_histogram(docs, tokenizer))
