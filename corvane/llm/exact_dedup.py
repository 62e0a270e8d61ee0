"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level looks only at what the level before left over:

1. lengths of all documents are counted; a document of a length of its own is unique;
2. among the rest, (length, hash of the first characters) is counted; a document alone in its group is unique;
3. only documents of the surviving groups are read in full and hashed with SHA-256.

Levels 1 and 2 aggregate before they shuffle and move numbers only. What survives a level reaches the next scan as a
bit filter of a fixed greatest size (``common.members``), so documents are judged where they are read and no text is
ever exchanged to find out that it is unique. The filter lets every survivor through; of the others it lets some through
(one in a hundred at 670,000 groups, more as it fills), and these find no partner at level 3. It is the same plan at
every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import common

PREFIX_CHARS = 256


def _levels(text: Column, prefix_chars: int) -> tuple[Column, Column]:
    """(length, prefix key): equal texts have equal keys."""
    n = F.length(text)
    return n, F.xxhash64(n, F.substring(text, 1, prefix_chars))


def _survivors(docs: DataFrame, text_col: str, prefix_chars: int, filter_words: int) -> DataFrame:
    """(h): prefix keys of at least two documents, checkpointed."""
    n, prefix = _levels(common.col(text_col), prefix_chars)
    texts = docs.filter(common.col(text_col).isNotNull())
    lengths = common.checkpoint(texts.groupBy(F.xxhash64(n).alias("h")).count().filter("count > 1").select("h"))
    left = common.members(texts.select(F.xxhash64(n).alias("h"), prefix.alias("p")), lengths, filter_words)
    return common.checkpoint(left.groupBy("p").count().filter("count > 1").select(F.col("p").alias("h")))


def duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    filter_words: int = common.FILTER_WORDS,
) -> DataFrame:
    """(doc_id, kept_id, n, full_hash): each row whose text some other row has too, but for the one kept.

    The smallest id of equal texts is kept (nulls last); a row repeated with the same id is a duplicate of
    itself. Null texts are never duplicates; empty texts are equal. Extra columns are ignored, whatever their names.
    An empty table gives an empty result.

    Rows of one text and id become one counted row before they are exchanged; the row to keep is a minimum, which
    combines before the exchange too, so thousands of copies are never sorted in one task.
    """
    survivors = _survivors(docs, text_col, prefix_chars, filter_words)
    text = common.col(text_col)
    n, prefix = _levels(text, prefix_chars)
    narrow = docs.filter(text.isNotNull()).select(common.col(id_col).cast("long").alias("doc_id"), text.alias("text"), n.cast("long").alias("n"), prefix.alias("h"))
    hashed = common.members(narrow, survivors, filter_words).select("doc_id", "n", F.sha2("text", 256).alias("full_hash"))
    copies = common.checkpoint(hashed.groupBy("full_hash", "n", "doc_id").agg(F.count("*").alias("copies")))
    kept = copies.groupBy("full_hash").agg(F.min(common.nulls_last(F.col("doc_id"))).alias("least"), F.sum("copies").alias("rows")).filter("rows > 1")
    met = copies.join(kept.select("full_hash", F.col("least.value").alias("kept_id")), "full_hash")
    again = F.col("copies") - F.when(F.col("doc_id").eqNullSafe(F.col("kept_id")), 1).otherwise(0)
    each = met.withColumn("again", again).filter("again > 0").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("again"))))
    return each.select("doc_id", "kept_id", "n", "full_hash")


def drop_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    filter_words: int = common.FILTER_WORDS,
) -> DataFrame:
    """docs with one row for each text: the one that ``duplicates`` keeps. Rows with a null text all stay.

    Rows outside the surviving groups pass straight through. Inside, one row of each text is picked by an
    aggregate that combines before the shuffle, so thousands of copies don't meet in one task. Of rows with
    equal text and id the one with the smallest hash of all its columns stays. Extra columns come back, whatever
    their names. An empty table gives an empty result.
    """
    survivors = _survivors(docs, text_col, prefix_chars, filter_words)
    n, prefix = _levels(common.col(text_col), prefix_chars)
    keyed = docs.select(common.col(id_col).cast("long").alias("doc_id"), common.col(text_col).alias("text"), common.pack(docs).alias("row"), F.when(common.col(text_col).isNotNull(), prefix).alias("h"))
    flagged = common.flagged(keyed, survivors, filter_words)
    order = F.struct(common.nulls_last(F.col("doc_id")), F.xxhash64(F.col("row").cast("string")))
    picked = flagged.filter("member").groupBy(F.sha2("text", 256)).agg(F.min_by("row", order).alias("row")).select("row.*")
    return flagged.filter("not member").select("row.*").unionByName(picked)


DUPLICATES_SQL = """
SELECT doc_id, kept_id, n, sha256(text) AS full_hash FROM (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
         row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS kept_id
  FROM documents WHERE text IS NOT NULL)
WHERE place > 1
"""
