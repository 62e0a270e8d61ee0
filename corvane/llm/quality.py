"""Quality classifier by compression with two zstandard dictionaries.

One dictionary is trained on good and one on bad labelled text. A text is compressed in blocks of
``BLOCK`` bytes under both; blocks keep a long text from becoming its own dictionary. The difference
of the two totals divided by their sum is the evidence: relative to the compressed size, so that repetitive junk,
which is small under both dictionaries, counts like other text. A logistic curve, fitted on other labelled documents
than those in the dictionaries and weighted by the shares of the two classes among all labels, turns it into a
probability that the text is good. As an option the curve has the compressed ratio as a second variable.

Only the fit works on a sample: the ``TRAIN`` and ``CALIBRATE`` labelled documents of either class with
the smallest hashed ids, of at most ``FIT_CHARS`` characters each. Scoring covers every document from its first byte
to its last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import common

#: Labelled documents of either class for the dictionaries and for the curve.
TRAIN, CALIBRATE = 1500, 1500
#: Labelled documents with more characters are not used for the fit, which bounds what the driver reads.
FIT_CHARS = 50_000
#: Bytes of a dictionary and of a block, and the compression level.
DICTIONARY, BLOCK, LEVEL = 112640, 4096, 3
#: Documents are rejected below this probability.
KEEP = 0.5


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve: a slope for the difference, one for the ratio, and the intercept."""

    good: bytes
    bad: bytes
    slope: float = 30.0
    ratio_slope: float = 0.0
    intercept: float = 0.0

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        def one(raw: bytes) -> zstandard.ZstdCompressor:
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

        return one(self.good), one(self.bad)

    def probability(self, difference: float, ratio: float) -> float:
        z = self.slope * difference + self.ratio_slope * ratio + self.intercept
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def measure(text: str, good, bad) -> tuple[float, float] | None:
    """(difference, ratio): bytes under the bad dictionary less bytes under the good one, divided by their sum, and the
    smaller of the two by the bytes of the text; None for a text without bytes."""
    raw = text.encode("utf-8", "replace")
    if not raw:
        return None
    blocks = _blocks(raw)
    under_good, under_bad = sum(len(good.compress(b)) for b in blocks), sum(len(bad.compress(b)) for b in blocks)
    return (under_bad - under_good) / (under_bad + under_good), min(under_good, under_bad) / len(raw)


def _dictionary(texts: list[str]) -> bytes:
    samples = [b for t in texts for b in _blocks(t.encode("utf-8", "replace"))]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"\n".join(samples)[-DICTIONARY:] or b"\0" * 16


def _logistic(x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and intercept, by Newton's method with a small ridge."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.c_[x / scale, np.ones(len(x))]
    beta, ridge = np.zeros(design.shape[1]), np.diag([1e-2] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, design.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return np.r_[beta[:-1] / scale, beta[-1]]


def fit_texts(good: list[str], bad: list[str], good_held: list[str], bad_held: list[str], good_share: float = 0.5, use_ratio: bool = False) -> Model:
    model = Model(_dictionary(good), _dictionary(bad))
    pair = model.compressors()
    found = [(m, y) for y, texts in ((1, good_held), (0, bad_held)) for t in texts if (m := measure(t, *pair)) is not None]
    y = np.array([c for _, c in found])
    if len(set(y.tolist())) < 2:
        return model
    share = np.where(y == 1, good_share / (y == 1).sum(), (1 - good_share) / (y == 0).sum()) * len(y)
    fitted = _logistic(np.array([m[: 1 + use_ratio] for m, _ in found]), share, y).tolist()
    return Model(model.good, model.bad, fitted[0], fitted[1] if use_ratio else 0.0, fitted[-1])


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN, calibrate: int = CALIBRATE, use_ratio: bool = False, fit_chars: int = FIT_CHARS) -> Model | None:
    """The model, or None if either class has no labelled document with text.

    docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad; other values and nulls are left out, and so are ids with
    both). Of several texts of one id the smallest is taken; texts of more than fit_chars characters are not used.
    """
    order = F.xxhash64("doc_id")
    labels = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    labels = labels.filter("quality = most").select("doc_id", "quality")
    chosen = None
    for quality in (0, 1):
        part = labels.filter(F.col("quality") == quality).orderBy(order, "doc_id").limit(train + calibrate)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", "text").filter(F.length("text").between(1, fit_chars)).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select(order.alias("at"), "doc_id", "quality", "text").toPandas().sort_values(["at", "doc_id", "text"])
    by = {q: rows.loc[rows.quality == q, "text"].tolist() for q in (0, 1)}
    if not by[0] or not by[1]:
        return None
    # with few labels half of each class is held out, and a lone document serves for both
    cut = {q: min(train, max(1, len(by[q]) // 2)) for q in (0, 1)}
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    share = counts[1] / (counts[0] + counts[1])
    return fit_texts(by[1][: cut[1]], by[0][: cut[0]], by[1][cut[1] :] or by[1], by[0][cut[0] :] or by[0], share, use_ratio)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """docs packed as (row, difference, ratio, score, keep).

    Null and empty texts, and all texts when there is no model, can't be judged: difference, ratio and score
    are null and keep is true.
    """
    packed = docs.select(common.pack(docs).alias("row"), common.col(text_col).alias("text"))
    if model is None:
        none = [F.lit(None).cast("double").alias(c) for c in ("difference", "ratio", "score")]
        return packed.select("row", *none, F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pair = shared.value, shared.value.compressors()
        for batch in batches:
            found = [None if t is None else measure(t, *pair) for t in batch.column("text").to_pylist()]
            rated = [None if m is None else model.probability(*m) for m in found]
            columns = [[m and m[0] for m in found], [m and m[1] for m in found], rated]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[pa.array(c, pa.float64()) for c in columns], pa.array([p is None or p >= keep for p in rated], pa.bool_())],
                names=["row", "difference", "ratio", "score", "keep"],
            )

    schema = T.StructType([
        packed.schema["row"], *[T.StructField(c, T.DoubleType()) for c in ("difference", "ratio", "score")], T.StructField("keep", T.BooleanType())])
    return packed.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, train: int = TRAIN, calibrate: int = CALIBRATE, keep: float = KEEP, use_ratio: bool = False) -> DataFrame:
    """(doc_id, difference, ratio, score, keep) of every row of docs, repeated rows included.

    Texts that can't be judged (null, empty, or without a model for want of labels) are kept, with nulls for the rest.
    Extra columns are ignored, whatever their names. An empty table gives an empty result.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(narrow, fit(docs, labels, train, calibrate, use_ratio), "text", keep).select("row.doc_id", "difference", "ratio", "score", "keep")


def drop_rejected(docs: DataFrame, labels: DataFrame, train: int = TRAIN, calibrate: int = CALIBRATE, keep: float = KEEP, use_ratio: bool = False) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns, whatever their names. Rows with a null or empty
    text stay, repeated rows share their fate, an empty table stays empty."""
    return score(docs, fit(docs, labels, train, calibrate, use_ratio), "text", keep).filter("keep").select("row.*")
