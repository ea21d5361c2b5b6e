"""Toxicity: a linear classifier in numpy, trained by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import bounded_batches
from spendlens.llm.words import Words, mix

#: Most rows the classifier is trained on, the first by a hash of the id. The samples bound training only.
POSITIVES, UNLABELLED = 3_000, 9_000
#: Buckets of hashed features.
BUCKETS = 1 << 20
_PREFIX = 4  # bytes


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs, distinct and sorted: the words of a text, lower-cased, and their first bytes."""
    hashed = words.hashes
    kept = words.last - words.first >= _PREFIX
    first = words.first[kept]
    start = np.zeros(len(first), np.uint64)
    for i in range(_PREFIX):
        byte = words.data[first + i]
        start |= np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint64) << np.uint64(8 * i)
    row = np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))
    rows = np.concatenate((row, row[kept]))
    buckets = np.concatenate((hashed, mix(start + np.uint64(1)))) % np.uint64(BUCKETS)
    pairs = np.unique(rows * BUCKETS + buckets.astype(np.int64))
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    bias: float

    def scores(self, n: int, rows: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Probability of each of n rows; without features, that of the bias."""
        return _sigmoid(self.bias + np.bincount(rows, self.weights[buckets], n))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _telling(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: float) -> np.ndarray:
    """Buckets that are more frequent among positives than among unlabelled texts, by ``least`` standard errors of the
    log ratio."""
    p, u = (np.bincount(np.concatenate(x), minlength=BUCKETS) + 0.5 for x in (positive, unlabelled))
    ratio = np.log(p / (len(positive) + 1)) - np.log(u / (len(unlabelled) + 1))
    return ratio / np.sqrt(1 / p + 1 / u) > least


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05,
    decay: float = 1e-4, screen: float = 4.0,
) -> Classifier:
    """Minimise the non-negative risk: prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)]), logistic loss.

    Where the second term falls under zero, unlabelled positives are being fitted as negatives, so the step goes back
    along its gradient. Lists hold the buckets of each row. Features that do not set positives apart get no weight (see
    ``_telling``). Without positives the score is the prior everywhere.
    """
    prior = min(max(prior, 1e-3), 0.99)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Classifier(np.zeros(BUCKETS), bias)
    telling = _telling(positive, unlabelled, screen)
    both = [x[telling[x]] for x in positive + unlabelled]
    sizes = np.array([len(x) for x in both])
    columns, cols = np.unique(np.concatenate(both), return_inverse=True)  # only buckets that occur
    rows = np.repeat(np.arange(len(both)), sizes)
    n_p, n_u, n = len(positive), len(unlabelled), len(both)
    known = np.arange(n) < n_p
    w, m, v = (np.zeros(len(columns) + 1) for _ in range(3))
    w[-1] = bias
    for step in range(1, steps + 1):
        f = _sigmoid(w[-1] + np.bincount(rows, w[cols], n))
        negative = np.where(known, -prior / n_p, 1 / n_u)  # weights of l(-) = -log(1 - f)
        if (negative * -np.log1p(-np.clip(f, 0, 1 - 1e-12))).sum() >= 0:
            slope = np.where(known, prior / n_p * (f - 1), 0) + negative * f
        else:
            slope = -negative * f
        gradient = np.append(np.bincount(cols, slope[rows], len(columns)), slope.sum())
        gradient[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[columns] = w[:-1]
    return Classifier(weights, float(w[-1]))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether the checksum of the id as text falls into the fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, buckets = features(Words(batch.column(2), lower=True))
        cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        packed = [buckets[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = [*batch.columns[:2], pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["positive", "_id", "buckets"])


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None,
) -> Classifier:
    """Learn from confirmed toxic texts and from texts taken without their labels.

    Rows of the held-out fold are not used. ``prior`` is the share of toxic texts; by default that among all labelled
    rows outside the fold (the only use made of labels other than toxic). The samples are the first distinct ids by
    their hashes: at most ``positives`` toxic ones and ``unlabelled`` of all. Of different texts of one id, the one whose
    features come first counts; of different labels, the greatest. The same rows give the same weights, in whatever order
    they come and whichever task is run again. No labels, or none that is toxic: the score is the prior everywhere.
    """
    bounded_batches(docs.sparkSession)
    known = (
        labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(toxic).alias("_toxic"))
    )
    if prior is None:
        prior = known.agg(F.avg((F.col("_toxic") == 1).cast("double"))).first()[0] or 0.0
    chosen = known.where("_toxic = 1").orderBy(F.xxhash64("_id"), "_id").limit(positives).select("_id")
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    learning = own.where(~held_out(F.col("_id")))
    sample = learning.select("_id").distinct().orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(unlabelled)
    taken = (
        learning.join(F.broadcast(chosen), "_id", "left_semi")
        .select(F.lit(True).alias("positive"), "_id", "_text")
        .unionByName(
            learning.join(F.broadcast(sample), "_id", "left_semi").select(F.lit(False).alias("positive"), "_id", "_text")
        )
    )
    schema = T.StructType([*taken.schema.fields[:2], T.StructField("buckets", T.BinaryType())])
    rows = (
        taken.mapInArrow(_buckets, schema)
        .groupBy("positive", "_id")
        .agg(F.min("buckets").alias("buckets"))  # an id that many rows share is one training row
        .collect()  # at most positives + unlabelled rows, of 4 MB at the very most
    )
    rows.sort(key=lambda r: (r[0], r[1]))  # so that the weights do not depend on how the rows came
    known_rows, other_rows = ([np.frombuffer(r[2], "<u4") for r in rows if r[0] is is_known] for is_known in (True, False))
    return fit(known_rows, other_rows, float(prior))


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Documents with ``score`` (0 to 1) and ``predicted`` (1 from one half on); columns of these names are replaced.

    Only the text is an input. Null and empty texts get the score of a text without features. The weights are broadcast:
    their size is that of the buckets (4 MB), whatever the data.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    ordered = docs.select(*[c for c in rest if c != text], F.col(text))
    schema = T.StructType([*ordered.schema.fields, T.StructField("score", T.DoubleType())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*sent.value)
        for batch in batches:
            value = own.scores(batch.num_rows, *features(Words(batch.column(batch.num_columns - 1), lower=True)))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value, pa.float64())], names=schema.fieldNames())

    return (
        ordered.mapInArrow(scores, schema)
        .select(*rest, "score")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
