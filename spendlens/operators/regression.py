"""Daily revenue regression: table, repeatable split, least squares, scores, coefficients."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.config import CHANNELS, RegressionConfig
from spendlens.functions.columns import ratio

TARGET = "daily_revenue"
CONTROLS = ("day_of_week", "promo_flag")
CHANNEL_FEATURES = tuple(f"spend_{c}" for c in CHANNELS)
FEATURES = ("total_spend", *CONTROLS, *CHANNEL_FEATURES)
NULL_SHARE = 1e-10  # of the largest eigenvalue: below it a direction counts as null


def regression_table(channel_daily: DataFrame, key: str = "date") -> DataFrame:
    """Revenue, total spend, weekday, promo flag and spend per channel, one row per day (or week).

    The channel pivot is a set of conditional sums inside the same aggregate, so nothing is joined back.
    """
    return channel_daily.groupBy(key).agg(
        F.expr(f"CAST(sum(attributed_revenue) AS DOUBLE) AS {TARGET}"),
        F.expr("CAST(sum(spend) AS DOUBLE) AS total_spend"),
        F.max("day_of_week").alias("day_of_week"),
        F.max("promo_flag").alias("promo_flag"),
        *[
            F.expr(f"CAST(coalesce(sum(spend) FILTER (WHERE channel = '{channel}'), 0) AS DOUBLE) AS {name}")
            for name, channel in zip(CHANNEL_FEATURES, CHANNELS)
        ],
    )


def with_split(table: DataFrame, config: RegressionConfig = RegressionConfig(), key: str = "date") -> DataFrame:
    """Mark every fifth day as test. A day keeps its side when history grows, and no ordering of days is needed."""
    day = F.unix_date(key) if key == "date" else F.col(key)
    return table.withColumn("is_test", F.pmod(day, F.lit(config.split_buckets)) == config.test_bucket)


@dataclass(frozen=True)
class OlsFit:
    """Intercept and one coefficient per feature; None throughout when there was nothing to fit."""

    intercept: float | None
    coefficients: dict[str, float | None]

    def prediction(self) -> Column:
        terms = F.lit(self.intercept).cast("double")
        for feature, weight in self.coefficients.items():
            terms = terms + F.lit(weight).cast("double") * F.col(feature).cast("double")
        return terms

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (feature, coefficient, absolute_coefficient)."""
        return spark.createDataFrame(
            list(self.coefficients.items()), "feature string, coefficient double"
        ).withColumn("absolute_coefficient", F.abs("coefficient"))


def _minimum_norm(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The shortest b that solves gram b = target in least squares; gram is symmetric, of fixed size.

    Which directions count as null is decided on the correlation scale, where features of any unit compare; the solution
    is then made orthogonal to those directions in the features' own units.
    """
    scale = np.sqrt(np.diag(gram))
    used = scale > 0
    result = np.zeros(len(gram))
    if not used.any():
        return result
    scale = scale[used]
    values, vectors = np.linalg.eigh(gram[np.ix_(used, used)] / np.outer(scale, scale))
    kept = values > NULL_SHARE * values.max()
    b = vectors[:, kept] @ ((vectors[:, kept].T @ (target[used] / scale)) / values[kept]) / scale
    null, _ = np.linalg.qr(vectors[:, ~kept] / scale[:, None])
    result[used] = b - null @ (null.T @ b)
    return result


def fit_ols(train: DataFrame) -> OlsFit:
    """Minimum-norm least squares of daily revenue on the eight features, whichever of them are collinear.

    ``total_spend`` is the sum of the channel columns, so the features always are. One aggregate gives the means and the
    centred products (44 numbers); the system of eight equations is solved on the driver. Constant features get 0.
    """
    pairs = [(f, g) for i, f in enumerate(FEATURES) for g in (*FEATURES[i:], TARGET)]
    sums = train.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f) for f in (*FEATURES, TARGET)],
        *[F.covar_pop(f, g).alias(f"{f}*{g}") for f, g in pairs],
    ).first()
    if sums["n"] == 0:
        return OlsFit(None, dict.fromkeys(FEATURES))
    gram = np.array([[sums[f"{f}*{g}" if f"{f}*{g}" in sums else f"{g}*{f}"] for g in FEATURES] for f in FEATURES])
    b = _minimum_norm(gram, np.array([sums[f"{f}*{TARGET}"] for f in FEATURES]))
    intercept = sums[TARGET] - sum(w * sums[f] for f, w in zip(FEATURES, b))
    return OlsFit(float(intercept), {f: float(w) for f, w in zip(FEATURES, b)})


def regression_metrics(table: DataFrame, fit: OlsFit) -> DataFrame:
    """R2, MAE and MAPE (percent, days with revenue only) over the test days."""
    y, p = F.col(TARGET), F.col("prediction")
    scored = table.where("is_test").withColumn("prediction", fit.prediction())
    totals = scored.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.sum((y - p) * (y - p)).alias("sse"),
        (F.var_pop(y) * F.count(y)).alias("sst"),
        F.avg(F.abs(y - p)).alias("mae"),
        (F.avg(F.when(y != 0, F.abs((y - p) / y))) * 100).alias("mape"),
    )
    return totals.select("n_test", (1 - ratio("sse", "sst", None)).alias("r2"), "mae", "mape")


def channel_performance(attributed: DataFrame, fit: OlsFit) -> DataFrame:
    """Attributed ROAS next to the regression coefficient and the identified marginal effect per channel."""
    weights = (
        fit.table(attributed.sparkSession)
        .where(F.col("feature").startswith("spend_"))
        .select(
            F.regexp_replace("feature", "^spend_", "").alias("channel"),
            F.col("coefficient").alias("regression_coefficient"),
        )
    )
    marginal = F.col("regression_coefficient") + F.lit(fit.coefficients["total_spend"]).cast("double")
    return (
        attributed.select("channel", "attributed_ROAS")
        .join(weights, "channel", "left")
        .withColumn("marginal_effect", marginal)
    )


# --- How sure the coefficients are ---------------------------------------------------------------------------------


def portable_hash(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of the text's MD5 as a whole number: the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def poisson_cuts(bits: int = 32) -> list[int]:
    """Where a whole number of so many random bits turns from one count of a Poisson(1) variable to the next."""
    below = accumulate(math.exp(-1) / math.factorial(k) for k in range(16))
    return [cut for p in below if (cut := round(p * 2**bits)) < 2**bits]


def bootstrap_coefficients(train: DataFrame, replicates: int = 200, key: str = "date") -> DataFrame:
    """``replicate``, ``feature``, ``coefficient``: the fit of ``fit_ols`` on ``replicates`` Poisson resamples of the days.

    A day counts in a replicate as often as a hash of the two says, so a resample does not depend on how the days are
    spread, or on which task is run again. One aggregate makes the centred products of all replicates (rows are days times
    replicates, combined before the shuffle); each replicate's eight equations are then solved in the tasks.
    """
    names = (*FEATURES, TARGET)
    means = train.agg(*[F.avg(c).alias(c) for c in names])
    # centred on the whole first, which keeps the products small; the replicate's own mean is taken out below
    centred = [(F.col(c) - means.select(c).scalar()).cast("double").alias(c) for c in names]
    number = portable_hash(F.concat_ws(":", F.col(key).cast("string"), F.col("replicate").cast("string")), 8)
    weight = sum((F.when(F.col("_u") >= cut, 1).otherwise(0) for cut in poisson_cuts()), F.lit(0))
    pairs = [(f, g) for i, f in enumerate(FEATURES) for g in (*FEATURES[i:], TARGET)]
    moments = (
        train.select(key, *centred, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
        .withColumn("_u", number)
        .withColumn("_w", weight.cast("double"))
        .where("_w > 0")
        .groupBy("replicate")
        .agg(
            F.sum("_w").alias("n"),
            *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in names],
            *[F.sum(F.col("_w") * F.col(f) * F.col(g)).alias(f"{f}*{g}") for f, g in pairs],
        )
    )

    def fitted(row: dict[str, float]) -> np.ndarray:
        def product(f: str, g: str) -> float:
            return row[f"{f}*{g}" if f"{f}*{g}" in row else f"{g}*{f}"] - row[f] * row[g] / row["n"]

        gram = np.array([[product(f, g) for g in FEATURES] for f in FEATURES])
        # constant in this replicate: what is left of its square is rounding
        varies = np.diag(gram) > NULL_SHARE * np.array([row[f"{f}*{f}"] for f in FEATURES])
        return _minimum_norm(gram * np.outer(varies, varies), np.array([product(f, TARGET) for f in FEATURES]) * varies)

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield pd.DataFrame({"replicate": row["replicate"], "feature": FEATURES, "coefficient": fitted(row)})

    return moments.mapInPandas(solved, "replicate int, feature string, coefficient double")


def coefficient_intervals(fit: OlsFit, resampled: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Each coefficient with the ends of its percentile interval, and the share of replicates in which it is positive."""
    tail = (1 - confidence) / 2
    ends = resampled.groupBy("feature").agg(
        F.percentile("coefficient", tail).alias("lower"),
        F.percentile("coefficient", 1 - tail).alias("upper"),
        F.avg((F.round("coefficient", 9) > 0).cast("double")).alias("positive_share"),
        F.count(F.lit(1)).alias("replicates"),
    )
    return fit.table(resampled.sparkSession).drop("absolute_coefficient").join(ends, "feature", "left")


# --- A split of an exact size --------------------------------------------------------------------------------------

HASH_DIGITS, BUCKET_BITS = 15, 16


def with_exact_split(table: DataFrame, share: float = 0.2, key: str = "date", seed: str = "") -> DataFrame:
    """``is_test`` for exactly ceil(share x rows) rows, those whose hash of ``key`` (unique) comes first.

    The hash of the last test row is found without sorting the table: rows are counted per bucket of leading bits (65,536
    at most, the only list that one task sees), and hashes are ranked inside the one bucket that the wanted rank falls
    into. ``table`` is read three times, so hand over a stored one. A row keeps its side unless the share's limit moves
    past it. Rows without a key hash like an empty text.
    """
    number = portable_hash(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), HASH_DIGITS)
    hashed = table.withColumn("_h", number).withColumn("_bucket", F.shiftright("_h", 4 * HASH_DIGITS - BUCKET_BITS))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.partitionBy()
    border = (
        hashed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_upto": F.sum("_n").over(upto), "_wanted": F.ceil(F.sum("_n").over(all_rows) * F.lit(Decimal(str(share))))})
        .where("_wanted > 0 AND _upto >= _wanted AND _upto - _n < _wanted")
        .select(F.col("_bucket").alias("_b"), (F.col("_wanted") - (F.col("_upto") - F.col("_n"))).alias("_rank"))
    )
    inside = hashed.join(F.broadcast(border), F.col("_bucket") == F.col("_b"))  # one row, or none of an empty table
    ranked = inside.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key)))
    last = ranked.where("_place = _rank").agg(F.max(F.struct("_h", key))).scalar()
    here = F.struct("_h", F.col(key))
    return hashed.withColumn("is_test", F.coalesce(here <= last, F.lit(False))).drop("_h", "_bucket")
