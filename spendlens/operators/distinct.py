"""Distinct sessions and users that roll up: bitmaps and sketches stored per day, merged to any coarser grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Users of a sketch are counted to about 1.04 / sqrt(2 ** LG_REGISTERS).
LG_REGISTERS = 12
#: Order values keep their rank to about this share of all orders.
RANK_ERROR = 0.02


def _number(column: str) -> Column:
    return F.col(column).cast("bigint")


def session_bitmaps(fact_sessions: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Per date and campaign (with its home channel) the sessions, users and buyers as bitmaps, a row for each bucket of
    32,768 numbers: ``date``, ``campaign_id``, ``channel``, ``kind``, ``bucket``, ``bits``.

    Ids are whole numbers (others raise); a bitmap has 4 kB whatever it holds, so ids should be dense within a day, as
    running numbers are. Rows without a date stay out; null ids are not counted. A session with two orders is one bit.
    """
    kinds = F.explode(
        F.array(
            F.struct(F.lit("sessions").alias("kind"), _number("session_id").alias("id")),
            F.struct(F.lit("users").alias("kind"), _number("user_id").alias("id")),
            F.struct(F.lit("buyers").alias("kind"), F.when(F.col("purchase_flag") == 1, _number("user_id")).alias("id")),
        )
    )
    home = campaigns.groupBy("campaign_id").agg(F.min("channel").alias("channel"))
    return (
        fact_sessions.where(F.col("session_date").isNotNull())
        .select(F.col("session_date").alias("date"), "campaign_id", kinds.alias("x"))
        .select("date", "campaign_id", "x.kind", "x.id")
        .where("id IS NOT NULL")
        .groupBy("date", "campaign_id", "kind", F.bitmap_bucket_number("id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
        .join(home, "campaign_id", "left")
    )


def distinct_counts(bitmaps: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Exact distinct sessions, users and buyers per group, from the stored bitmaps alone. No keys: the total."""
    merged = bitmaps.groupBy(*[c.alias(k) for k, c in keys.items()], "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    counted = merged.select(*keys, "kind", F.bitmap_count("bits").alias("n"))
    kinds = ("sessions", "users", "buyers")
    return counted.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds])


def daily_sketches(fact_sessions: DataFrame, revenue_column: str = "gross_amount") -> DataFrame:
    """Per date a sketch of its users (distinct count) and one of its order values (quantiles), some kilobytes each."""
    value = F.when(F.col("purchase_flag") == 1, F.col(revenue_column).cast("double"))
    return (
        fact_sessions.where(F.col("session_date").isNotNull())
        .groupBy(F.col("session_date").alias("date"))
        .agg(
            F.hll_sketch_agg(F.col("user_id").cast("string"), LG_REGISTERS).alias("users"),
            F.kll_sketch_agg_double(value, 400).alias("order_values"),
        )
    )


def merged_sketches(sketches: DataFrame, keys: dict[str, Column], quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Approximate users and quantiles of order values per group, from the stored sketches alone.

    Users are within some percent (three standard errors: 3 x 1.04 / sqrt(4,096), 4.9 %), a quantile is a value whose rank
    is within RANK_ERROR. Groups without orders have null quantiles.
    """
    merged = sketches.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.kll_merge_agg_double("order_values").alias("values")
    )
    n = F.kll_sketch_get_n_double("values")
    ranks = [F.when(n > 0, F.kll_sketch_get_quantile_double("values", F.lit(q))).alias(f"q{round(100 * q)}") for q in quantiles]
    return merged.select(*keys, "users", n.alias("orders"), *ranks)
