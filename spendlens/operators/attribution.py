"""Last-touch attribution by channel and its comparison with the simple ROAS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.columns import money_sum, ratio


def last_touch(fact_sessions: DataFrame, revenue_column: str = "gross_amount") -> DataFrame:
    """Revenue and orders of purchase sessions per channel."""
    return (
        fact_sessions.where((F.col("purchase_flag") == 1) & F.col("channel").isNotNull())
        .groupBy("channel")
        .agg(
            money_sum(revenue_column).alias("attributed_revenue"),
            F.count("order_id").alias("attributed_orders"),
        )
    )


def spend_by_channel(channel_daily: DataFrame) -> DataFrame:
    return channel_daily.groupBy("channel").agg(money_sum("spend").alias("spend"))


def attributed_roas(last_touch_totals: DataFrame, channel_spend: DataFrame) -> DataFrame:
    return last_touch_totals.join(channel_spend, "channel", "left").withColumn(
        "attributed_ROAS", ratio("attributed_revenue", "spend")
    )


def roas_comparison(simple: DataFrame, attributed: DataFrame) -> DataFrame:
    """Simple and last-touch ROAS per channel and their absolute difference."""
    return (
        simple.select("channel", F.col("ROAS").alias("simple_ROAS"))
        .join(attributed.select("channel", F.col("attributed_ROAS").alias("last_touch_ROAS")), "channel", "left")
        .withColumn("roas_difference", F.abs(F.col("simple_ROAS") - F.col("last_touch_ROAS")))
    )
