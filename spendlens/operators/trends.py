"""Daily and weekly KPI trends with promotion flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.columns import money_sum, ratio, whole_sum
from spendlens.functions.kpis import with_kpis


def _trend(channel_daily: DataFrame, key: str, prefix: str) -> DataFrame:
    """Sums, CVR, ROAS and whether any promotion ran, per time key: one aggregate, no second pass for the flag."""
    totals = channel_daily.groupBy(key).agg(
        whole_sum("attributed_sessions").alias("attributed_sessions"),
        whole_sum("attributed_orders").alias("attributed_orders"),
        money_sum("attributed_revenue").alias(f"{prefix}_revenue"),
        money_sum("spend").alias("spend"),
        F.max("promo_flag").alias("has_promo"),
    )
    return with_kpis(
        totals,
        {
            "sessions": "attributed_sessions",
            "orders": "attributed_orders",
            "revenue": f"{prefix}_revenue",
            "spend": "spend",
        },
        {"cvr": f"{prefix}_cvr", "roas": f"{prefix}_roas"},
    )


def daily_trends(channel_daily: DataFrame) -> DataFrame:
    return _trend(channel_daily, "date", "daily")


def weekly_trends(channel_daily: DataFrame) -> DataFrame:
    return _trend(channel_daily, "week_index", "weekly")


def promo_periods(trend: DataFrame, key: str) -> DataFrame:
    """Keys of the days or weeks with a promotion."""
    return trend.where(F.col("has_promo") == 1).select(key)


def rolling_roas(channel_daily: DataFrame, days: int = 7) -> DataFrame:
    """Per channel and day of the calendar the spend, revenue and ROAS of the last ``days`` days, the ROAS of as many days
    before them, and the change between the two (null without spend in either).

    Days without rows are filled in as zeros between the first and the last date of all channels, so a frame of rows is a
    frame of days. The calendar has a row per day and channel, and each channel is one window of that many rows.
    """
    rows = channel_daily.where(F.col("date").isNotNull() & F.col("channel").isNotNull())
    totals = rows.groupBy("date", "channel").agg(money_sum("spend").alias("spend"), money_sum("attributed_revenue").alias("revenue"))
    days_of_history = F.sequence(rows.agg(F.min("date")).scalar(), rows.agg(F.max("date")).scalar())
    calendar = rows.select("channel").distinct().withColumn("date", F.explode(days_of_history))
    own = Window.partitionBy("channel").orderBy("date")
    now, before = own.rowsBetween(1 - days, 0), own.rowsBetween(1 - 2 * days, -days)
    filled = calendar.join(totals, ["date", "channel"], "left").fillna(0, ["spend", "revenue"])
    sums = filled.select(
        "date",
        "channel",
        *[F.sum(c).over(now).cast("decimal(28,4)").alias(f"{c}_sum") for c in ("spend", "revenue")],
        *[F.sum(c).over(before).cast("decimal(28,4)").alias(f"{c}_before") for c in ("spend", "revenue")],
    )
    return sums.select(
        "date",
        "channel",
        "spend_sum",
        "revenue_sum",
        ratio("revenue_sum", "spend_sum", None).alias("rolling_roas"),
        ratio("revenue_before", "spend_before", None).alias("previous_roas"),
    ).withColumn("roas_change", F.col("rolling_roas") - F.col("previous_roas"))
