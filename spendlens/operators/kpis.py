"""Channel and campaign performance over the facts: ROAS, daily tables, top campaign-days, wasted spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.columns import money_sum, whole_sum
from spendlens.functions.kpis import with_kpis
from spendlens.operators.facts import week_index

CAMPAIGN_DAY_KEY = ("date", "campaign_id")


def channel_roas(channel_daily: DataFrame, spend_column: str = "spend") -> DataFrame:
    """Revenue, spend and ROAS per channel (ratio of sums)."""
    totals = (
        channel_daily.where(F.col("channel").isNotNull())
        .groupBy("channel")
        .agg(money_sum("attributed_revenue").alias("attributed_revenue"), money_sum(spend_column).alias("spend"))
    )
    return with_kpis(totals, {"revenue": "attributed_revenue", "spend": "spend"}, {"roas": "ROAS"})


def campaign_daily(fact_sessions: DataFrame, ad_spend: DataFrame, revenue_column: str = "gross_amount") -> DataFrame:
    """Session outcomes per date, campaign and session channel, LEFT JOIN ad spend; the ad-spend channel is reported.

    Unlike the campaign fact, days with spend but no session are absent, and CAC is 0 without orders.
    """
    outcomes = (
        fact_sessions.where(
            F.col("session_date").isNotNull() & F.col("campaign_id").isNotNull() & F.col("channel").isNotNull()
        )
        .groupBy(F.col("session_date").alias("date"), "campaign_id", "channel")
        .agg(
            F.count("session_id").alias("attributed_sessions"),
            whole_sum("purchase_flag").alias("attributed_orders"),
            money_sum(revenue_column).alias("attributed_revenue"),
        )
        .drop("channel")
    )
    spend = ad_spend.select("date", "campaign_id", "channel", "spend", "impressions", "clicks")
    joined = outcomes.join(spend, list(CAMPAIGN_DAY_KEY), "left").fillna(0, ["spend", "impressions", "clicks"])
    return with_kpis(
        joined,
        {
            "spend": "spend",
            "clicks": "clicks",
            "impressions": "impressions",
            "sessions": "attributed_sessions",
            "orders": "attributed_orders",
            "revenue": "attributed_revenue",
        },
        {"cpc": "CPC", "ctr": "CTR", "cvr": "CVR", "roas": "ROAS", "cac": "CAC"},
    ).select(
        "date", "campaign_id", "channel", "spend", "impressions", "clicks",
        "attributed_sessions", "attributed_orders", "attributed_revenue", "CPC", "CTR", "CVR", "ROAS", "CAC",
    )


def ad_spend_rollup(ad_spend: DataFrame) -> DataFrame:
    """Spend, impressions, clicks and promo flag per date and channel."""
    return (
        ad_spend.where(F.col("date").isNotNull() & F.col("channel").isNotNull())
        .groupBy("date", "channel")
        .agg(
            money_sum("spend").alias("spend"),
            whole_sum("impressions").alias("impressions"),
            whole_sum("clicks").alias("clicks"),
            F.max("promo_flag").alias("promo_flag"),
        )
    )


def attribution_rollup(campaigns: DataFrame) -> DataFrame:
    """Attributed sessions, orders and revenue per date and channel."""
    return (
        campaigns.where(F.col("channel").isNotNull())
        .groupBy("date", "channel")
        .agg(
            whole_sum("attributed_sessions").alias("attributed_sessions"),
            whole_sum("attributed_orders").alias("attributed_orders"),
            money_sum("attributed_revenue").alias("attributed_revenue"),
        )
    )


def channel_daily(campaigns: DataFrame, ad_spend: DataFrame) -> DataFrame:
    """Date x channel from the spend side: a channel-day without ad spend is absent, unlike in the channel fact."""
    spend = ad_spend_rollup(ad_spend)
    # The first spend day comes from the ad-spend table alone, which is small next to the sessions.
    first_date = ad_spend.where(F.col("channel").isNotNull()).agg(F.min("date")).scalar()
    return (
        spend.join(attribution_rollup(campaigns), ["date", "channel"], "left")
        .fillna(0, ["attributed_sessions", "attributed_orders", "attributed_revenue"])
        .withColumns(
            {
                "day_of_week": F.weekday("date"),
                "promo_flag": F.coalesce("promo_flag", F.lit(0)).cast("int"),
                "week_index": week_index("date", first_date),
            }
        )
        .select(
            "date", "channel", "spend", "impressions", "clicks", "attributed_sessions", "attributed_orders",
            "attributed_revenue", "day_of_week", "promo_flag", "week_index",
        )
    )


def top_campaign_days(campaigns: DataFrame, measure: str, n: int = 5) -> DataFrame:
    """The n campaign-days with the highest measure; ties go to the earlier date, then the lower campaign id."""
    order = [F.desc_nulls_last(measure), "date", "campaign_id", "channel"]
    return campaigns.select("date", "campaign_id", "channel", measure).orderBy(*order).limit(n)


def campaign_averages(campaigns: DataFrame) -> DataFrame:
    """Unweighted mean of row ROAS and of row spend."""
    return campaigns.agg(F.avg("ROAS").alias("avg_roas"), F.avg(F.col("spend").cast("double")).alias("avg_spend"))


def wasted_spend(campaigns: DataFrame) -> DataFrame:
    """Campaign-days that spend more than the mean and return less than the mean.

    ``campaigns`` is read twice (means and rows), so hand over a stored table. Sorting is left to the sink.
    """
    means = campaign_averages(campaigns)
    return campaigns.where(
        (F.col("spend").cast("double") > means.select("avg_spend").scalar())
        & (F.col("ROAS") < means.select("avg_roas").scalar())
    ).select("date", "campaign_id", "channel", "spend", "attributed_revenue", "ROAS")
