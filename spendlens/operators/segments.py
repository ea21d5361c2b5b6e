"""Spend per session and segment comparisons: channel x device, new users, city tier, product category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.columns import money, money_sum, ratio, whole_sum
from spendlens.functions.kpis import with_kpis
from spendlens.operators.joins import left_lookup, unique_lookup

SPEND_KEY = ("date", "campaign_id", "channel")


def spend_per_session(fact_sessions: DataFrame, ad_spend: DataFrame) -> DataFrame:
    """Ad spend with the number of sessions it bought and the spend per session (0 without sessions)."""
    counts = (
        fact_sessions.withColumnRenamed("session_date", "date")
        .where(F.col("campaign_id").isNotNull() & F.col("channel").isNotNull())
        .groupBy(*SPEND_KEY)
        .agg(F.count("session_id").alias("total_sessions_in_group"))
    )
    return (
        ad_spend.select(*SPEND_KEY, "spend")
        .join(counts, list(SPEND_KEY), "left")
        .fillna(0, ["total_sessions_in_group"])
        .withColumn("spend_per_session", ratio("spend", "total_sessions_in_group"))
    )


def sessions_with_spend(fact_sessions: DataFrame, ad_spend: DataFrame) -> DataFrame:
    """Each session row with its share of the ad spend.

    ``fact_sessions`` is read twice (counts and rows), so hand over a stored table.
    """
    share = spend_per_session(fact_sessions, ad_spend).select(*SPEND_KEY, "spend_per_session")
    rows = fact_sessions.withColumnRenamed("session_date", "date")
    return left_lookup(rows, share, list(SPEND_KEY), spread_by=["session_id"]).fillna(0.0, ["spend_per_session"])


def with_city_tier(fact_sessions: DataFrame, users: DataFrame) -> DataFrame:
    """The user's city tier per session row, unless the rows carry it already."""
    if "city_tier" in fact_sessions.columns:
        return fact_sessions
    tiers = unique_lookup(users, ["user_id"], ["city_tier"])
    return left_lookup(fact_sessions, tiers, ["user_id"], spread_by=["session_id"])


def segment_cells(
    fact_sessions: DataFrame,
    ad_spend: DataFrame,
    attributes: list[str],
    revenue_column: str = "gross_amount",
) -> DataFrame:
    """Outcomes and allotted spend per (date, campaign, channel, attributes).

    Sessions are combined into cells before anything is joined, so spend reaches a handful of cells per campaign-day
    and never single sessions; every segment table is a rollup of the cells.
    """
    cells = (
        fact_sessions.withColumnRenamed("session_date", "date")
        .groupBy(*SPEND_KEY, *attributes)
        .agg(
            F.count("session_id").alias("sessions"),
            whole_sum("purchase_flag").alias("orders"),
            money_sum(revenue_column).alias("revenue"),
        )
    )
    # One window partition holds the cells of one campaign-day and channel: attribute combinations, not sessions. That
    # is as true of cells without campaign or channel, which match no ad spend and get none.
    return (
        cells.withColumn("group_sessions", F.sum("sessions").over(Window.partitionBy(*SPEND_KEY)))
        .join(ad_spend.select(*SPEND_KEY, F.col("spend").alias("group_spend")), list(SPEND_KEY), "left")
        .withColumn(
            "spend", F.coalesce(F.col("sessions") * ratio("group_spend", "group_sessions"), F.lit(0.0))
        )
        .drop("group_sessions", "group_spend")
    )


def _segment(cells: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    names = {m: f"{prefix}_{m}" for m in ("sessions", "orders", "revenue", "spend")}
    present = cells.dropna(subset=keys)
    totals = present.groupBy(*keys).agg(
        whole_sum("sessions").alias(names["sessions"]),
        whole_sum("orders").alias(names["orders"]),
        money_sum("revenue").alias(names["revenue"]),
        F.sum("spend").alias(names["spend"]),
    )
    return with_kpis(totals, names, {"cvr": "CVR", "roas": "ROAS"})


def segment_channel_device(cells: DataFrame) -> DataFrame:
    return _segment(cells, ["channel", "device"], "attributed")


def segment_new_user(cells: DataFrame) -> DataFrame:
    return _segment(cells, ["is_new_user"], "total")


def segment_city_tier(cells: DataFrame) -> DataFrame:
    return _segment(cells, ["city_tier"], "attributed")


def segment_metrics(cells: DataFrame) -> DataFrame:
    """The three segmentations in one pass (grouping sets): segment_kind, segment, member, CVR, ROAS."""
    keys = ["channel", "device", "is_new_user", "city_tier"]
    sets = [[F.col("channel"), F.col("device")], [F.col("is_new_user")], [F.col("city_tier")]]
    totals = cells.groupingSets(sets, *keys).agg(
        F.grouping("channel").alias("no_channel"),
        F.grouping("is_new_user").alias("no_user"),
        whole_sum("sessions").alias("sessions"),
        whole_sum("orders").alias("orders"),
        money_sum("revenue").alias("revenue"),
        F.sum("spend").alias("spend"),
    )
    by_channel, by_user = F.col("no_channel") == 0, F.col("no_user") == 0
    named = totals.select(
        F.when(by_channel, "channel").when(by_user, "user").otherwise("city").alias("segment_kind"),
        F.when(by_channel, F.col("channel"))
        .when(by_user, F.lit("New vs Returning Users"))
        .otherwise(F.lit("City Tier"))
        .alias("segment"),
        F.when(by_channel, F.col("device"))
        .when(by_user, F.when(F.col("is_new_user"), "new").otherwise("returning"))
        .otherwise(F.col("city_tier").cast("string"))
        .alias("member"),
        "sessions", "orders", "revenue", "spend",
    ).dropna(subset=["segment", "member"])
    measures = {m: m for m in ("sessions", "orders", "revenue", "spend")}
    return with_kpis(named, measures, {"cvr": "CVR", "roas": "ROAS"})


def enrich_order_items(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines with revenue, cost and margin; lines of unknown products drop out, repeated products count once."""
    priced = unique_lookup(
        products.select("product_id", "category", F.col("cost").alias("unit_cost")), ["product_id"], ["category", "unit_cost"]
    )
    return (
        order_items.join(priced, "product_id")
        .withColumns(
            {
                "revenue": money("quantity * unit_price"),
                "cost": money("quantity * unit_cost"),
            }
        )
        .withColumn("margin", F.col("revenue") - F.col("cost"))
        .select("order_id", "product_id", "category", "quantity", "revenue", "cost", "margin")
    )


def category_performance(enriched_items: DataFrame) -> DataFrame:
    return (
        enriched_items.where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(money_sum("revenue").alias("gross_revenue"), money_sum("margin").alias("margin"))
    )
