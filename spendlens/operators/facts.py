"""The three curated facts: session x order, date x campaign, date x channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.columns import money_sum, whole_sum
from spendlens.functions.kpis import with_kpis
from spendlens.config import LayoutConfig
from spendlens.operators.joins import left_lookup, unique_lookup
from spendlens.schemas import FACT_CAMPAIGN_DAILY, FACT_CHANNEL_DAILY, FACT_SESSIONS

# The columns of an order that the session fact has.
ORDER_COLUMNS = (
    "session_id", "order_id", "order_ts", "gross_amount", "discount_amount",
    "net_amount", "net_amount_capped", "is_revenue_outlier",
)
AMOUNTS = ("gross_amount", "discount_amount", "net_amount", "net_amount_capped")


def attach_orders(sessions: DataFrame, orders: DataFrame, piece_size: int = LayoutConfig.orders_per_piece) -> DataFrame:
    """sessions LEFT JOIN orders USING (session_id): one row per order, or one row without an order.

    Sessions are unique and already partitioned by session id, so the join moves the orders only. A session id shared
    by very many orders would land on one task, though, and a left join cannot be split on its right side. Crowded
    sessions (a count combined on the map side) are therefore joined apart, their orders in pieces. It is one plan
    whatever the data: without crowded sessions adaptive execution finds that side empty and drops it. ``orders`` is
    read more than once, so hand over a stored table.
    """
    crowded = (
        orders.where(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.ceil(F.count(F.lit(1)) / piece_size).cast("int").alias("pieces"))
        .where("pieces > 1")
    )
    calm = sessions.join(crowded, "session_id", "left_anti").join(
        orders.join(crowded, "session_id", "left_anti"), "session_id", "left"
    )
    copies = sessions.join(crowded, "session_id").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    )
    pieced = orders.join(crowded, "session_id").withColumn(
        "piece", F.pmod(F.xxhash64("order_id"), F.col("pieces")).cast("int")
    )
    busy = pieced.drop("pieces").join(copies.drop("pieces"), ["session_id", "piece"]).drop("piece")
    return calm.unionByName(busy)


def build_fact_sessions(tables: dict[str, DataFrame], user_columns: tuple[str, ...] = ()) -> DataFrame:
    """Session x order with last-touch channel and campaign, and whether the user signed up that day.

    ``user_columns`` are carried along from the users, which saves a second join of sessions and users later.
    """
    sessions = tables["sessions"].select("session_id", "user_id", "session_ts", "device", "channel", "campaign_id")
    orders = tables["orders"].select(*ORDER_COLUMNS)
    rows = attach_orders(sessions, orders).withColumns(
        {
            "purchase_flag": F.col("order_id").isNotNull().cast("int"),
            "is_revenue_outlier": F.coalesce("is_revenue_outlier", F.lit(False)),
            "session_to_order_sec": F.expr("timestampdiff(MICROSECOND, session_ts, order_ts) / 1e6D"),
            "session_date": F.to_date("session_ts"),
            **{c: F.coalesce(F.col(c), F.lit(0).cast("decimal(18,4)")) for c in AMOUNTS},
        }
    )
    signups = unique_lookup(tables["users"], ["user_id"], ["signup_date", *user_columns])
    return (
        left_lookup(rows, signups, ["user_id"], spread_by=["session_id"])
        .withColumn("is_new_user", F.coalesce(F.col("session_date") == F.col("signup_date"), F.lit(False)))
        .select(*FACT_SESSIONS.fieldNames(), *user_columns)
    )


def sessions_by_campaign_day(fact_sessions: DataFrame, count_rows: bool = True) -> DataFrame:
    """Sessions, orders and revenue per date and campaign; rows without a campaign are left out.

    ``count_rows`` counts a session once per order, as the fact has it; False counts distinct sessions.
    """
    sessions = F.count("session_id") if count_rows else F.count_distinct("session_id")
    return (
        fact_sessions.where(F.col("session_date").isNotNull() & F.col("campaign_id").isNotNull())
        .groupBy(F.col("session_date").alias("date"), "campaign_id")
        .agg(
            sessions.alias("attributed_sessions"),
            whole_sum("purchase_flag").alias("attributed_orders"),
            money_sum("net_amount_capped").alias("attributed_revenue"),
        )
    )


def build_fact_campaign_daily(
    tables: dict[str, DataFrame], fact_sessions: DataFrame, count_rows: bool = True
) -> DataFrame:
    """Ad spend FULL JOIN session outcomes per date and campaign, with KPIs."""
    spend = tables["ad_spend"].select("date", "campaign_id", "channel", "spend", "impressions", "clicks")
    home_channel = tables["campaigns"].groupBy("campaign_id").agg(F.min("channel").alias("home_channel"))
    measures = ["spend", "impressions", "clicks", "attributed_sessions", "attributed_orders", "attributed_revenue"]
    joined = (
        spend.join(sessions_by_campaign_day(fact_sessions, count_rows), ["date", "campaign_id"], "full")
        .fillna(0, measures)
        .join(home_channel, "campaign_id", "left")
        .withColumn("channel", F.coalesce("channel", "home_channel"))
    )
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
        {"cpc": "cpc", "ctr": "ctr", "cvr": "cvr", "roas": "roas", "cac": "cac_proxy"},
        cac_default=None,
    ).select(*FACT_CAMPAIGN_DAILY.fieldNames())


def promo_by_channel_day(ad_spend: DataFrame) -> DataFrame:
    return (
        ad_spend.where(F.col("date").isNotNull() & F.col("channel").isNotNull())
        .groupBy("date", "channel")
        .agg(F.max("promo_flag").alias("promo_flag"))
    )


def week_index(date: str, first_date: Column) -> Column:
    """Whole weeks since the first date."""
    return F.floor(F.datediff(F.col(date), first_date) / 7).cast("int")


def build_fact_channel_daily(tables: dict[str, DataFrame], fact_campaign_daily: DataFrame) -> DataFrame:
    """Rollup to date x channel with weekday, promo flag and week index; rows without a channel are left out.

    ``fact_campaign_daily`` is read twice (rollup and first date), so hand over a stored table.
    """
    rows = fact_campaign_daily.where(F.col("date").isNotNull() & F.col("channel").isNotNull())
    first_date = rows.agg(F.min("date")).scalar()
    return (
        rows.groupBy("date", "channel")
        .agg(
            money_sum("spend").alias("total_spend"),
            whole_sum("impressions").alias("total_impressions"),
            whole_sum("clicks").alias("total_clicks"),
            whole_sum("attributed_sessions").alias("attributed_sessions"),
            whole_sum("attributed_orders").alias("attributed_orders"),
            money_sum("attributed_revenue").alias("attributed_revenue"),
        )
        .join(promo_by_channel_day(tables["ad_spend"]), ["date", "channel"], "left")
        .withColumns(
            {
                "day_of_week": F.weekday("date"),
                "promo_flag": F.coalesce("promo_flag", F.lit(0)).cast("int"),
                "week_index": week_index("date", first_date),
            }
        )
        .select(*FACT_CHANNEL_DAILY.fieldNames())
    )
