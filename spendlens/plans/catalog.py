"""Named queries over the star-schema test tables: one entry per operator group, callable as (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens import schemas
from spendlens.config import BoundsScenario, BudgetConfig, ChannelBounds, ShareScenario, TouchConfig
from spendlens.functions.columns import money_sum, parse, ratio
from spendlens.functions.tables import LazyTables
from spendlens.operators import attribution, budget, cleaning, distinct, facts, insights, kpis, regression, segments, touches, trends
from spendlens.operators.joins import left_lookup, unique_lookup
from spendlens.plans.analysis import Analysis
from spendlens.plans.budget import channel_metrics as metrics_of
from spendlens.plans.etl import OUTPUTS, Facts
from spendlens.session import materialize, scratch_path
from spendlens.sources import star
from spendlens.sources.files import optional_source, read_csv, read_curated, read_json
from spendlens.sources.profile import profile, stored_positions
from spendlens.sources.quarantine import read_checked, write_checked
from spendlens.sources.sinks import rounded, write_table
from spendlens.streaming import late

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Budgets and limits of the size the test data spends.
SHARE_SCENARIOS = (
    ShareScenario("base"),
    ShareScenario("tight_cap", 10_000_000.0, 0.05, 0.21),
    ShareScenario("wide", 12_000_000.0, 0.02, 0.60),
    ShareScenario("cap_below_budget", 10_000_000.0, 0.05, 0.15),
    ShareScenario("floor_above_budget", 10_000_000.0, 0.25, 0.45),
)


CAMPAIGN_SCENARIOS = (ShareScenario("many", 1_000_000.0, 0.005, 0.04), ShareScenario("loose", 1_000_000.0, 0.0, 0.1))


def _scaled_bounds(factor: float) -> tuple[ChannelBounds, ...]:
    return tuple(replace(b, max_spend=b.max_spend * factor) for b in BoundsScenario().bounds)


def _all_weights(factor: float) -> tuple[tuple[str, float], ...]:
    return tuple((b.channel, factor) for b in BoundsScenario().bounds if b.channel in ("email", "search"))


BOUNDS_SCENARIOS = (
    BoundsScenario("base"),
    BoundsScenario("small_budget", 20_000_000.0),
    BoundsScenario("infeasible", 12_000_000.0),
    BoundsScenario("caps_plus_20", 40_000_000.0, _scaled_bounds(1.2)),
    BoundsScenario("weights_minus_20", 20_000_000.0, weight_factor=_all_weights(0.8)),
    BoundsScenario("weights_plus_20", 20_000_000.0, weight_factor=_all_weights(1.2)),
)


# What the channel metrics need of the session fact.
METRIC_COLUMNS = (
    "session_id", "session_ts", "session_date", "channel", "campaign_id", "order_id", "purchase_flag",
    "net_amount_capped",
)


class Inputs:
    """Cleaned tables and facts of one data set, built on first use and only as far as a query needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.raw = star.raw_tables(spark, sf_dir)

    @cached_property
    def sessions(self) -> DataFrame:
        return cleaning.clean_sessions(self.raw["sessions"])

    @cached_property
    def orders(self) -> DataFrame:
        return cleaning.clean_orders(self.raw["orders"])

    @cached_property
    def ad_spend(self) -> DataFrame:
        """Stored: most queries read it in more than one place."""
        return materialize(cleaning.clean_ad_spend(self.raw["ad_spend"]), "ad-spend")

    @cached_property
    def tables(self) -> LazyTables:
        raw = {name: lambda name=name: self.raw[name] for name in star.READERS}
        cleaned = {
            "sessions": lambda: self.sessions,
            "orders": lambda: self.orders,
            "ad_spend": lambda: self.ad_spend,
            "campaigns": lambda: cleaning.normalize_channel(self.raw["campaigns"]),
        }
        return LazyTables({**raw, **cleaned})

    @cached_property
    def fact_sessions(self) -> DataFrame:
        return facts.build_fact_sessions(self.tables)

    @cached_property
    def stored_sessions(self) -> DataFrame:
        return materialize(self.fact_sessions, "fact-sessions")

    @cached_property
    def fact_campaign_daily(self) -> DataFrame:
        return facts.build_fact_campaign_daily(self.tables, self.fact_sessions)

    @cached_property
    def fact_channel_daily(self) -> DataFrame:
        campaigns = materialize(self.fact_campaign_daily, "fact-campaign-daily")
        return facts.build_fact_channel_daily(self.tables, campaigns)

    @cached_property
    def analysis(self) -> Analysis:
        """For tables that read the session fact once."""
        return Analysis(self.fact_sessions, self.ad_spend, self.raw["users"])

    @cached_property
    def tier_analysis(self) -> Analysis:
        """For segment tables that also need the user's city tier."""
        sessions = facts.build_fact_sessions(self.tables, ("city_tier",))
        return Analysis(sessions, self.ad_spend, self.raw["users"])

    @cached_property
    def stored_analysis(self) -> Analysis:
        """For tables that read the session fact more than once."""
        return Analysis(self.stored_sessions, self.ad_spend, self.raw["users"])

    @cached_property
    def stored_facts(self) -> Facts:
        """The facts as far as the channel metrics read them; without the week index the campaign fact has one reader."""
        sessions = materialize(self.fact_sessions.select(*METRIC_COLUMNS), "fact-sessions")
        campaigns = facts.build_fact_campaign_daily(self.tables, sessions)
        channels = materialize(
            facts.build_fact_channel_daily(self.tables, campaigns).drop("week_index"), "fact-channel-daily"
        )
        return Facts(sessions, campaigns, channels)

    def metrics(self, config: BudgetConfig = BudgetConfig()) -> DataFrame:
        return metrics_of(self.stored_facts, self.raw["order_items"], self.raw["products"], config)

    @cached_property
    def share_allocation(self) -> DataFrame:
        return budget.allocate_by_share(materialize(self.metrics(), "metrics"), SHARE_SCENARIOS)

    @cached_property
    def bounds_allocation(self) -> DataFrame:
        weights = self.analysis.fit.table(self.spark).select(
            F.regexp_replace("feature", "^spend_", "").alias("channel"),
            F.col("coefficient").alias("regression_coefficient"),
        )
        return budget.allocate_by_bounds(weights, BOUNDS_SCENARIOS)


# Ratios are compared to ten digits: with fewer, quotients such as cents / 32 end exactly halfway and engines round
# them differently. Amounts far above a million are compared to the cent or the unit, within double precision.
RATIOS = {
    "cpc", "ctr", "cvr", "roas", "cac_proxy", "CPC", "CTR", "CVR", "ROAS", "CAC", "daily_cvr", "daily_roas",
    "weekly_cvr", "weekly_roas", "avg_roas", "avg_spend", "spend_per_session", "max_value", "min_value", "spread",
    "attributed_ROAS", "simple_ROAS", "last_touch_ROAS", "roas_difference", "allocated_pct",
    "rolling_roas", "previous_roas", "roas_change",
}


def presented(df: DataFrame, amount_digits: int = 4) -> DataFrame:
    """Amounts and ratios as rounded doubles, for comparison across engines."""
    fractions = (T.DoubleType, T.DecimalType)
    return df.selectExpr(
        *[
            f"round(CAST({f.name} AS DOUBLE), {10 if f.name in RATIOS else amount_digits}) AS {f.name}"
            if isinstance(f.dataType, fractions)
            else f.name
            for f in df.schema.fields
        ]
    )


def query(build: Callable[[Inputs], DataFrame] | None = None, *, amount_digits: int = 4):
    """Register a query under its function name."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presented(build(Inputs(spark, sf_dir)), amount_digits)

        QUERIES[build.__name__] = run
        return build

    return register(build) if build else register


# --- Cleaning -------------------------------------------------------------------------------------------------------


@query
def dedup_sessions(i: Inputs) -> DataFrame:
    return i.sessions.drop("ingest_seq")


@query
def clean_ad_spend(i: Inputs) -> DataFrame:
    return i.ad_spend.drop("ingest_seq")


@query
def order_outliers(i: Inputs) -> DataFrame:
    return i.orders.drop("ingest_seq", "user_id")


@query
def dq_report(i: Inputs) -> DataFrame:
    return cleaning.dq_report(i.raw, i.tables)


@query
def parse_dates(i: Inputs) -> DataFrame:
    """Text timestamps, every 37th malformed: strict parsing of the good ones, coercing parsing of all."""
    text = F.date_format("session_ts", "yyyy-MM-dd HH:mm:ss")
    rows = i.raw["sessions"].select(
        F.to_date("session_ts").alias("day"),
        text.alias("good"),
        F.when(F.col("session_id") % 37 == 0, F.lit("n/a on purpose")).otherwise(text).alias("mixed"),
    )
    return (
        rows.select(
            "day",
            parse("good", "timestamp_ntz").alias("strict"),
            parse("mixed", "timestamp_ntz", strict=False).alias("coerced"),
        )
        .groupBy("day")
        .agg(
            F.count("strict").alias("strict_parsed"),
            F.count("coerced").alias("coerced_parsed"),
            F.count_if(F.col("coerced").isNull()).alias("coerced_to_null"),
            F.max("coerced").alias("last_parsed"),
        )
    )


# --- Facts ----------------------------------------------------------------------------------------------------------


@query
def fact_sessions(i: Inputs) -> DataFrame:
    return i.fact_sessions


@query
def fact_campaign_daily(i: Inputs) -> DataFrame:
    return i.fact_campaign_daily


@query
def fact_campaign_daily_distinct(i: Inputs) -> DataFrame:
    """Distinct sessions instead of session x order rows."""
    return facts.build_fact_campaign_daily(i.tables, i.fact_sessions, count_rows=False)


@query
def fact_channel_daily(i: Inputs) -> DataFrame:
    return i.fact_channel_daily


@query
def channel_amounts_exact(i: Inputs) -> DataFrame:
    """Amounts of the channel fact as exact text, so that not a hundredth of a cent may differ."""
    amounts = ("total_spend", "attributed_revenue")
    return i.fact_channel_daily.select("date", "channel", *[F.col(c).cast("decimal(18,4)").cast("string").alias(c) for c in amounts])


# --- KPIs and trends ------------------------------------------------------------------------------------------------


@query
def channel_roas(i: Inputs) -> DataFrame:
    channel_daily = facts.build_fact_channel_daily(i.tables, i.fact_campaign_daily)
    return kpis.channel_roas(channel_daily, "total_spend")


@query
def campaign_daily(i: Inputs) -> DataFrame:
    return i.analysis.campaign_daily


@query
def ad_spend_rollup(i: Inputs) -> DataFrame:
    return kpis.ad_spend_rollup(i.ad_spend)


@query
def attribution_rollup(i: Inputs) -> DataFrame:
    return kpis.attribution_rollup(i.analysis.campaign_daily)


@query
def channel_daily_variant(i: Inputs) -> DataFrame:
    return i.analysis.channel_daily


@query
def top_campaigns_spend(i: Inputs) -> DataFrame:
    return kpis.top_campaign_days(i.analysis.campaign_daily, "spend")


@query
def top_campaigns_revenue(i: Inputs) -> DataFrame:
    return kpis.top_campaign_days(i.analysis.campaign_daily, "attributed_revenue")


@query
def campaign_averages(i: Inputs) -> DataFrame:
    return kpis.campaign_averages(i.analysis.campaign_daily)


@query
def wasted_spend(i: Inputs) -> DataFrame:
    return i.analysis.wasted


@query
def daily_trends(i: Inputs) -> DataFrame:
    return trends.daily_trends(i.analysis.channel_daily)


@query
def weekly_trends(i: Inputs) -> DataFrame:
    return trends.weekly_trends(i.analysis.channel_daily)


@query
def promo_days(i: Inputs) -> DataFrame:
    return trends.promo_periods(trends.daily_trends(i.analysis.channel_daily), "date")


@query
def promo_weeks(i: Inputs) -> DataFrame:
    return trends.promo_periods(trends.weekly_trends(i.analysis.channel_daily), "week_index")


@query
def rolling_roas(i: Inputs) -> DataFrame:
    """Seven-day ROAS and its change over the seven days before; every fifth day is missing."""
    return trends.rolling_roas(i.analysis.channel_daily.where(F.day("date") % 5 != 0))


# --- Segments -------------------------------------------------------------------------------------------------------


@query
def spend_per_session(i: Inputs) -> DataFrame:
    return segments.spend_per_session(i.fact_sessions, i.ad_spend)


@query
def sessions_with_spend(i: Inputs) -> DataFrame:
    rows = segments.sessions_with_spend(i.stored_sessions, i.ad_spend)
    return rows.select("session_id", "order_id", "date", "campaign_id", "channel", "spend_per_session")


@query
def seg_channel_device(i: Inputs) -> DataFrame:
    return i.analysis.channel_device


@query
def seg_new_user(i: Inputs) -> DataFrame:
    return segments.segment_new_user(i.analysis.cells(["is_new_user"]))


@query
def seg_city_tier(i: Inputs) -> DataFrame:
    return segments.segment_city_tier(i.tier_analysis.cells(["city_tier"]))


@query
def category_performance(i: Inputs) -> DataFrame:
    return segments.category_performance(segments.enrich_order_items(i.raw["order_items"], i.raw["products"]))


@query
def segment_spreads(i: Inputs) -> DataFrame:
    return i.tier_analysis.spreads.select("metric", "segment_kind", "segment", "max_value", "min_value", "spread")


@query
def top_segments(i: Inputs) -> DataFrame:
    return insights.top_segments(i.tier_analysis.spreads).select(
        "metric", "rank", "segment_kind", "segment", "spread", "best_member", "worst_member"
    )


@query
def segment_findings(i: Inputs) -> DataFrame:
    return insights.segment_findings(insights.top_segments(i.tier_analysis.spreads))


@query
def inefficiencies(i: Inputs) -> DataFrame:
    a = i.stored_analysis
    return insights.inefficiency_lines(insights.inefficiencies(a.wasted, a.channel_device))


# --- Attribution and regression -------------------------------------------------------------------------------------


@query
def last_touch(i: Inputs) -> DataFrame:
    return attribution.last_touch(i.fact_sessions)


@query
def attributed_roas(i: Inputs) -> DataFrame:
    return i.analysis.attributed_roas


@query
def roas_comparison(i: Inputs) -> DataFrame:
    a = i.stored_analysis
    return attribution.roas_comparison(kpis.channel_roas(a.channel_daily), a.attributed_roas)


@query
def preceding_session(i: Inputs) -> DataFrame:
    """The last session of the user before each order."""
    return touches.preceding_sessions(i.stored_sessions)


@query
def preceding_touch(i: Inputs) -> DataFrame:
    return touches.preceding_touch(touches.preceding_sessions(i.stored_sessions))


# A lookback shorter than the test history.
TOUCHES = TouchConfig(lookback_days=9, half_life_days=3.0)


@query
def multi_touch_credits(i: Inputs) -> DataFrame:
    """Linear and time-decay credit of each order by channel."""
    return touches.multi_touch_credits(i.stored_sessions, TOUCHES)


@query
def multi_touch(i: Inputs) -> DataFrame:
    return touches.multi_touch(touches.multi_touch_credits(i.stored_sessions, TOUCHES))


@query
def daily_regression(i: Inputs) -> DataFrame:
    return regression.with_split(regression.regression_table(i.analysis.channel_daily))


@query
def weekly_regression(i: Inputs) -> DataFrame:
    """The regression table with weeks for days."""
    return regression.regression_table(i.analysis.channel_daily, "week_index").drop("day_of_week")


def _weekly(i: Inputs) -> tuple[DataFrame, regression.OlsFit]:
    table = regression.with_split(regression.regression_table(i.analysis.channel_daily, "week_index"), key="week_index")
    table = materialize(table, "weeks")
    return table, regression.fit_ols(table.where("not is_test"))


@query
def weekly_metrics(i: Inputs) -> DataFrame:
    """Scores of the fit at week grain, every fifth week a test week."""
    return regression.regression_metrics(*_weekly(i))


@query
def weekly_coefficients(i: Inputs) -> DataFrame:
    return _weekly(i)[1].table(i.spark)


@query
def regression_metrics(i: Inputs) -> DataFrame:
    return regression.regression_metrics(i.analysis.regression_table, i.analysis.fit)


@query
def regression_coefficients(i: Inputs) -> DataFrame:
    """With the rank the report is sorted by: eight features, so one window over all of them."""
    by_weight = Window.orderBy(F.desc(F.round("absolute_coefficient", 6)), "feature")
    return i.analysis.fit.table(i.spark).withColumn("rank", F.row_number().over(by_weight))


@query
def coefficient_intervals(i: Inputs) -> DataFrame:
    """Bootstrap intervals of the regression coefficients."""
    a = i.analysis
    resampled = regression.bootstrap_coefficients(a.regression_table.where("not is_test"), replicates=100)
    return regression.coefficient_intervals(a.fit, resampled)


@query
def daily_exact_split(i: Inputs) -> DataFrame:
    """A fifth of the days, rounded up, as test days."""
    return regression.with_exact_split(i.analysis.regression_table.drop("is_test")).select("date", "is_test")


@query
def channel_performance(i: Inputs) -> DataFrame:
    return i.stored_analysis.channel_performance


# --- Budget ---------------------------------------------------------------------------------------------------------


@query
def order_margin(i: Inputs) -> DataFrame:
    return budget.order_margin(i.raw["order_items"], i.raw["products"])


@query
def margin_by_channel(i: Inputs) -> DataFrame:
    margins = budget.order_margin(i.raw["order_items"], i.raw["products"])
    return budget.margin_by_channel(budget.order_channels(i.fact_sessions), margins)


@query
def channel_metrics_lookback(i: Inputs) -> DataFrame:
    """A lookback shorter than the test history, margin over the same days."""
    return i.metrics(BudgetConfig(lookback_days=9))


@query
def channel_metrics_all_margin(i: Inputs) -> DataFrame:
    """The same lookback with margin over the whole history."""
    return i.metrics(BudgetConfig(lookback_days=9, margin_window="all"))


@query
def channel_metrics(i: Inputs) -> DataFrame:
    """The default lookback of 90 days."""
    return i.metrics()


@query(amount_digits=2)
def allocate_share(i: Inputs) -> DataFrame:
    return i.share_allocation


@query(amount_digits=2)
def allocate_share_campaigns(i: Inputs) -> DataFrame:
    """The same rule over all campaigns, which takes many more rounds than the five channels do."""
    campaigns = (
        i.fact_campaign_daily.groupBy(F.col("campaign_id").alias("channel"))
        .agg(money_sum("spend").alias("spend"), money_sum("attributed_revenue").alias("revenue"))
        .select("channel", ratio("revenue", "spend").alias("roas"), F.lit(0.0).alias("margin_per_dollar"))
    )
    return budget.allocate_by_share(materialize(campaigns, "campaigns"), CAMPAIGN_SCENARIOS)


@query(amount_digits=2)
def allocate_share_rounds(i: Inputs) -> DataFrame:
    """The campaigns again, shared in rounds over the table, as very many would be."""
    campaigns = (
        i.fact_campaign_daily.groupBy(F.col("campaign_id").alias("channel"))
        .agg(money_sum("spend").alias("spend"), money_sum("attributed_revenue").alias("revenue"))
        .select("channel", ratio("revenue", "spend").alias("roas"), F.lit(0.0).alias("margin_per_dollar"))
    )
    return budget.allocate_by_share(materialize(campaigns, "campaigns"), CAMPAIGN_SCENARIOS, array_channels=0)


@query(amount_digits=2)
def allocate_optimal(i: Inputs) -> DataFrame:
    """The best plan inside the share limits, for all scenarios."""
    return budget.optimal_spend(budget.share_limits(i.metrics(), SHARE_SCENARIOS))


@query(amount_digits=2)
def optimal_gap(i: Inputs) -> DataFrame:
    """What the proportional rule loses against the best plan."""
    best = budget.optimal_spend(budget.share_limits(materialize(i.metrics(), "metrics"), SHARE_SCENARIOS))
    return budget.optimal_gap(best, i.share_allocation)


@query(amount_digits=2)
def allocate_optimal_bounds(i: Inputs) -> DataFrame:
    """The best plan inside absolute limits; channels without a positive coefficient keep their minimum."""
    weights = i.analysis.fit.table(i.spark).select(
        F.regexp_replace("feature", "^spend_", "").alias("channel"), F.col("coefficient").alias("regression_coefficient")
    )
    return budget.optimal_spend(budget.bounds_limits(weights, BOUNDS_SCENARIOS), whole_budget=False)


@query(amount_digits=2)
def impact(i: Inputs) -> DataFrame:
    return budget.impact_estimates(i.share_allocation)


@query(amount_digits=2)
def impact_totals(i: Inputs) -> DataFrame:
    return budget.impact_totals(budget.impact_estimates(i.share_allocation))


@query(amount_digits=2)
def sensitivity(i: Inputs) -> DataFrame:
    return budget.sensitivity(i.share_allocation)


@query
def allocate_bounds(i: Inputs) -> DataFrame:
    return i.bounds_allocation


@query
def allocation_totals(i: Inputs) -> DataFrame:
    return budget.allocation_totals(i.bounds_allocation)


@query(amount_digits=0)
def revenue_impact(i: Inputs) -> DataFrame:
    a = i.analysis
    return budget.revenue_impact(a.regression_table, a.fit, i.bounds_allocation)


@query(amount_digits=0)
def revenue_impact_full_history(i: Inputs) -> DataFrame:
    """The plan spread over all days of the history."""
    a = i.analysis
    config = BudgetConfig(horizon_days=None)
    return budget.revenue_impact(a.regression_table, a.fit, i.bounds_allocation, config, parity=True)


# --- Distinct counts that roll up ---------------------------------------------------------------------------------------


@query
def distinct_rollups(i: Inputs) -> DataFrame:
    """Distinct sessions, users and buyers per channel, per week and in all, from one table of stored bitmaps."""
    bitmaps = materialize(distinct.session_bitmaps(i.fact_sessions, i.tables["campaigns"]), "bitmaps")
    week = F.date_trunc("week", "date").cast("date")
    grains = {"channel": {"channel": F.col("channel")}, "week": {"week": week}, "total": {}}
    parts = [distinct.distinct_counts(bitmaps, keys).withColumn("grain", F.lit(g)) for g, keys in grains.items()]
    by_channel, by_week, total = parts
    return by_channel.unionByName(by_week, allowMissingColumns=True).unionByName(total, allowMissingColumns=True)


@query
def sketches_within_bounds(i: Inputs) -> DataFrame:
    """Weekly users and order-value quantiles from stored daily sketches, held against exact values of the same weeks."""
    week = F.date_trunc("week", "date").cast("date")
    sketches = materialize(distinct.daily_sketches(i.stored_sessions), "sketches")
    guessed = distinct.merged_sketches(sketches, {"week": week}).select("week", F.col("users").alias("guess"), "orders", "q50", "q90")
    rows = i.stored_sessions.select(
        F.date_trunc("week", "session_date").cast("date").alias("week"), "user_id",
        F.when(F.col("purchase_flag") == 1, F.col("gross_amount").cast("double")).alias("value"),
    )

    def rank_fits(quantile: str, share: float) -> Column:
        below, upto = (F.count_if(F.col("value") < F.col(quantile)), F.count_if(F.col("value") <= F.col(quantile)))
        n = F.count("value")
        return (below <= (share + distinct.RANK_ERROR) * n) & (upto >= (share - distinct.RANK_ERROR) * n)

    users = F.count_distinct("user_id")
    return (
        rows.join(guessed, "week")
        .groupBy("week", "orders")
        .agg(
            users.alias("users"),
            (F.abs(F.max("guess") / users - 1) <= 3 * 1.04 / 2 ** (distinct.LG_REGISTERS / 2)).alias("users_fit"),
            rank_fits("q50", 0.5).alias("q50_fits"),
            rank_fits("q90", 0.9).alias("q90_fits"),
        )
    )


# --- Late data ------------------------------------------------------------------------------------------------------


@query
def late_facts(i: Inputs) -> DataFrame:
    """The session fact after three drops of files in which rows come in any order."""
    landing, store = scratch_path(i.spark, "landing"), scratch_path(i.spark, "late")
    tables = {name: i.raw[name] for name in late.STREAMS}
    unique = cleaning.deduplicate(i.raw["orders"], ["order_id"])
    fence = cleaning.upper_fence(materialize(unique, "orders"), "net_amount", cleaning.CleaningConfig.iqr_multiplier).first()["fence"]
    config = late.LateConfig(landing, store, float(fence), reach_days=1)
    for drop in range(3):
        for name, rows in tables.items():
            mine = rows.where(F.pmod(F.xxhash64("ingest_seq"), F.lit(3)) == drop)
            mine.write.mode("append").parquet(f"{landing}/{name}")
        late.catch_up(i.spark, config, {n: t.schema for n, t in tables.items()}, i.raw["users"])
    fact = i.spark.read.schema(i.fact_sessions.schema).parquet(config.fact)
    return fact.select(i.fact_sessions.columns)


# --- Sources and sinks ----------------------------------------------------------------------------------------------


@query
def source_profile(i: Inputs) -> DataFrame:
    inputs = {name: df.drop("ingest_seq", "campaign_no") for name, df in i.raw.all().items()}
    return profile(inputs).drop("data_type")


@query
def csv_roundtrip(i: Inputs) -> DataFrame:
    """Sessions written as CSV and read back, first row per session kept by file order."""
    path = scratch_path(i.spark, "sessions-csv")
    in_order = i.raw["sessions"].orderBy("ingest_seq").drop("ingest_seq")
    write_table(in_order, path, "csv")
    schema = T.StructType([in_order.schema[c] for c in ("session_id", "user_id", "session_ts", "device", "channel", "campaign_id")])
    rows = read_csv(i.spark, path, schema, keep_order=True)
    return cleaning.deduplicate(rows, ["session_id"]).drop("ingest_seq")


@query
def csv_quoted_text(i: Inputs) -> DataFrame:
    """Product names with quotes, commas, line breaks and blanks at the ends, and whole numbers with a point."""
    path = scratch_path(i.spark, "products-csv")
    text = F.concat(F.lit(' "'), "category", F.lit('", sale\n'), F.col("product_id"), F.lit(' ,"" '))
    rows = i.raw["products"].select(F.concat("product_id", F.lit(".0")).alias("product_id"), text.alias("category"), "cost")
    write_table(rows, path, "csv")
    return read_csv(i.spark, path, i.raw["products"].schema, multi_line=True)


@query
def quarantined_rows(i: Inputs) -> DataFrame:
    """Orders of which some have malformed times or amounts: rows parsed, and rows rejected by reason."""
    path, schema = scratch_path(i.spark, "orders-csv"), T.StructType([i.raw["orders"].schema[c] for c in ("order_id", "order_ts", "net_amount")])
    text = i.raw["orders"].select(
        "order_id",
        F.when(F.col("order_id") % 13 == 0, "soon").otherwise(F.col("order_ts").cast("string")).alias("order_ts"),
        F.when(F.col("order_id") % 17 == 0, "1.2.3").otherwise(F.col("net_amount").cast("string")).alias("net_amount"),
    )
    write_table(text, path, "csv")
    parsed, rejected = write_checked(read_checked(i.spark, path, schema), scratch_path(i.spark, "orders-checked"))
    good = parsed.agg(F.count(F.lit(1)).alias("n"), money_sum("net_amount").alias("net_amount"))
    placed = rejected.where("source_file IS NOT NULL AND source_block IS NOT NULL AND source_row IS NOT NULL")
    bad = placed.groupBy(F.concat_ws("; ", "reasons").alias("reason")).agg(F.count(F.lit(1)).alias("n"), money_sum("net_amount").alias("net_amount"))
    return bad.unionByName(good.withColumn("reason", F.lit("none")))


@query
def curated_coerced(i: Inputs) -> DataFrame:
    """A channel fact with malformed dates in its CSV, read the way the analysis job does."""
    path = scratch_path(i.spark, "fact-coerced-csv")
    rows = i.fact_channel_daily
    text = F.when(F.day("date") % 5 == 0, F.lit("not a day")).otherwise(F.col("date").cast("string"))
    write_table(rows.withColumn("date", text), path, "csv")
    coerced = read_curated(i.spark, path, schemas.FACT_CHANNEL_DAILY, "csv", strict=False)
    return coerced.groupBy("date", "channel").agg(money_sum("total_spend").alias("total_spend"))


@query
def repeated_lookups(i: Inputs) -> DataFrame:
    """Users and products of which some come again, with missing or other values: one row each is taken."""
    again = i.raw["users"].where("user_id % 7 = 0").selectExpr(
        "user_id", "IF(user_id % 2 = 0, NULL, signup_date - INTERVAL 1 DAY) AS signup_date", "CAST(NULL AS INT) AS city_tier"
    )
    users = unique_lookup(i.raw["users"].unionByName(again), ["user_id"], ["signup_date", "city_tier"])
    more = i.raw["products"].where("product_id % 7 = 0").withColumn("category", F.lit(None).cast("string"))
    items = segments.enrich_order_items(i.raw["order_items"], i.raw["products"].unionByName(more))
    tiers = users.groupBy("signup_date", "city_tier").agg(F.count(F.lit(1)).alias("n"))
    totals = items.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast("date").alias("signup_date"), F.lit(-1).alias("city_tier"), "n"
    )
    return tiers.unionByName(totals)


@query
def json_roundtrip(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "products-json")
    products = i.raw["products"]
    write_table(products, path, "json")
    return read_json(i.spark, path, products.schema, json_lines=True)


@query
def missing_source(i: Inputs) -> DataFrame:
    """Sessions joined to a users file that is not there: an empty table, so no user is new."""
    users = optional_source(
        lambda: i.spark.read.schema(i.raw["users"].schema).parquet(scratch_path(i.spark, "absent-users")),
        i.spark,
        i.raw["users"].schema,
    )
    joined = left_lookup(i.raw["sessions"], users, ["user_id"], spread_by=["session_id"])
    return joined.groupBy("device").agg(
        F.count(F.lit(1)).alias("session_rows"), F.count("signup_date").alias("known_users")
    )


@query
def curated_rescan(i: Inputs) -> DataFrame:
    """The channel fact written as CSV and read back with its declared types."""
    path = scratch_path(i.spark, "fact-channel-daily-csv")
    write_table(i.fact_channel_daily, path, "csv", sort_by=["date", "channel"])
    return read_curated(i.spark, path, schemas.FACT_CHANNEL_DAILY, "csv")


@query
def sorted_facts(i: Inputs) -> DataFrame:
    """Both daily facts as the job stores them: the place at which each row is found, and its key."""
    def stored(name: str, fact: DataFrame) -> str:
        path = scratch_path(i.spark, name)
        write_table(fact, path, sort_by=OUTPUTS[name][1])
        return path

    def places(name: str, path: str) -> DataFrame:
        key = F.col(OUTPUTS[name][1][1]).alias("key")
        return stored_positions(i.spark, path).select(F.lit(name).alias("fact"), "position", "date", key)

    campaigns = stored("fact_campaign_daily", i.fact_campaign_daily)
    channels = facts.build_fact_channel_daily(i.tables, i.spark.read.parquet(campaigns))
    return places("fact_campaign_daily", campaigns).unionByName(
        places("fact_channel_daily", stored("fact_channel_daily", channels))
    )


QUERIES["rounded_report"] = lambda spark, sf_dir: rounded(_money_as_double(Inputs(spark, sf_dir).metrics()), 2)


def _money_as_double(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    )
