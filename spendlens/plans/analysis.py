"""Analysis job: KPI tables, trends, segments, findings, attribution, regression and the bounded allocation.

    spark-submit -m spendlens.plans.analysis --base-path RAW --output-path CURATED
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens import schemas
from spendlens.config import JobConfig
from spendlens.operators import attribution, budget, insights, kpis, regression, segments, touches, trends
from spendlens.operators.cleaning import clean_ad_spend
from spendlens.plans.etl import parse_args
from spendlens.session import build_session, drop_scratch, materialize
from spendlens.sources.files import load_raw, read_curated
from spendlens.sources.sinks import write_report


class Analysis:
    """Every analysis table, each built from the inputs on first use.

    ``fact_sessions`` should be a stored table; shared intermediates are small and stored once.
    """

    def __init__(
        self,
        fact_sessions: DataFrame,
        ad_spend: DataFrame,
        users: DataFrame,
        config: JobConfig = JobConfig("", ""),
    ):
        self.fact_sessions = fact_sessions
        self.ad_spend = ad_spend
        self.users = users
        self.config = config

    @cached_property
    def campaign_daily(self) -> DataFrame:
        return kpis.campaign_daily(self.fact_sessions, self.ad_spend, self.config.revenue_column)

    @cached_property
    def stored_campaign_daily(self) -> DataFrame:
        return materialize(self.campaign_daily, "campaign-daily")

    @cached_property
    def channel_daily(self) -> DataFrame:
        return kpis.channel_daily(self.campaign_daily, self.ad_spend)

    @cached_property
    def stored_channel_daily(self) -> DataFrame:
        return materialize(self.channel_daily, "channel-daily")

    @cached_property
    def wasted(self) -> DataFrame:
        return kpis.wasted_spend(self.stored_campaign_daily)

    def cells(self, attributes: list[str]) -> DataFrame:
        rows = self.fact_sessions
        if "city_tier" in attributes:
            rows = segments.with_city_tier(rows, self.users)
        return segments.segment_cells(rows, self.ad_spend, attributes, self.config.revenue_column)

    @cached_property
    def channel_device(self) -> DataFrame:
        return segments.segment_channel_device(self.cells(["device"]))

    @cached_property
    def spreads(self) -> DataFrame:
        cells = self.cells(["device", "is_new_user", "city_tier"])
        return insights.segment_spreads(segments.segment_metrics(cells))

    @cached_property
    def attributed_roas(self) -> DataFrame:
        return attribution.attributed_roas(
            attribution.last_touch(self.fact_sessions, self.config.revenue_column),
            attribution.spend_by_channel(kpis.ad_spend_rollup(self.ad_spend)),
        )

    @cached_property
    def regression_table(self) -> DataFrame:
        """One row per day; the fit and every score read it, so it is stored."""
        table = regression.with_split(regression.regression_table(self.channel_daily), self.config.regression)
        return materialize(table, "regression")

    @cached_property
    def fit(self) -> regression.OlsFit:
        return regression.fit_ols(self.regression_table.where("not is_test"))

    @cached_property
    def channel_performance(self) -> DataFrame:
        return regression.channel_performance(self.attributed_roas, self.fit)

    @cached_property
    def bounds_allocation(self) -> DataFrame:
        weights = self.fit.table(self.fact_sessions.sparkSession).selectExpr(
            "regexp_replace(feature, '^spend_', '') AS channel", "coefficient AS regression_coefficient"
        )
        return budget.allocate_by_bounds(weights, self.config.budget.bounds_scenarios)


def run(spark: SparkSession, config: JobConfig) -> None:
    """Write every analysis table as a rounded report below ``<output path>/analysis``.

    Malformed dates and times become NULL here, so one of them does not end the job; the ETL job is strict.
    """
    root = config.output_path.rstrip("/")
    raw = load_raw(spark, config.base_path, strict=False, optional=True)
    sessions = read_curated(spark, f"{root}/fact_sessions", schemas.FACT_SESSIONS, config.file_format, strict=False)
    a = Analysis(sessions, materialize(clean_ad_spend(raw["ad_spend"]), "ad-spend"), raw["users"], config)
    a.campaign_daily = a.stored_campaign_daily
    a.channel_daily = a.stored_channel_daily
    daily, weekly = trends.daily_trends(a.channel_daily), trends.weekly_trends(a.channel_daily)
    all_cells = materialize(a.cells(["device", "is_new_user", "city_tier"]), "cells")
    spreads = materialize(insights.segment_spreads(segments.segment_metrics(all_cells)), "spreads")
    channel_device = segments.segment_channel_device(all_cells)
    items = segments.enrich_order_items(raw["order_items"], raw["products"])
    simple = kpis.channel_roas(a.channel_daily)
    reports = {
        "channel_roas": (simple, ["channel"]),
        "top_campaigns_spend": (kpis.top_campaign_days(a.campaign_daily, "spend"), None),
        "top_campaigns_revenue": (kpis.top_campaign_days(a.campaign_daily, "attributed_revenue"), None),
        "campaign_averages": (kpis.campaign_averages(a.campaign_daily), None),
        "wasted_spend": (a.wasted, [F.desc("spend"), "date", "campaign_id"]),
        "daily_trends": (daily, ["date"]),
        "weekly_trends": (weekly, ["week_index"]),
        "promo_days": (trends.promo_periods(daily, "date"), ["date"]),
        "promo_weeks": (trends.promo_periods(weekly, "week_index"), ["week_index"]),
        "segment_channel_device": (channel_device, ["channel", "device"]),
        "segment_new_user": (segments.segment_new_user(all_cells), ["is_new_user"]),
        "segment_city_tier": (segments.segment_city_tier(all_cells), ["city_tier"]),
        "category_performance": (segments.category_performance(items), ["category"]),
        "segment_spreads": (spreads, ["metric", "segment"]),
        "segment_findings": (insights.segment_findings(insights.top_segments(spreads)), ["metric", "rank"]),
        "inefficiencies": (
            insights.inefficiency_lines(insights.inefficiencies(a.wasted, channel_device)),
            ["area_no", "kind", "line_no"],
        ),
        "last_touch": (attribution.last_touch(a.fact_sessions, config.revenue_column), ["channel"]),
        "attributed_roas": (a.attributed_roas, ["channel"]),
        "roas_comparison": (attribution.roas_comparison(simple, a.attributed_roas), ["channel"]),
        "preceding_touch": (
            touches.preceding_touch(touches.preceding_sessions(a.fact_sessions, config.revenue_column)),
            ["channel"],
        ),
        "multi_touch": (
            touches.multi_touch(touches.multi_touch_credits(a.fact_sessions, config.touches, config.revenue_column)),
            ["channel"],
        ),
        "daily_regression": (a.regression_table, ["date"]),
        "regression_metrics": (regression.regression_metrics(a.regression_table, a.fit), None),
        "regression_coefficients": (a.fit.table(spark), [F.desc("absolute_coefficient"), "feature"]),
        "channel_performance": (a.channel_performance, ["channel"]),
        "bounds_allocation": (a.bounds_allocation, ["scenario_id", "channel"]),
        "bounds_allocation_totals": (budget.allocation_totals(a.bounds_allocation), ["scenario_id"]),
        "revenue_impact": (
            budget.revenue_impact(a.regression_table, a.fit, a.bounds_allocation, config.budget),
            ["scenario_id"],
        ),
    }
    for name, (table, keys) in reports.items():
        write_report(table, f"{root}/analysis/{name}", 4, keys)


if __name__ == "__main__":
    session = build_session("spendlens-analysis")
    run(session, parse_args("Analyse the curated facts"))
    drop_scratch(session)
