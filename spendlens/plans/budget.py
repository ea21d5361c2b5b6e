"""Budget job: channel metrics, allocation, impact and sensitivity from the curated facts.

    spark-submit -m spendlens.plans.budget --base-path RAW --output-path CURATED
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens import schemas
from spendlens.config import BudgetConfig, JobConfig
from spendlens.operators import budget
from spendlens.plans.etl import Facts, parse_args
from spendlens.session import build_session, drop_scratch, materialize
from spendlens.sources.files import load_raw, read_curated
from spendlens.sources.sinks import write_report


def channel_metrics(
    facts: Facts, order_items: DataFrame, products: DataFrame, config: BudgetConfig = BudgetConfig()
) -> DataFrame:
    """Spend, revenue, ROAS and margin per channel over the lookback."""
    since = budget.lookback_start(facts.channel_daily, config.lookback_days)
    margins = budget.margin_by_channel(
        budget.order_channels(facts.sessions),
        budget.order_margin(order_items, products),
        None if config.margin_window == "all" else since,
    )
    return budget.channel_metrics(facts.channel_daily, margins, since)


def run(spark: SparkSession, config: JobConfig) -> None:
    """Write the five reports below the output path."""
    root = config.output_path.rstrip("/")
    raw = load_raw(spark, config.base_path)
    facts = Facts(
        read_curated(spark, f"{root}/fact_sessions", schemas.FACT_SESSIONS, config.file_format),
        read_curated(spark, f"{root}/fact_campaign_daily", schemas.FACT_CAMPAIGN_DAILY, config.file_format),
        read_curated(spark, f"{root}/fact_channel_daily", schemas.FACT_CHANNEL_DAILY, config.file_format),
    )
    # A handful of rows that all reports start from.
    metrics = materialize(channel_metrics(facts, raw["order_items"], raw["products"], config.budget), "metrics")
    allocation = materialize(budget.allocate_by_share(metrics, config.budget.share_scenarios), "allocation")
    keys = ["scenario_id", "channel"]
    write_report(allocation, f"{root}/budget_allocation", 2, keys)
    impact = budget.impact_estimates(allocation, config.budget)
    write_report(impact, f"{root}/budget_impact_by_channel", 2, keys)
    write_report(budget.impact_totals(impact), f"{root}/budget_impact_totals", 2, ["scenario_id"])
    write_report(
        budget.sensitivity(allocation, config.budget),
        f"{root}/budget_sensitivity",
        2,
        ["scenario_id", "roas_change_pct", "budget_change_pct"],
    )
    write_report(metrics, f"{root}/channel_metrics", 4, ["channel"])


if __name__ == "__main__":
    session = build_session("spendlens-budget")
    run(session, parse_args("Allocate the next budget"))
    drop_scratch(session)
