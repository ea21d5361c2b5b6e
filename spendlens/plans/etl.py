"""Curation job: raw files -> cleaned tables -> three facts.

    spark-submit -m spendlens.plans.etl --base-path RAW --output-path CURATED
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spendlens import schemas
from spendlens.config import JobConfig
from spendlens.operators.cleaning import clean, dq_report
from spendlens.operators.facts import build_fact_campaign_daily, build_fact_channel_daily, build_fact_sessions
from spendlens.session import build_session, drop_scratch
from spendlens.sources.files import load_raw, read_curated
from spendlens.sources.sinks import write_table


@dataclass(frozen=True)
class Facts:
    sessions: DataFrame
    campaign_daily: DataFrame
    channel_daily: DataFrame


# Fact -> (schema, key it is sorted by, partition columns in parquet)
OUTPUTS = {
    "fact_sessions": (schemas.FACT_SESSIONS, ["session_id"], ["session_date"]),
    "fact_campaign_daily": (schemas.FACT_CAMPAIGN_DAILY, ["date", "campaign_id"], None),
    "fact_channel_daily": (schemas.FACT_CHANNEL_DAILY, ["date", "channel"], None),
}


def run(spark: SparkSession, config: JobConfig) -> dict[str, int]:
    """Write the facts (and the data-quality report) below the output path; rows written per table.

    Each fact is read back from its own output, so nothing upstream is computed twice.
    """
    raw = load_raw(spark, config.base_path)
    tables = clean(raw, config.cleaning)
    csv = config.file_format == "csv"

    def store(name: str, fact: DataFrame) -> tuple[DataFrame, int]:
        schema, keys, partitions = OUTPUTS[name]
        path = f"{config.output_path.rstrip('/')}/{name}"
        # Session rows are only sorted inside their date; a global sort of the largest table buys nothing.
        sort_by = keys if partitions is None else (None if csv else keys)
        written = write_table(fact, path, config.file_format, None if csv else partitions, sort_by)
        return read_curated(spark, path, schema, config.file_format), written.get["rows"]

    sessions, n_sessions = store("fact_sessions", build_fact_sessions(tables))
    campaigns, n_campaigns = store("fact_campaign_daily", build_fact_campaign_daily(tables, sessions))
    _, n_channels = store("fact_channel_daily", build_fact_channel_daily(tables, campaigns))
    if config.write_dq_report:  # narrow, but one more pass over the raw tables
        write_table(dq_report(raw, tables), f"{config.output_path.rstrip('/')}/dq_report", config.file_format)
    return {"fact_sessions": n_sessions, "fact_campaign_daily": n_campaigns, "fact_channel_daily": n_channels}


def parse_args(description: str) -> JobConfig:
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--base-path", required=True, help="folder of the raw files")
    parser.add_argument("--output-path", required=True, help="folder of the curated tables and reports")
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv"), help="format of the facts")
    parser.add_argument("--no-dq-report", action="store_true", help="skip the data-quality counts")
    args = parser.parse_args()
    return JobConfig(args.base_path, args.output_path, args.format, not args.no_dq_report)


if __name__ == "__main__":
    session = build_session("spendlens-etl")
    for table, rows in run(session, parse_args("Build the curated facts")).items():
        print(f"{table}: {rows} rows")
    drop_scratch(session)
