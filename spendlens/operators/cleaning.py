"""Cleaning: channel names, first-row dedup, media nulls, revenue outliers, and counts of what was changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.config import CleaningConfig
from spendlens.functions.columns import as_column, canonical_channel, money
from spendlens.operators.quantiles import exact_quantiles
from spendlens.session import materialize

MEDIA_COLUMNS = ("spend", "clicks", "impressions")


def normalize_channel(df: DataFrame, unknown: str | None = None) -> DataFrame:
    """Canonical channel names; anything else becomes NULL, or ``unknown`` when a bucket for it is wanted."""
    channel = canonical_channel("channel")
    return df.withColumn("channel", channel if unknown is None else F.coalesce(channel, F.lit(unknown)))


def deduplicate(df: DataFrame, keys: list[str], order_by: str = "ingest_seq") -> DataFrame:
    """First row per key in ingest order; NULL keys count as equal.

    Spark cuts each key to its first row on the map side (WindowGroupLimit), so a key with very many copies does not
    reach one task as a whole.
    """
    first = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(order_by))
    return df.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def fill_media_nulls(ad_spend: DataFrame) -> DataFrame:
    return ad_spend.fillna(0, list(MEDIA_COLUMNS))


def upper_fence(df: DataFrame, column: str, multiplier: float) -> DataFrame:
    """One row: Q3 + multiplier x (Q3 - Q1) of the column."""
    quartiles = exact_quantiles(df, column, {"q1": 0.25, "q3": 0.75})
    return quartiles.select(money(f"q3 + {multiplier}D * (q3 - q1)").alias("fence"))


def flag_outliers(df: DataFrame, column: str, fence: Column | str) -> DataFrame:
    """Flag values above the fence; a NULL value is not an outlier."""
    above = as_column(column) > as_column(fence)
    return df.withColumn("is_revenue_outlier", F.coalesce(above, F.lit(False)))


def cap_outliers(df: DataFrame, column: str, fence: Column | str) -> DataFrame:
    """Capped copy of the column; the original stays, NULL stays NULL."""
    value, limit = as_column(column), as_column(fence)
    return df.withColumn(f"{column}_capped", F.when(value > limit, limit).otherwise(value))


def flag_and_cap_outliers(
    orders: DataFrame, column: str = "net_amount", multiplier: float = CleaningConfig.iqr_multiplier
) -> DataFrame:
    """Reads ``orders`` three times (two passes for the fence, one for the rows), so hand over a stored table."""
    return (
        orders.withColumn("__fence", upper_fence(orders, column, multiplier).scalar())
        .transform(flag_outliers, column, "__fence")
        .transform(cap_outliers, column, "__fence")
        .drop("__fence")
    )


def clean_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.transform(normalize_channel).transform(deduplicate, ["session_id"])


def dedup_ad_spend(ad_spend: DataFrame) -> DataFrame:
    """Dates become dates before the dedup, so one day in two spellings still counts as one."""
    return ad_spend.withColumn("date", F.to_date("date")).transform(deduplicate, ["date", "campaign_id"])


def clean_ad_spend(ad_spend: DataFrame) -> DataFrame:
    return ad_spend.transform(normalize_channel).transform(dedup_ad_spend).transform(fill_media_nulls)


def clean_orders(orders: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Deduplicated orders with outliers flagged and capped. Dedup comes first: copies would move the fence.

    The deduplicated orders feed the fence and every join after it, so they are written once.
    """
    kept = materialize(deduplicate(orders, ["order_id"]), "orders")
    return flag_and_cap_outliers(kept, config.outlier_column, config.iqr_multiplier)


def clean(raw: dict[str, DataFrame], config: CleaningConfig = CleaningConfig()) -> dict[str, DataFrame]:
    """Cleaned copies of all tables; the raw dict is left as it is."""
    return {
        **raw,
        "sessions": clean_sessions(raw["sessions"]),
        "orders": clean_orders(raw["orders"], config),
        "ad_spend": clean_ad_spend(raw["ad_spend"]),
        "campaigns": normalize_channel(raw["campaigns"]),
    }


def _metric_rows(df: DataFrame, table: str, metrics: dict[str, Column]) -> DataFrame:
    """One aggregate pass, turned into rows (table_name, metric, value)."""
    totals = df.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(m) for m, c in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return totals.select(F.lit(table).alias("table_name"), F.explode(pairs).alias("p")).select(
        "table_name", "p.metric", "p.value"
    )


def dq_report(raw: dict[str, DataFrame], cleaned: dict[str, DataFrame]) -> DataFrame:
    """Rows read and kept, nulls filled, outliers, and group keys that later aggregates leave out."""

    def missing(column: str) -> Column:
        return F.count_if(F.col(column).isNull())

    rows = F.count(F.lit(1))
    reports = [
        _metric_rows(raw["sessions"], "sessions", {"rows_read": rows}),
        _metric_rows(
            cleaned["sessions"],
            "sessions",
            {
                "rows_kept": rows,
                "channel_unmapped": missing("channel"),
                "campaign_missing": missing("campaign_id"),
                "user_missing": missing("user_id"),
            },
        ),
        _metric_rows(raw["orders"], "orders", {"rows_read": rows}),
        _metric_rows(
            cleaned["orders"],
            "orders",
            {
                "rows_kept": rows,
                "net_amount_missing": missing("net_amount"),
                "outliers_capped": F.count_if("is_revenue_outlier"),
            },
        ),
        _metric_rows(raw["ad_spend"], "ad_spend", {"rows_read": rows}),
        _metric_rows(
            dedup_ad_spend(raw["ad_spend"]),
            "ad_spend",
            {"rows_kept": rows, **{f"{c}_filled": missing(c) for c in MEDIA_COLUMNS}},
        ),
    ]
    for table, key in (("users", "user_id"), ("campaigns", "campaign_id"), ("products", "product_id")):
        repeats = raw[table].groupBy(key).agg((F.count(F.lit(1)) - 1).alias("extra"))
        reports.append(_metric_rows(repeats, table, {"repeated_keys": F.sum("extra")}))
    report = reports[0]
    for more in reports[1:]:
        report = report.unionByName(more)
    return report
