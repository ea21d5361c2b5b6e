"""Guarded marketing KPIs, one place for every ratio the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spendlens.functions.columns import ratio

# KPI -> (numerator, denominator)
_KPIS = {
    "cpc": ("spend", "clicks"),
    "ctr": ("clicks", "impressions"),
    "cvr": ("orders", "sessions"),
    "roas": ("revenue", "spend"),
    "cac": ("spend", "orders"),
}


def with_kpis(
    df: DataFrame, measures: dict[str, str], outputs: dict[str, str], cac_default: float | None = 0.0
) -> DataFrame:
    """Add the KPIs in ``outputs`` (KPI -> column name), from the columns in ``measures`` (measure -> column name)."""
    columns = {}
    for kpi, name in outputs.items():
        numerator, denominator = _KPIS[kpi]
        default = cac_default if kpi == "cac" else 0.0
        columns[name] = ratio(measures[numerator], measures[denominator], default)
    return df.withColumns(columns)
