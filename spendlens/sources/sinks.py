"""Writing facts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.sources.files import TIMESTAMP_PATTERN

FRACTIONS = (T.DoubleType, T.FloatType, T.DecimalType)


def write_table(
    df: DataFrame,
    path: str,
    file_format: str = "parquet",
    partition_by: list[str] | None = None,
    sort_by: list[str | Column] | None = None,
) -> Observation:
    """Overwrite ``path``; the returned observation holds the number of rows written, with no extra pass.

    With ``partition_by`` rows are first rebalanced on those columns, which keeps files few and splits an oversized
    partition. ``sort_by`` (names ascending with NULLs last, or sort columns) sorts inside files then, or the whole output otherwise (a report).
    """
    rows = df
    if partition_by:
        rows = rows.hint("rebalance", *partition_by)
        if sort_by:
            rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    elif sort_by:
        rows = rows.orderBy(*[F.asc_nulls_last(c) if isinstance(c, str) else c for c in sort_by])
    # Observed last: a global sort runs its input once more to sample the ranges, which would count rows twice.
    written = Observation()
    rows = rows.observe(written, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        # Blanks around a text are data; the CSV writer would trim them.
        writer = writer.options(
            header=True,
            escape='"',
            timestampNTZFormat=TIMESTAMP_PATTERN,
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return written


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Fractional columns rounded half to even."""
    return df.withColumns(
        {f.name: F.bround(F.col(f.name), digits) for f in df.schema.fields if isinstance(f.dataType, FRACTIONS)}
    )


def write_report(df: DataFrame, path: str, digits: int, sort_by: list[str | Column] | None = None) -> Observation:
    """A small rounded CSV report."""
    return write_table(rounded(df, digits), path, "csv", sort_by=sort_by)
