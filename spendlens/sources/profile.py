"""Table previews, profiles and the order of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table_name, column_name, data_type, n_rows, n_columns, non_null): one aggregate per table."""
    parts = []
    for name, df in tables.items():
        totals = df.agg(
            F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
        )
        columns = F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(f"c{i}").alias("non_null"))
                for i, (c, t) in enumerate(df.dtypes)
            ]
        )
        parts.append(
            totals.select(
                F.lit(name).alias("table_name"),
                "n_rows",
                F.lit(len(df.columns)).alias("n_columns"),
                F.explode(columns).alias("c"),
            ).select("table_name", "c.*", "n_rows", "n_columns")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows that arrive."""
    return df.limit(n)


def stored_positions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a parquet table with ``position``, their place from 0 on in the order of the files and inside them.

    A file's rows start where those of the files before it end. The running sum is over one row per file; the table's own
    rows are neither shuffled nor sorted.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), "_metadata.row_index")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (
        rows.join(starts, "_file")
        .withColumn("position", F.col("_start") + F.col("row_index"))
        .drop("_file", "_start", "row_index")
    )
