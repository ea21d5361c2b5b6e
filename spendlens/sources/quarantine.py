"""CSV rows that cannot be read, kept apart with their place and the reason, in the pass that parses the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.columns import missing_to_null, parse

#: What a checked row has beside its columns.
PLACE = ("source_file", "source_block", "source_row", "reasons")
_BROKEN = "_broken_row"


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The typed columns of a CSV with a header, and where each row stands: ``source_file``, ``source_block`` (the byte its
    split begins at), ``source_row`` (rising within the file), and ``reasons``, empty for a good row.

    A row with too few or too many values has the reason ``row: <its text>`` and no values; a malformed value is null and
    has the reason ``column: value``. Nothing raises and nothing is dropped. Columns are found by name; one that the header
    lacks is null, and a header may have more.
    """
    header = spark.read.options(header=True, escape='"').csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _BROKEN]])
    rows = (
        spark.read.schema(text)
        .options(header=True, mode="PERMISSIVE", escape='"', columnPruning=False, columnNameOfCorruptRecord=_BROKEN)
        .csv(path)
    )
    broken = F.col(_BROKEN)
    columns, reasons = [], [F.when(broken.isNotNull(), F.concat(F.lit("row: "), broken))]
    for field in schema.fields:
        raw = missing_to_null(F.col(f"`{field.name}`")) if field.name in header else F.lit(None).cast("string")
        value = F.when(broken.isNull(), parse(raw, field.dataType.simpleString(), strict=False))
        columns.append(value.alias(field.name))
        wrong = broken.isNull() & raw.isNotNull() & value.isNull()
        reasons.append(F.when(wrong, F.concat(F.lit(f"{field.name}: "), raw)))
    return rows.select(
        *columns,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_row"),
        F.array_compact(F.array(*reasons)).alias("reasons"),
    )


def write_checked(checked: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write a checked table once, good and rejected rows in folders of their own; the parsed rows and the quarantine."""
    checked.withColumn("rejected", F.size("reasons") > 0).write.mode("overwrite").partitionBy("rejected").parquet(path)
    schema = T.StructType([*checked.schema.fields, T.StructField("rejected", T.BooleanType())])
    stored = checked.sparkSession.read.schema(schema).parquet(path)
    parsed = stored.where("NOT rejected").drop("rejected", *PLACE)
    return parsed, stored.where("rejected").drop("rejected")
