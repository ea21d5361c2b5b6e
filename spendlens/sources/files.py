"""Reading raw files and curated tables with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.columns import missing_to_null, parse
from spendlens.schemas import RAW_FILES

TIMESTAMP_PATTERN = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _typed(schema: T.StructType, strict: bool) -> list:
    return [
        parse(missing_to_null(F.col(f.name)), f.dataType.simpleString(), strict).alias(f.name) for f in schema.fields
    ]


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    strict: bool = True,
    keep_order: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header. Columns are found by name, the usual missing-value tokens become NULL.

    A quote inside a quoted text is doubled. ``multi_line`` allows line breaks inside quotes, at the price that a file
    cannot be split; without it a row that a line break cuts raises. All columns are parsed, also those nobody reads:
    only so are rows with too few or too many values found, which always raise.

    ``strict`` raises on a malformed value, otherwise it becomes NULL. ``keep_order`` adds ``ingest_seq``, which sorts
    rows as they stand in the files, so that "first row wins" means the same whichever task reads which split.
    """
    text_rows = spark.read.options(
        header=True, mode="FAILFAST", escape='"', multiLine=multi_line, columnPruning=False
    ).csv(path)
    columns = _typed(schema, strict)
    if keep_order:
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        columns.append(place.alias("ingest_seq"))
    return text_rows.select(*columns)


def read_json(spark: SparkSession, path: str, schema: T.StructType, json_lines: bool = False) -> DataFrame:
    """JSON objects: one array per file, or (splittable, for large inputs) one object per line."""
    return spark.read.schema(schema).option("multiLine", not json_lines).json(path)


def optional_source(read, spark: SparkSession, schema: T.StructType) -> DataFrame:
    """What ``read()`` gives, or an empty table of the same schema when the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_raw(
    spark: SparkSession,
    base_path: str,
    strict: bool = True,
    optional: bool = False,
    json_lines: bool = False,
    multi_line: bool = False,
) -> dict[str, DataFrame]:
    """The seven raw tables below one folder; ``optional`` turns absent files into empty tables.

    ``json_lines`` reads the JSON files as one object per line, which large ones should be, since they are split then;
    ``multi_line`` allows line breaks inside quoted CSV text.
    """
    ordered = {"sessions", "orders", "ad_spend"}
    tables = {}
    for name, (file_name, schema) in RAW_FILES.items():
        path = f"{base_path.rstrip('/')}/{file_name}"

        def read(path=path, schema=schema, name=name):
            if path.endswith(".json"):
                return read_json(spark, path, schema, json_lines)
            return read_csv(spark, path, schema, strict, name in ordered, multi_line)

        if optional:
            empty = T.StructType([*schema.fields, T.StructField("ingest_seq", T.LongType())])
            tables[name] = optional_source(read, spark, empty if name in ordered else schema)
        else:
            tables[name] = read()
    return tables


def read_curated(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet", strict: bool = True
) -> DataFrame:
    """A curated fact written by an earlier job, with its declared types. Of a CSV fact malformed values raise, or become
    NULL when not ``strict``."""
    if file_format == "csv":
        return read_csv(spark, path, schema, strict)
    return spark.read.schema(schema).format(file_format).load(path)
