"""Small column helpers the operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A column that a lambda refers to may be inlined by the optimizer and then computed anew for each array element;
    a lambda variable cannot be.
    """
    return F.transform(F.array(value), body).getItem(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text without other letters takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def blank_words(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: equal texts share them, so results can be computed per distinct text.

    Derived from content alone, it is the same in every evaluation, whichever executor repeats it.
    """
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("text"), text).alias("_k2")]


KEY = ["_k1", "_k2"]


def bounded_batches(spark: SparkSession) -> None:
    """Hold what one batch sends to a Python worker to 1 MB (or one row), however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def packed(docs: DataFrame, *without: str) -> Column:
    """All columns but some as one struct: whatever their names, they clash with nothing an operator adds."""
    names = [c for c in docs.columns if c not in without]
    return F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("_row")


def unpacked(docs: DataFrame, *without: str, **instead: Column) -> list[Column]:
    """The packed columns in their order; ``instead`` has columns that were not packed but keep their place."""
    return [
        instead[c].alias(c) if c in instead else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in without
    ]
