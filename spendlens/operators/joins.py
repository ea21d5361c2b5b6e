"""Left joins to lookup tables: unique keys, and missing keys spread over the cluster."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.config import LayoutConfig

_SALT = "__spread"


def unique_lookup(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key. Of a repeated key the lowest row is taken, column by column in order, a value before NULL.

    A repeated key would multiply the rows it is joined to. Grouping also lets the optimizer see that the key is
    unique, so a left join whose columns nobody reads is dropped along with its shuffle.
    """
    parts = [part for c in columns for part in (F.col(c).isNull().alias(f"{c}__missing"), F.col(c))]
    lowest = df.groupBy(*keys).agg(F.min(F.struct(*parts)).alias("lowest"))
    return lowest.select(*keys, *[F.col(f"lowest.{c}").alias(c) for c in columns])


def left_lookup(facts: DataFrame, lookup: DataFrame, keys: list[str], spread_by: list[str]) -> DataFrame:
    """facts LEFT JOIN lookup USING (keys), where ``lookup`` is unique on the keys.

    A NULL key matches nothing, yet a plain shuffle sends all such rows to one task. Here they get a second key made
    from ``spread_by`` and scatter over the cluster. Hot keys that are not NULL sit on the left of the join, where
    adaptive execution splits them. Spark broadcasts the lookup by itself when its measured size allows.
    """
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    scattered = F.pmod(F.xxhash64(*spread_by), F.lit(LayoutConfig.missing_key_spread)).cast("int") + 1
    left = facts.withColumn(_SALT, F.when(missing, scattered).otherwise(F.lit(0)))
    # Written as a condition, not as a literal: a literal key would be folded out of the shuffle.
    right = lookup.withColumn(_SALT, F.when(missing, F.lit(-1)).otherwise(F.lit(0)))
    return left.join(right, [*keys, _SALT], "left").drop(_SALT)
