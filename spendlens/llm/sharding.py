"""Sharding by bytes: global prefix sums of document sizes, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import packed, unpacked
from spendlens.session import materialize


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Contiguous shards 0 to ``n_shards - 1`` of nearly equal bytes, in the order of ``order``.

    Adds ``size`` (UTF-8 bytes of the text, none for null, plus 1), ``text_crc32``, ``shard`` and ``slot`` (gapless from
    0 within its shard), replacing columns of these names. A document belongs to the shard its middle byte falls in, so
    a shard is off its target by at most half a document at each end; if a single document exceeds a target, shards may
    stay empty. Null ids come first; rows with equal ids are ordered by size, checksum and place, and may be cut apart.
    Columns other than the text are carried along; the text stays behind (join it back by id, or write by ``shard``).

    The rows are dealt out by range, a total per partition is summed up (one row per partition), and each partition
    adds its own running sum: no task sees more than its range. The dealt table is written first, since a range
    partitioning that is computed again may cut elsewhere.
    """
    own = ("size", "text_crc32", "shard", "slot", text)
    rows = docs.select(
        packed(docs, *own),
        F.col(order).alias("_order"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_place"),
    )
    keys = [F.col("_order").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("_place")]
    dealt = materialize(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "dealt")

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = dealt.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    upto = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumn("_upto", F.sum("size").over(upto))
        .withColumn("_nth", F.row_number().over(upto))
        .join(F.broadcast(starts), "_part")
        .withColumn("_twice_middle", 2 * (F.col("_bytes_before") + F.col("_upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"_twice_middle * {n_shards}L div (2 * _total)").cast("int"))
        .withColumn("_index", F.col("_rows_before") + F.col("_nth") - 1)
    )
    placed = materialize(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        *unpacked(docs, *own),
        "size",
        "text_crc32",
        "shard",
        (F.col("_index") - F.col("_first")).alias("slot"),
    )
