"""Late and out-of-order data: files that land are streamed in, and only the dates they touch are built anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.cleaning import cap_outliers, deduplicate, flag_outliers, normalize_channel
from spendlens.operators.facts import build_fact_sessions

#: Time column of each stream.
STREAMS = {"sessions": "session_ts", "orders": "order_ts"}


@dataclass(frozen=True)
class LateConfig:
    """``landing`` has a folder of Parquet files per stream, ``store`` takes what was streamed, the checkpoints and the fact.

    ``reach_days`` bounds how far apart copies of a row may lie, and an order from its session: only so far around new rows
    is looked for what they change. ``fence`` is the outlier limit, which a full run sets.
    """

    landing: str
    store: str
    fence: float
    reach_days: int = 3

    def stored(self, name: str) -> str:
        return f"{self.store}/raw/{name}"

    @property
    def fact(self) -> str:
        return f"{self.store}/fact_sessions"


def ingest(spark: SparkSession, config: LateConfig, schemas: dict[str, T.StructType]) -> None:
    """Take in all files that have landed since the last run, each once, by date of their rows.

    A batch is written to a folder of its own, over what a broken run may have left there, so every row is stored exactly
    once however often the run is restarted.
    """
    for name, time in STREAMS.items():

        def keep(batch: DataFrame, number: int, name: str = name, time: str = time) -> None:
            dated = batch.withColumn("row_date", F.to_date(time))
            dated.write.mode("overwrite").partitionBy("row_date").parquet(f"{config.stored(name)}/batch={number}")

        files = spark.readStream.schema(schemas[name]).parquet(f"{config.landing}/{name}")
        query = (
            files.writeStream.foreachBatch(keep)
            .option("checkpointLocation", f"{config.store}/checkpoints/{name}")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def _raw(spark: SparkSession, config: LateConfig, name: str, schema: T.StructType) -> DataFrame:
    known = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("row_date", T.DateType())])
    return spark.read.schema(known).parquet(config.stored(name))


def _restated(spark: SparkSession, config: LateConfig) -> DataFrame:
    """The batches whose dates have been built, by stream."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{config.store}/restated")
    schema = "stream string, batch long"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{config.store}/restated")


def restate(spark: SparkSession, config: LateConfig, schemas: dict[str, T.StructType], users: DataFrame) -> list:
    """Build the dates of the session fact that batches not yet accounted for have changed; those dates.

    The sessions concerned are the new ones and those of new orders; their dates (at most the days of the calendar, all
    the driver gets) are built from the stored rows within reach, by the functions the batch job uses, and replace their
    partitions. A batch counts as built only after that, so a run that breaks off is made good by the next.
    """
    raw = {name: _raw(spark, config, name, schemas[name]) for name in STREAMS}
    done = _restated(spark, config)
    new = {n: df.join(F.broadcast(done.where(F.col("stream") == n)), "batch", "left_anti") for n, df in raw.items()}  # a number per run
    ends = [new[n].agg(F.min("row_date"), F.max("row_date")).first() for n in STREAMS]
    bounds = [d for pair in ends for d in pair if d is not None]
    if not bounds:
        return []
    reach = F.expr(f"INTERVAL {config.reach_days} DAYS")
    near = {
        n: df.where(F.col("row_date").between(F.lit(min(bounds)) - 2 * reach, F.lit(max(bounds)) + 2 * reach))
        for n, df in raw.items()
    }
    touched = new["sessions"].select("session_id").union(new["orders"].select("session_id")).distinct()
    dates = [r[0] for r in near["sessions"].join(touched, "session_id", "left_semi").select("row_date").distinct().collect()]
    dates = sorted(d for d in dates if d is not None)

    sessions = normalize_channel(deduplicate(near["sessions"].drop("batch", "row_date"), ["session_id"]))
    orders = deduplicate(near["orders"].drop("batch", "row_date"), ["order_id"])
    fence = F.lit(config.fence).cast("decimal(18,4)")
    orders = cap_outliers(flag_outliers(orders, "net_amount", fence), "net_amount", fence)
    on_dates = sessions.where(F.to_date("session_ts").isin(dates))
    fact = build_fact_sessions({"sessions": on_dates, "orders": orders, "users": users})
    fact.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_date").parquet(config.fact)

    built = {r[0] for r in spark.read.parquet(config.fact).where(F.col("session_date").isin(dates)).select("session_date").distinct().collect()}
    for gone in set(dates) - {r[0] for r in on_dates.select(F.to_date("session_ts")).distinct().collect()} & built:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{config.fact}/session_date={gone}")  # its sessions are on other dates now
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    marks = [df.select(F.lit(n).alias("stream"), "batch").distinct() for n, df in new.items()]
    marks[0].union(marks[1]).coalesce(1).write.mode("append").parquet(f"{config.store}/restated")
    return dates


def catch_up(spark: SparkSession, config: LateConfig, schemas: dict[str, T.StructType], users: DataFrame) -> list:
    """One run: take in what has landed, then build the dates it changes."""
    ingest(spark, config, schemas)
    return restate(spark, config, schemas, users)
