"""Segment spreads, top segments, findings in words, and the spend inefficiency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.operators import report_texts as text


def segment_spreads(metrics: DataFrame) -> DataFrame:
    """Highest minus lowest CVR and ROAS inside each segment, with the members at both ends.

    One aggregate covers both metrics and all segment kinds; on ties the member that sorts first is named.
    """
    both = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("CVR", "ROAS")]
    )
    long = metrics.select("segment_kind", "segment", "member", F.explode(both).alias("m")).select(
        "segment_kind", "segment", "member", "m.metric", "m.value"
    )
    return (
        long.groupBy("metric", "segment_kind", "segment")
        .agg(
            F.max("value").alias("max_value"),
            F.min("value").alias("min_value"),
            F.min_by("member", F.struct(-F.col("value"), F.col("member"))).alias("best_member"),
            F.min_by("member", F.struct("value", "member")).alias("worst_member"),
            F.max(F.when(F.col("member") == "new", F.col("value"))).alias("new_value"),
            F.max(F.when(F.col("member") == "returning", F.col("value"))).alias("returning_value"),
        )
        .withColumn("spread", F.col("max_value") - F.col("min_value"))
    )


def top_segments(spreads: DataFrame, n: int = 3) -> DataFrame:
    """The n widest spreads per metric."""
    widest = Window.partitionBy("metric").orderBy(F.desc_nulls_last("spread"), "segment")
    return spreads.withColumn("rank", F.row_number().over(widest)).where(F.col("rank") <= n)


def segment_findings(top: DataFrame) -> DataFrame:
    """Finding and suggested action for each top segment."""
    segment, best, worst = F.col("segment"), F.col("best_member"), F.col("worst_member")
    high, low = F.col("max_value"), F.col("min_value")
    new, returning = F.col("new_value"), F.col("returning_value")
    texts = {
        ("CVR", "channel"): (
            F.format_string(text.CVR_CHANNEL_FINDING, segment, best, high, worst, low),
            F.format_string(text.CVR_CHANNEL_ACTION, worst, segment),
        ),
        ("CVR", "user"): (F.format_string(text.CVR_USER_FINDING, new, returning), F.lit(text.CVR_USER_ACTION)),
        ("CVR", "city"): (
            F.format_string(text.CVR_CITY_FINDING, best, high, worst, low),
            F.format_string(text.CVR_CITY_ACTION, best, worst),
        ),
        ("ROAS", "channel"): (
            F.format_string(text.ROAS_CHANNEL_FINDING, segment, best, high, worst, low),
            F.format_string(text.ROAS_CHANNEL_ACTION, segment, worst, segment, best),
        ),
        ("ROAS", "user"): (F.format_string(text.ROAS_USER_FINDING, new, returning), F.lit(text.ROAS_USER_ACTION)),
        ("ROAS", "city"): (
            F.format_string(text.ROAS_CITY_FINDING, best, high, worst, low),
            F.format_string(text.ROAS_CITY_ACTION, worst),
        ),
    }

    def pick(part: int) -> Column:
        cases = [
            F.when((F.col("metric") == metric) & (F.col("segment_kind") == kind), pair[part])
            for (metric, kind), pair in texts.items()
        ]
        return F.coalesce(*cases)

    return top.select("metric", "rank", "segment", "spread", pick(0).alias("finding"), pick(1).alias("action"))


def costliest_waste(wasted: DataFrame) -> DataFrame:
    """The wasted campaign-day with the highest spend."""
    return wasted.orderBy(F.desc_nulls_last("spend"), "date", "campaign_id", "channel").limit(1)


def weakest_segment(channel_device: DataFrame) -> DataFrame:
    """The channel and device with the lowest ROAS."""
    return channel_device.orderBy(F.asc_nulls_last("ROAS"), "channel", "device").limit(1)


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def inefficiencies(wasted: DataFrame, channel_device: DataFrame) -> DataFrame:
    """Two rows: area, description, possible reasons and suggested experiments (arrays of text)."""
    roas, spend = F.col("ROAS"), F.col("spend").cast("double")
    campaign = costliest_waste(wasted).select(
        F.lit(1).alias("area_no"),
        F.format_string(text.CAMPAIGN_AREA, "campaign_id", "channel").alias("area"),
        F.format_string(text.CAMPAIGN_DESCRIPTION, "campaign_id", "channel", spend, roas, roas).alias("description"),
        _texts(text.CAMPAIGN_REASONS).alias("reasons"),
        _texts(text.CAMPAIGN_EXPERIMENTS).alias("experiments"),
    )
    segment = weakest_segment(channel_device).select(
        F.lit(2).alias("area_no"),
        F.format_string(text.SEGMENT_AREA, "channel", "device").alias("area"),
        F.format_string(text.SEGMENT_DESCRIPTION, "channel", "device", roas).alias("description"),
        _texts(text.SEGMENT_REASONS).alias("reasons"),
        _texts(text.SEGMENT_EXPERIMENTS).alias("experiments"),
    )
    return campaign.unionByName(segment)


def inefficiency_lines(table: DataFrame) -> DataFrame:
    """One line per reason and experiment, numbered from 0."""
    kinds = "array(struct('reason' AS kind, reasons AS lines), struct('experiment' AS kind, experiments AS lines))"
    return table.selectExpr("area_no", "area", "description", f"inline({kinds})").selectExpr(
        "area_no", "area", "description", "kind", "posexplode(lines) AS (line_no, line)"
    )
