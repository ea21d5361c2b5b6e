"""Distinct counts from stored bitmaps and sketches."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from spendlens.operators import distinct
from spendlens.session import materialize

FACT = "session_id long, user_id long, session_date date, campaign_id string, purchase_flag int, gross_amount decimal(18,4)"


def rows(n=4000, seed=3):
    random_, out = random.Random(seed), []
    for i in range(n):
        session = random_.choice([i, i, i - 1, 40_000_000_000 + i])  # some twice, some far away
        user = random_.choice([None, 7, random_.randrange(900), -random_.randrange(1, 50)])
        day = random_.choice([None, *[date(2024, 1, 1) + timedelta(days=d) for d in range(20)]])
        out.append((session, user, day, random_.choice([None, "A", "B", "C"]), random_.randrange(2), random_.randrange(1000)))
    return out


def facts(spark, data):
    return spark.createDataFrame(data, FACT.replace("decimal(18,4)", "int")).withColumn("gross_amount", F.col("gross_amount").cast("decimal(18,4)"))


def counts(data):
    return len({r[0] for r in data}), len({r[1] for r in data} - {None}), len({r[1] for r in data if r[4]} - {None})


def test_bitmaps_roll_up(spark):
    data = rows()
    home = spark.createDataFrame([("A", "email"), ("B", "search"), ("B", "search")], "campaign_id string, channel string")
    stored = materialize(distinct.session_bitmaps(facts(spark, data).repartition(6), home), "bitmaps")
    dated = [r for r in data if r[2]]
    assert tuple(distinct.distinct_counts(stored, {}).first()) == counts(dated)
    by_channel = {r[0]: tuple(r)[1:] for r in distinct.distinct_counts(stored, {"channel": F.col("channel")}).collect()}
    homes = {"A": "email", "B": "search"}
    assert by_channel == {c: counts([r for r in dated if homes.get(r[3]) == c]) for c in ("email", "search", None)}
    by_day = {r[0]: tuple(r)[1:] for r in distinct.distinct_counts(stored, {"date": F.col("date")}).collect()}
    assert by_day == {d: counts([r for r in dated if r[2] == d]) for d in {r[2] for r in dated}}


def test_sketches_merge(spark):
    data = rows(20_000)
    stored = materialize(distinct.daily_sketches(facts(spark, data)), "sketches")
    merged = distinct.merged_sketches(stored, {}).first()
    dated = [r for r in data if r[2]]
    values = sorted(r[5] for r in dated if r[4])
    assert abs(merged.users / counts(dated)[1] - 1) < 0.05 and merged.orders == len(values)
    for q, share in ((merged.q50, 0.5), (merged.q90, 0.9)):
        assert sum(v < q for v in values) / len(values) < share + distinct.RANK_ERROR
        assert sum(v <= q for v in values) / len(values) > share - distinct.RANK_ERROR


def test_empty_facts(spark):
    none = facts(spark, [])
    assert distinct.distinct_counts(distinct.session_bitmaps(none, spark.createDataFrame([], "campaign_id string, channel string")), {"channel": F.col("channel")}).count() == 0
    assert distinct.merged_sketches(distinct.daily_sketches(none), {"date": F.col("date")}).count() == 0


def test_a_day_without_orders_has_no_quantiles(spark):
    made = distinct.merged_sketches(distinct.daily_sketches(facts(spark, [(1, 2, date(2024, 1, 1), "A", 0, 5)])), {}).first()
    assert (made.users, made.orders, made.q50) == (1, 0, None)
