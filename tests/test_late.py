"""Facts after late files equal the facts of one batch, whatever breaks in between."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from spendlens.operators.facts import build_fact_sessions
from spendlens.operators.cleaning import cap_outliers, clean_sessions, deduplicate, flag_outliers
from spendlens.streaming import late
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "sessions": T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("session_id", "string"), ("user_id", "string"), ("session_ts", "timestamp_ntz"), ("device", "string"), ("channel", "string"), ("campaign_id", "string"), ("ingest_seq", "long"))]}),
    "orders": T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("order_id", "string"), ("session_id", "string"), ("order_ts", "timestamp_ntz"), ("gross_amount", "decimal(18,4)"), ("discount_amount", "decimal(18,4)"), ("net_amount", "decimal(18,4)"), ("ingest_seq", "long"))]}),
}
FENCE = 50.0


def rows(seed):
    random_, sessions, orders = random.Random(seed), [], []
    start = datetime(2024, 1, 1)
    for i in range(120):
        ts = start + timedelta(minutes=random_.randrange(60 * 24 * 12))
        places = random_.sample([10 * i, 10 * i + 1], 2)  # either copy may be the first
        for copy in range(random_.choice([1, 1, 2])):  # a copy may be of the day before
            sessions.append((f"s{i}", random_.choice(["u1", "u2", None]), ts - timedelta(days=copy * random_.choice([0, 1])), f"d{copy}", " Email", "C1", places[copy]))
        for k in range(random_.choice([0, 1, 2])):
            order = (f"o{i}-{k}", f"s{i}", ts + timedelta(hours=random_.choice([0, 5, 30])), Decimal(9), Decimal(1), Decimal(random_.choice([8, 80])))
            orders += [(*order, 1000 + 10 * i + k)] + [(*order, 5000 + i)] * random_.choice([0, 1])
    return sessions, orders


def batch(spark, data, users):
    sessions, orders = (spark.createDataFrame(d, SCHEMAS[n]) for n, d in zip(SCHEMAS, data, strict=True))
    fence = F.lit(FENCE).cast("decimal(18,4)")
    kept = deduplicate(orders, ["order_id"])
    capped = cap_outliers(flag_outliers(kept, "net_amount", fence), "net_amount", fence)
    return build_fact_sessions({"sessions": clean_sessions(sessions), "orders": capped, "users": users})


def land(spark, config, data):
    for name, part in zip(SCHEMAS, data, strict=True):
        spark.createDataFrame(part, SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{config.landing}/{name}")


def fact(spark, config, like):
    return sorted(map(str, spark.read.schema(like.schema).parquet(config.fact).select(like.columns).collect()))


@pytest.fixture
def users(spark):
    return spark.createDataFrame([("u1", date(2024, 1, 3))], "user_id string, signup_date date")


def test_three_drops_in_any_order(spark, tmp_path, users):
    data, random_ = rows(1), random.Random(2)
    config = late.LateConfig(str(tmp_path / "in"), str(tmp_path / "out"), FENCE)
    drops = [([], []) for _ in range(3)]
    for kind, part in enumerate(data):
        for row in part:
            random_.choice(drops)[kind].append(row)
    seen = ([], [])
    for drop in drops:
        land(spark, config, drop)
        for kind in range(2):
            seen[kind].extend(drop[kind])
        late.catch_up(spark, config, SCHEMAS, users)
        want = batch(spark, seen, users)
        assert fact(spark, config, want) == sorted(map(str, want.collect()))
    assert late.catch_up(spark, config, SCHEMAS, users) == []


def test_a_run_that_breaks_off_is_made_good(spark, tmp_path, users, monkeypatch):
    data = rows(3)
    config = late.LateConfig(str(tmp_path / "in"), str(tmp_path / "out"), FENCE)
    land(spark, config, (data[0][:80], data[1][:50]))
    late.ingest(spark, config, SCHEMAS)  # and then the run ends
    land(spark, config, (data[0][80:], data[1][50:]))
    with monkeypatch.context() as broken:
        broken.setattr(late, "build_fact_sessions", lambda tables: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            late.catch_up(spark, config, SCHEMAS, users)
    late.catch_up(spark, config, SCHEMAS, users)
    want = batch(spark, data, users)
    assert fact(spark, config, want) == sorted(map(str, want.collect()))


def test_only_touched_dates_are_built(spark, tmp_path, users):
    config = late.LateConfig(str(tmp_path / "in"), str(tmp_path / "out"), FENCE)
    days = [datetime(2024, 1, d, 12) for d in (1, 5, 9)]
    land(spark, config, ([(f"s{i}", "u1", d, "web", "email", "C1", i) for i, d in enumerate(days)], []))
    assert late.catch_up(spark, config, SCHEMAS, users) == [d.date() for d in days]
    land(spark, config, ([], [("o", "s1", days[1] + timedelta(hours=30), Decimal(9), Decimal(0), Decimal(9), 1)]))
    assert late.catch_up(spark, config, SCHEMAS, users) == [days[1].date()]
    assert spark.read.parquet(config.fact).where("purchase_flag = 1").count() == 1
