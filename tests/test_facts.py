import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlens.operators import facts, kpis, segments
from spendlens.operators.joins import left_lookup, unique_lookup
from spendlens.session import materialize

D = dt.date
TS = dt.datetime


def as_counter(df):
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def tables(spark):
    sessions = spark.createDataFrame(
        [
            ("s1", "u1", TS(2024, 1, 1, 9), "web", "search", "C1"),
            ("s2", "u1", TS(2024, 1, 2, 9), "web", "search", "C1"),
            ("s3", None, TS(2024, 1, 2, 9), "mobile", None, "C2"),
            ("s4", "u9", TS(2024, 1, 3, 9), "mobile", "email", None),
        ],
        "session_id string, user_id string, session_ts timestamp_ntz, device string, channel string, campaign_id string",
    )
    money = lambda x: None if x is None else Decimal(x)
    orders = spark.createDataFrame(
        [
            ("o1", "s1", TS(2024, 1, 1, 9, 0, 1, 500000), money(12), money(2), money(10), money(10), False),
            ("o2", "s1", TS(2024, 1, 1, 8, 59), money(20), money(0), money(20), money(15), True),
            ("o3", "s3", TS(2024, 1, 2, 9), money(7), money(0), None, None, False),
            ("o4", "gone", TS(2024, 1, 2, 9), money(7), money(0), money(7), money(7), False),
            ("o5", None, TS(2024, 1, 2, 9), money(7), money(0), money(7), money(7), False),
        ],
        "order_id string, session_id string, order_ts timestamp_ntz, gross_amount decimal(18,4), "
        "discount_amount decimal(18,4), net_amount decimal(18,4), net_amount_capped decimal(18,4), "
        "is_revenue_outlier boolean",
    )
    users = spark.createDataFrame([("u1", D(2024, 1, 1), 1), ("u2", D(2024, 1, 3), 2)], "user_id string, signup_date date, city_tier int")
    ad_spend = spark.createDataFrame(
        [
            (D(2024, 1, 1), "C1", "search", money(30), 100, 10, 1),
            (D(2024, 1, 1), "C3", "email", money(5), 0, 0, 0),
            (D(2024, 1, 9), "C4", None, money(8), 10, 1, 0),
        ],
        "date date, campaign_id string, channel string, spend decimal(18,4), impressions bigint, clicks bigint, promo_flag int",
    )
    campaigns = spark.createDataFrame([("C1", "search"), ("C2", "referral"), ("C2", "referral")], "campaign_id string, channel string")
    return {"sessions": sessions, "orders": orders, "users": users, "ad_spend": ad_spend, "campaigns": campaigns}


def test_fact_sessions(spark, tables):
    rows = {(r.session_id, r.order_id): r for r in facts.build_fact_sessions(tables).collect()}
    assert set(rows) == {("s1", "o1"), ("s1", "o2"), ("s2", None), ("s3", "o3"), ("s4", None)}
    assert rows["s1", "o1"].session_to_order_sec == 1.5 and rows["s1", "o2"].session_to_order_sec == -60.0
    assert rows["s1", "o1"].is_new_user and not rows["s2", None].is_new_user and not rows["s3", "o3"].is_new_user
    assert rows["s3", "o3"].purchase_flag == 1 and rows["s3", "o3"].net_amount_capped == 0
    assert rows["s2", None].purchase_flag == 0 and rows["s2", None].gross_amount == 0
    assert rows["s2", None].is_revenue_outlier is False and rows["s2", None].session_to_order_sec is None


def test_fact_campaign_daily(tables):
    fact = facts.build_fact_campaign_daily(tables, facts.build_fact_sessions(tables))
    rows = {(r.date, r.campaign_id): r for r in fact.collect()}
    assert set(rows) == {
        (D(2024, 1, 1), "C1"), (D(2024, 1, 1), "C3"), (D(2024, 1, 9), "C4"), (D(2024, 1, 2), "C1"), (D(2024, 1, 2), "C2"),
    }
    first = rows[D(2024, 1, 1), "C1"]
    assert (first.attributed_sessions, first.attributed_orders, first.attributed_revenue) == (2, 2, 25)
    assert (first.cpc, first.ctr, first.cvr, first.cac_proxy) == (3.0, 0.1, 1.0, 15.0)
    assert first.roas == pytest.approx(25 / 30)
    assert rows[D(2024, 1, 2), "C2"].channel == "referral" and rows[D(2024, 1, 2), "C2"].roas == 0.0
    assert rows[D(2024, 1, 1), "C3"].cac_proxy is None and rows[D(2024, 1, 1), "C3"].ctr == 0.0
    assert rows[D(2024, 1, 9), "C4"].channel is None
    distinct = facts.sessions_by_campaign_day(facts.build_fact_sessions(tables), count_rows=False)
    assert {r.date: r.attributed_sessions for r in distinct.where("campaign_id = 'C1'").collect()}[D(2024, 1, 1)] == 1


def test_fact_channel_daily(tables):
    campaigns = materialize(facts.build_fact_campaign_daily(tables, facts.build_fact_sessions(tables)), "test")
    rows = {(r.date, r.channel): r for r in facts.build_fact_channel_daily(tables, campaigns).collect()}
    assert set(rows) == {
        (D(2024, 1, 1), "search"), (D(2024, 1, 1), "email"), (D(2024, 1, 2), "search"), (D(2024, 1, 2), "referral"),
    }
    monday = rows[D(2024, 1, 1), "search"]
    assert (monday.day_of_week, monday.promo_flag, monday.week_index) == (0, 1, 0)
    assert rows[D(2024, 1, 2), "referral"].promo_flag == 0
    # Revenue per channel and per campaign agree as far as the channel is known.
    by_campaign = campaigns.where("channel IS NOT NULL").agg(F.sum("attributed_revenue")).first()[0]
    assert sum(r.attributed_revenue for r in rows.values()) == by_campaign


def test_crowded_sessions_join_like_all_others(spark):
    sessions = spark.range(20).selectExpr("CAST(id AS STRING) AS session_id", "id AS payload")
    # Session 3 holds most orders; session 7 is just over the limit; some ids are unknown or missing.
    orders = spark.range(400).selectExpr(
        "IF(id % 17 = 0, NULL, CASE WHEN id < 300 THEN '3' WHEN id < 320 THEN '7' ELSE CAST(id % 40 AS STRING) END) AS session_id",
        "id AS order_id",
    )
    plain = sessions.join(orders, "session_id", "left")
    assert as_counter(facts.attach_orders(sessions, orders, piece_size=10)) == as_counter(plain)
    assert as_counter(facts.attach_orders(sessions, orders)) == as_counter(plain)


def test_the_order_join_runs_nothing_while_it_is_built(spark):
    sessions = spark.range(20).selectExpr("CAST(id AS STRING) AS session_id", "id AS payload")
    orders = spark.range(400).selectExpr("'3' AS session_id", "id AS order_id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("order-join", "built only")
    joined = facts.attach_orders(sessions, orders, piece_size=10)
    assert len(tracker.getJobIdsForGroup("order-join")) == 0
    assert joined.count() == 419
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_unique_lookup_takes_values_before_nulls(spark):
    rows = spark.createDataFrame(
        [(1, None, 2), (1, "b", None), (1, "b", 3), (2, None, None), (3, "a", 1), (3, "a", 1)], "k int, x string, y int"
    )
    got = {tuple(r) for r in unique_lookup(rows, ["k"], ["x", "y"]).collect()}
    assert got == {(1, "b", 3), (2, None, None), (3, "a", 1)}


def test_left_lookup_equals_left_join_and_spreads_missing_keys(spark):
    left = spark.range(500).selectExpr("id", "IF(id % 3 = 0, NULL, id % 7) AS key")
    right = spark.range(5).selectExpr("id AS key", "id * 10 AS value").unionByName(
        spark.createDataFrame([(None, 99)], "key bigint, value bigint")
    )
    joined = left_lookup(left, right, ["key"], spread_by=["id"])
    assert as_counter(joined) == as_counter(left.join(right, "key", "left"))
    assert joined.columns == ["key", "id", "value"]


def test_campaign_variant_repeats_spend_per_session_channel(spark, tables):
    sessions = facts.build_fact_sessions(tables)
    extra = sessions.where("session_id = 's1' AND order_id = 'o1'").withColumns(
        {"channel": F.lit("email"), "session_id": F.lit("s9")}
    )
    rows = kpis.campaign_daily(sessions.unionByName(extra), tables["ad_spend"]).where("date = '2024-01-01'").collect()
    assert [(r.campaign_id, r.channel, r.spend) for r in rows] == [("C1", "search", 30)] * 2
    assert all(r.CAC == 15 or r.CAC == 30 for r in rows)


def test_top_n_breaks_ties_by_date_and_campaign(spark):
    rows = [(D(2024, 1, d), c, "search", Decimal(5)) for d in (3, 1, 2) for c in ("C2", "C1")]
    df = spark.createDataFrame(rows, "date date, campaign_id string, channel string, spend decimal(18,4)").repartition(4)
    top = [(r.date.day, r.campaign_id) for r in kpis.top_campaign_days(df, "spend", 3).collect()]
    assert top == [(1, "C1"), (1, "C2"), (2, "C1")]


def test_allotted_spend_adds_up(tables):
    sessions = materialize(facts.build_fact_sessions(tables), "test")
    per_row = segments.sessions_with_spend(sessions, tables["ad_spend"])
    assert per_row.count() == 5
    paid = {r.campaign_id: r[1] for r in per_row.groupBy("campaign_id").sum("spend_per_session").collect()}
    assert paid["C1"] == pytest.approx(30) and paid[None] == 0 and paid["C2"] == 0
    cells = segments.segment_cells(sessions, tables["ad_spend"], ["device", "is_new_user"])
    totals = cells.agg(F.sum("sessions"), F.sum("spend")).first()
    assert totals[0] == 5 and totals[1] == pytest.approx(30)


def test_empty_inputs_give_empty_results(tables):
    none = {name: df.limit(0) for name, df in tables.items()}
    sessions = facts.build_fact_sessions(none)
    assert sessions.count() == 0
    assert facts.build_fact_campaign_daily(none, sessions).count() == 0
    assert kpis.channel_roas(kpis.channel_daily(kpis.campaign_daily(sessions, none["ad_spend"]), none["ad_spend"])).count() == 0


def test_unread_user_columns_cost_no_join(tables):
    plan = kpis.campaign_daily(facts.build_fact_sessions(tables), tables["ad_spend"])._jdf.queryExecution()
    assert "signup_date" not in plan.optimizedPlan().toString()


def test_hot_user_is_split_by_adaptive_execution(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    left = spark.range(0, 200_000, numPartitions=8).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS user_id"
    )
    right = unique_lookup(spark.range(50_000).selectExpr("id AS user_id", "id % 3 AS city_tier"), ["user_id"], ["city_tier"])
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = left_lookup(left, right, ["user_id"], spread_by=["id"])
        rows = joined.selectExpr("count(1) AS n", "count(city_tier) AS known")
        result = joined.collect()
        final = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert "SortMergeJoin(skew=true)" in final
    assert len(result) == 200_000
    assert sum(r.city_tier is not None for r in result) == rows.first().known


def test_repeated_lookup_keys_do_not_multiply_rows(spark):
    users = spark.createDataFrame([(1, D(2024, 1, 5), 2), (1, D(2024, 1, 1), 3)], "user_id int, signup_date date, city_tier int")
    row = unique_lookup(users, ["user_id"], ["signup_date", "city_tier"]).collect()
    assert [(r.signup_date, r.city_tier) for r in row] == [(D(2024, 1, 1), 3)]
