from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.functions.columns import missing_to_null, parse
from spendlens.operators import cleaning
from spendlens.operators.quantiles import exact_quantiles


def test_channel_names(spark):
    rows = [("Search",), ("\tPAID_SOCIAL\n",), (" email ",), ("Referral ",), ("organic",), ("tv",), ("",), (None,)]
    df = spark.createDataFrame(rows, "channel string")
    assert [r[0] for r in cleaning.normalize_channel(df).collect()] == [
        "search", "paid_social", "email", "referral", "organic", None, None, None,
    ]
    assert [r[0] for r in cleaning.normalize_channel(df, "unknown").collect()][5:] == ["unknown"] * 3


def test_dedup_keeps_first_row_and_one_null_key(spark):
    rows = [(1, "late", 5), (1, "early", 2), (None, "b", 4), (None, "a", 3), (2, "only", 1)]
    df = spark.createDataFrame(rows, "key int, payload string, ingest_seq int")
    kept = {(r.key, r.payload) for r in cleaning.deduplicate(df, ["key"]).collect()}
    assert kept == {(1, "early"), (None, "a"), (2, "only")}


def test_dedup_cuts_hot_keys_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS key", "id AS ingest_seq")
    plan = cleaning.deduplicate(df, ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange hashpartitioning")[1]


@pytest.mark.parametrize("seed", range(6))
def test_quantiles_equal_linear_interpolation(spark, seed):
    rng = np.random.default_rng(seed)
    n = [1, 2, 3, 500, 4001, 20000][seed]
    values = np.round(rng.lognormal(3, 2, n) * rng.choice([-1, 1, 1, 1], n), 2)
    values[: n // 3] = values[0]  # one value holds a third of the rows
    df = spark.createDataFrame(pd.DataFrame({"x": values})).unionByName(
        spark.range(5).select(F.lit(None).cast("double").alias("x"))
    )
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.99, "f": 1.0}
    row = exact_quantiles(df.repartition(4), "x", wanted).first()
    for name, p in wanted.items():
        assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9), (name, p)


def test_quantiles_of_nothing_are_null(spark):
    row = exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", {"q1": 0.25, "q3": 0.75}).first()
    assert (row.q1, row.q3) == (None, None)


def test_outliers_flagged_and_capped_with_nulls_kept(spark):
    amounts = [10, 11, 12, 13, 14, 15, 16, 17, 500, None]
    df = spark.createDataFrame([(i, Decimal(a) if a else None) for i, a in enumerate(amounts)], "id int, net_amount decimal(18,4)")
    rows = {r.id: r for r in cleaning.flag_and_cap_outliers(df).collect()}
    q1, q3 = np.quantile([a for a in amounts if a], [0.25, 0.75])
    fence = q3 + 3 * (q3 - q1)
    assert rows[8].is_revenue_outlier and float(rows[8].net_amount_capped) == fence and rows[8].net_amount == 500
    assert not rows[9].is_revenue_outlier and rows[9].net_amount_capped is None
    assert [float(rows[i].net_amount_capped) for i in range(8)] == amounts[:8]


def test_no_outlier_flag_without_any_amount(spark):
    df = spark.createDataFrame([(1, None)], "id int, net_amount decimal(18,4)")
    row = cleaning.flag_and_cap_outliers(df).first()
    assert (row.is_revenue_outlier, row.net_amount_capped) == (False, None)


def test_fence_comes_from_deduplicated_orders(spark):
    once = [(i, Decimal(10 + i), i) for i in range(8)] + [(99, Decimal(60), 99)]
    copies = [(99, Decimal(60), 1000 + i) for i in range(50)]
    df = spark.createDataFrame(once + copies, "order_id int, net_amount decimal(18,4), ingest_seq int")
    rows = {r.order_id: r for r in cleaning.clean_orders(df).collect()}
    assert len(rows) == 9 and rows[99].is_revenue_outlier


def test_missing_tokens_and_parsing(spark):
    df = spark.createDataFrame([("NA",), ("",), ("2024-01-05",), ("x",), (None,)], "t string")
    values = df.select(parse(missing_to_null("t"), "date", strict=False).cast("string")).collect()
    assert [v[0] for v in values] == [None, None, "2024-01-05", None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(parse(missing_to_null("t"), "date")).collect()
