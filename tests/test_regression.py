import numpy as np
import pandas as pd
import pytest

from spendlens.config import CHANNELS
from spendlens.operators import regression as r


def history(spark, days=60, promo=None, dead_channel=None, seed=0):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame({f"spend_{c}": rng.uniform(10, 90, days) for c in CHANNELS})
    if dead_channel:
        data[f"spend_{dead_channel}"] = 0.0
    data["total_spend"] = data.sum(axis=1)
    data["day_of_week"] = np.arange(days) % 7
    data["promo_flag"] = rng.integers(0, 2, days) if promo is None else promo
    data["daily_revenue"] = 100 + 3 * data.spend_email - data.spend_search + 40 * data.promo_flag + rng.normal(0, 5, days)
    data["date"] = pd.date_range("2024-01-01", periods=days).date
    return data, r.with_split(spark.createDataFrame(data))


def minimum_norm(data):
    x = data[list(r.FEATURES)].to_numpy(float)
    y = data.daily_revenue.to_numpy()
    weights = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-10)[0]
    return y.mean() - x.mean(0) @ weights, weights


@pytest.mark.parametrize("case", [{}, {"promo": 1}, {"dead_channel": "referral"}])
def test_fit_is_the_minimum_norm_solution(spark, case):
    data, table = history(spark, **case)
    fit = r.fit_ols(table)
    intercept, weights = minimum_norm(data)
    assert fit.intercept == pytest.approx(intercept, abs=1e-6)
    assert [fit.coefficients[f] for f in r.FEATURES] == pytest.approx(weights, abs=1e-6)
    assert fit.coefficients["total_spend"] == pytest.approx(sum(fit.coefficients[f"spend_{c}"] for c in CHANNELS))


def test_any_collinear_columns_give_the_minimum_norm(spark):
    data, _ = history(spark)
    data["spend_organic"] = 2 * data.spend_email
    data["total_spend"] = data[[f"spend_{c}" for c in CHANNELS]].sum(axis=1)
    data["promo_flag"] = (data.day_of_week == 6).astype(int)
    data["day_of_week"] = 1 + 3 * data.promo_flag
    fit = r.fit_ols(r.with_split(spark.createDataFrame(data)))
    intercept, weights = minimum_norm(data)
    assert fit.intercept == pytest.approx(intercept, abs=1e-6)
    assert [fit.coefficients[f] for f in r.FEATURES] == pytest.approx(weights, abs=1e-6)


def test_scores_on_the_held_out_days(spark):
    data, table = history(spark)
    data["is_test"] = [(d - pd.Timestamp("1970-01-01").date()).days % 5 == 0 for d in data.date]
    train, test = data[~data.is_test], data[data.is_test]
    intercept, weights = minimum_norm(train)
    predicted = intercept + test[list(r.FEATURES)].to_numpy(float) @ weights
    error = test.daily_revenue - predicted
    scores = r.regression_metrics(table, r.fit_ols(table.where("NOT is_test"))).first()
    assert scores.n_test == len(test) == 12
    assert scores.r2 == pytest.approx(1 - (error**2).sum() / ((test.daily_revenue - test.daily_revenue.mean()) ** 2).sum())
    assert scores.mae == pytest.approx(error.abs().mean())
    assert scores.mape == pytest.approx((error / test.daily_revenue).abs().mean() * 100)


def test_training_residuals_add_up_to_zero(spark):
    _, table = history(spark)
    train = table.where("NOT is_test")
    fit = r.fit_ols(train)
    row = train.withColumn("e", train.daily_revenue - fit.prediction()).selectExpr("sum(e) AS e").first()
    assert row.e == pytest.approx(0, abs=1e-6)


def test_mape_is_null_without_revenue_days(spark):
    _, table = history(spark)
    zero = table.drop("daily_revenue").selectExpr("*", "0.0D AS daily_revenue")
    row = r.regression_metrics(zero, r.fit_ols(table)).first()
    assert row.mape is None and row.r2 is None and row.mae > 0


def test_nothing_to_fit(spark):
    _, table = history(spark)
    fit = r.fit_ols(table.limit(0))
    assert fit.intercept is None and set(fit.coefficients.values()) == {None}
    assert table.select(fit.prediction().alias("p")).first().p is None


def test_one_day_predicts_its_own_revenue(spark):
    data, table = history(spark, days=1)
    fit = r.fit_ols(table)
    assert fit.intercept == pytest.approx(data.daily_revenue[0]) and set(fit.coefficients.values()) == {0.0}


def test_weekly_table(spark):
    rows = [(0, "email", 10, 5, 0, 0), (0, "search", 20, 7, 6, 1), (1, "email", 1, 2, 3, 0)]
    df = spark.createDataFrame(rows, "week_index int, channel string, attributed_revenue int, spend int, day_of_week int, promo_flag int")
    weeks = {w.week_index: w for w in r.regression_table(df, "week_index").collect()}
    assert (weeks[0].daily_revenue, weeks[0].total_spend, weeks[0].spend_email, weeks[0].spend_organic) == (30, 12, 5, 0)
    assert (weeks[0].day_of_week, weeks[0].promo_flag, weeks[1].spend_search) == (6, 1, 0)
