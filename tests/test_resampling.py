"""Bootstrap intervals and the exact split, against plain versions."""

import hashlib
import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators import regression
from spendlens.operators.regression import CHANNEL_FEATURES, FEATURES, TARGET
from spendlens.plans.catalog import QUERIES, Inputs


def history(n, seed=1, constant=False):
    random_, rows = random.Random(seed), []
    for i in range(n):
        spends = [random_.uniform(10, 90) for _ in CHANNEL_FEATURES]
        row = (date(2024, 1, 1) + timedelta(days=i), sum(spends), i % 7, 0 if constant else int(i % 6 == 0), *spends)
        rows.append((*row, 5 + 2 * spends[0] + spends[1] + 3 * (i % 7) + random_.gauss(0, 4)))
    return rows


def table(spark, rows):
    columns = ["date date", *(f"{f} double" if f not in ("day_of_week", "promo_flag") else f"{f} int" for f in FEATURES), f"{TARGET} double"]
    return spark.createDataFrame(rows, ", ".join(columns))


def drawn(day, replicate):
    u = int(hashlib.md5(f"{day}:{replicate}".encode()).hexdigest()[:8], 16)
    return sum(u >= cut for cut in regression.poisson_cuts())


@pytest.mark.parametrize("constant", [False, True])
def test_replicates_are_weighted_fits(spark, constant):
    rows = history(40, constant=constant)
    made = regression.bootstrap_coefficients(table(spark, rows).repartition(5), replicates=30)
    found = {(r.replicate, r.feature): r.coefficient for r in made.collect()}
    assert len(found) == 30 * len(FEATURES)
    x, y = np.array([r[1:-1] for r in rows], float), np.array([r[-1] for r in rows])
    for replicate in (1, 7, 30):
        w = np.array([drawn(r[0], replicate) for r in rows], float)
        xc, yc = (v - (w @ v) / w.sum() for v in (x, y))
        used = xc.std(0) * (w > 0).any() > 1e-12
        want = np.zeros(len(FEATURES))
        want[used] = np.linalg.pinv(xc[:, used] * np.sqrt(w)[:, None], rcond=1e-9) @ (yc * np.sqrt(w))
        if not constant:
            assert [found[replicate, f] for f in FEATURES] == pytest.approx(want, abs=1e-6)
        else:
            assert found[replicate, "promo_flag"] == pytest.approx(0, abs=1e-9)
    shuffled = regression.bootstrap_coefficients(table(spark, rows[::-1]).repartition(2), replicates=30)
    assert {(r.replicate, r.feature): round(r.coefficient, 8) for r in shuffled.collect()} == {k: round(v, 8) for k, v in found.items()}


def test_counts_are_poisson():
    counts = [drawn(date(2024, 1, 1) + timedelta(days=d), r) for d in range(60) for r in range(200)]
    for k in range(4):
        assert counts.count(k) / len(counts) == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.015)


def test_intervals_hold_the_truth_and_narrow(spark):
    wide, narrow = (regression.coefficient_intervals(regression.fit_ols(t), regression.bootstrap_coefficients(t, 80)) for t in (table(spark, history(40)), table(spark, history(400))))
    wide, narrow = ({r.feature: r for r in x.collect()} for x in (wide, narrow))
    assert narrow["day_of_week"].lower < 3 < narrow["day_of_week"].upper and narrow["day_of_week"].positive_share == 1
    assert all(narrow[f].upper - narrow[f].lower < wide[f].upper - wide[f].lower for f in CHANNEL_FEATURES)
    assert all(r.lower <= r.upper and r.replicates == 80 for r in wide.values())


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 1000])
@pytest.mark.parametrize("share", [0.2, 0.07, 1.0, 0.0])
def test_exact_split(spark, n, share):
    made = regression.with_exact_split(spark.range(n).repartition(3), share, "id", "s")
    test = {r.id for r in made.collect() if r.is_test}
    order = sorted(range(n), key=lambda i: (int(hashlib.md5(f"s:{i}".encode()).hexdigest()[:15], 16), i))
    assert test == set(order[: math.ceil(round(share * n, 9))])


def test_split_is_the_same_however_rows_lie(spark):
    sides = [regression.with_exact_split(spark.range(200).repartition(p), 0.3, "id").where("is_test").agg(F.sort_array(F.collect_set("id"))).first()[0] for p in (1, 9)]
    assert sides[0] == sides[1] and len(sides[0]) == 60


def test_weekly_fit_is_the_shortest_one(spark):
    """Fewer weeks than features: of all fits the one of least norm, and its scores on the test weeks."""
    sf = "/root/testdata/sf0.001"
    daily = Inputs(spark, sf).analysis.channel_daily
    weeks = regression.with_split(regression.regression_table(daily, "week_index"), key="week_index").orderBy("week_index").collect()
    x, y = np.array([[float(w[f]) for f in FEATURES] for w in weeks]), np.array([w[TARGET] for w in weeks])
    test = np.array([w.is_test for w in weeks])
    assert [w.week_index % 5 == 0 for w in weeks] == test.tolist() and 0 < test.sum() < len(test)
    want = np.linalg.pinv(x[~test] - x[~test].mean(0), rcond=1e-9) @ (y[~test] - y[~test].mean())
    found = {r.feature: r.coefficient for r in QUERIES["weekly_coefficients"](spark, sf).collect()}
    assert [found[f] for f in FEATURES] == pytest.approx(want, rel=1e-3, abs=1e-3)
    errors = np.abs(y[test] - (y[~test].mean() + (x[test] - x[~test].mean(0)) @ want))
    scores = QUERIES["weekly_metrics"](spark, sf).first()
    assert scores.n_test == test.sum() and scores.mae == pytest.approx(errors.mean(), rel=1e-3)
