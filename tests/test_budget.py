import datetime as dt
from decimal import Decimal

import random

import numpy as np
import pytest

from spendlens.config import CHANNELS, BoundsScenario, BudgetConfig, ChannelBounds, ShareScenario
from spendlens.operators import budget
from spendlens.operators.regression import FEATURES, OlsFit

# Published figures: all-time ROAS per channel, and regression weights per channel.
PUBLISHED_ROAS = {"organic": 13.82, "email": 5.25, "referral": 1.33, "search": 1.31, "paid_social": 0.73}
PUBLISHED_WEIGHTS = {"organic": 7.37, "email": 0.46, "referral": -1.16, "paid_social": -1.97, "search": -2.06}


def metrics(spark, roas):
    return spark.createDataFrame([(c, v, 2.0) for c, v in roas.items()], "channel string, roas double, margin_per_dollar double")


def by_channel(rows, scenario="base"):
    return {r.channel: r for r in rows if r.scenario_id == scenario}


def share_by_rounds(roas, total, low, high):
    """Plain loop over the sharing rule for one scenario."""
    n = len(roas)
    floor, cap = min(total * low, total / n), total * high
    if roas.sum() <= 0:
        return np.full(n, total / n)
    alloc, rest = np.full(n, floor), total - n * floor
    for _ in range(200):
        room = np.maximum(0, cap - alloc)
        pull = roas * room
        if rest <= 1e-6 or pull.sum() <= 0:
            break
        step = np.minimum(rest * pull / pull.sum(), room)
        alloc, rest = alloc + step, rest - step.sum()
    return np.minimum(np.maximum(alloc, floor), cap)


def test_share_allocation_of_published_roas(spark):
    rows = by_channel(budget.allocate_by_share(metrics(spark, PUBLISHED_ROAS)).collect())
    assert rows["organic"].allocated_spend == pytest.approx(4_500_000)
    expected = {"email": 2_559_654, "referral": 1_066_861, "search": 1_058_563, "paid_social": 814_922}
    for channel, spend in expected.items():
        assert rows[channel].allocated_spend == pytest.approx(spend, abs=1)
    assert sum(r.allocated_spend for r in rows.values()) == pytest.approx(10_000_000)
    assert rows["email"].allocated_pct == pytest.approx(0.2559654, abs=1e-6)


def test_share_allocation_equals_the_loop(spark):
    rng = np.random.default_rng(7)
    scenarios = []
    for i in range(40):
        low = rng.choice([0.0, 0.05, 0.1, 0.3])
        scenarios.append(ShareScenario(f"s{i}", float(rng.uniform(1e3, 1e7)), float(low), float(low + rng.uniform(0.05, 0.6))))
    for case in range(4):
        roas = rng.lognormal(0, 2, 5) * (rng.random(5) < 0.7)
        if case == 3:
            roas[:] = 0
        rows = budget.allocate_by_share(metrics(spark, dict(zip(CHANNELS, map(float, roas)))), tuple(scenarios)).collect()
        for s in scenarios:
            found = by_channel(rows, s.scenario_id)
            want = share_by_rounds(roas, s.budget_total, s.min_pct, s.max_pct)
            got = [found[c].allocated_spend for c in CHANNELS]
            assert got == pytest.approx(want, rel=1e-9, abs=1e-3)
            assert found["email"].unallocated == pytest.approx(s.budget_total - want.sum(), abs=1e-2)


@pytest.mark.parametrize("n", [1, 9, 30])
def test_share_allocation_takes_as_many_rounds_as_there_are_channels(spark, n):
    roas = {f"channel {i}": float(4.0**-i) for i in range(n)}
    scenario = (ShareScenario("base", 100.0, 0.0, 1.08 / n),)
    rows = by_channel(budget.allocate_by_share(metrics(spark, roas), scenario).collect())
    want = share_by_rounds(np.array(list(roas.values())), 100.0, 0.0, 1.08 / n)
    assert [rows[c].allocated_spend for c in roas] == pytest.approx(list(want), rel=1e-9, abs=1e-3)
    assert rows["channel 0"].unallocated == pytest.approx(0, abs=1e-2)


def test_budget_beyond_the_caps_stays_unallocated_or_is_rescaled(spark):
    tight = (ShareScenario("base", 100.0, 0.05, 0.1),)
    kept = budget.allocate_by_share(metrics(spark, PUBLISHED_ROAS), tight).collect()
    assert {round(r.allocated_spend, 6) for r in kept} == {10.0} and kept[0].unallocated == pytest.approx(50)
    spread = budget.allocate_by_share(metrics(spark, PUBLISHED_ROAS), tight, rescale=True).collect()
    assert sum(r.allocated_spend for r in spread) == pytest.approx(100)


def test_positive_channels_full_leaves_the_rest(spark):
    roas = dict.fromkeys(CHANNELS, 0.0) | {"email": 2.0}
    rows = by_channel(budget.allocate_by_share(metrics(spark, roas)).collect())
    assert rows["email"].allocated_spend == pytest.approx(4_500_000) and rows["search"].allocated_spend == 500_000
    assert rows["email"].unallocated == pytest.approx(3_500_000)


def test_impact_and_sensitivity(spark):
    allocation = budget.allocate_by_share(metrics(spark, PUBLISHED_ROAS))
    impact = budget.impact_estimates(allocation)
    totals = budget.impact_totals(impact).first()
    assert totals.best_revenue / totals.base_revenue == pytest.approx(1.2)
    assert totals.worst_margin / totals.base_margin == pytest.approx(0.8)
    assert totals.base_margin == pytest.approx(20_000_000)
    grid = {(g.roas_change_pct, g.budget_change_pct): g.estimated_revenue for g in budget.sensitivity(allocation).collect()}
    assert len(grid) == 9
    for (r, b), revenue in grid.items():
        assert revenue == pytest.approx(totals.base_revenue * (1 + r / 100) * (1 + b / 100))


def weights_frame(spark, weights):
    return spark.createDataFrame(list(weights.items()), "channel string, regression_coefficient double")


def test_bounds_allocation_of_published_weights(spark):
    allocation = budget.allocate_by_bounds(weights_frame(spark, PUBLISHED_WEIGHTS))
    got = {r.channel: r.allocated_spend / 1e6 for r in allocation.collect()}
    assert got == {"email": 5.0, "organic": 1.5, "paid_social": 5.0, "referral": 1.0, "search": 10.0}
    totals = budget.allocation_totals(allocation).first()
    assert (totals.allocated, totals.left_over, totals.infeasible) == (22_500_000, 17_500_000, False)


def water_fill(weights, low, high, total):
    alloc, rest = low.copy(), total - low.sum()
    for _ in range(100):
        room = np.where(weights > 0, high - alloc, 0)
        pull = np.where(room > 1e-9, weights, 0)
        if rest <= 1e-9 or pull.sum() <= 0:
            break
        step = np.minimum(rest * pull / pull.sum(), room)
        alloc, rest = alloc + step, rest - step.sum()
    return alloc


def test_bounds_allocation_equals_rounds_of_sharing(spark):
    rng = np.random.default_rng(3)
    scenarios, want = [], {}
    weights = np.array([0.5, 2.0, -1.0, 0.5, 0.0])
    for i in range(40):
        low = rng.uniform(0, 10, 5).round(2)
        high = low + rng.uniform(0, 30, 5).round(2) * (rng.random(5) < 0.8)
        total = round(float(rng.uniform(0, 120)), 2)
        bounds = tuple(ChannelBounds(c, float(a), float(b)) for c, a, b in zip(CHANNELS, low, high))
        scenarios.append(BoundsScenario(f"s{i}", total, bounds))
        want[f"s{i}"] = (water_fill(weights, low, high, total), low, high, total)
    rows = budget.allocate_by_bounds(weights_frame(spark, dict(zip(CHANNELS, map(float, weights)))), tuple(scenarios)).collect()
    for name, (expected, low, high, total) in want.items():
        found = by_channel(rows, name)
        got = np.array([found[c].allocated_spend for c in CHANNELS])
        assert got == pytest.approx(expected, abs=0.011)
        assert (got >= low - 0.006).all() and (got <= high + 0.006).all()
        assert found["email"].infeasible == (low.sum() > total)


def test_channels_without_weight_keep_their_minimum(spark):
    rows = by_channel(budget.allocate_by_bounds(weights_frame(spark, {"email": None, "organic": 1.0})).collect())
    assert rows["email"].allocated_spend == 500_000 and rows["search"].allocated_spend == 10_000_000
    assert rows["organic"].allocated_spend == 1_500_000


def daily(spark):
    rows = [(0, 1, 100.0), (1, 0, 200.0)]
    zero = ", ".join(f"0.0D AS spend_{c}" for c in CHANNELS)
    return spark.createDataFrame(rows, "day_of_week int, promo_flag int, total_spend double").selectExpr("*", zero.split(", ")[0], *zero.split(", ")[1:])


def test_revenue_impact(spark):
    fit = OlsFit(10.0, dict.fromkeys(FEATURES, 0.0) | {"total_spend": 2.0, "day_of_week": 4.0, "spend_email": 1.0})
    allocation = spark.createDataFrame([("base", "email", 30.0), ("base", "search", 60.0)], "scenario_id string, channel string, allocated_spend double")
    row = budget.revenue_impact(daily(spark), fit, allocation).first()
    # Two days: 10 + 2 x 100 and 10 + 2 x 200 + 4. Plan per day: 90 / 30 in all, 30 / 30 of it email.
    assert row.baseline_revenue == pytest.approx(624) and row.new_revenue == pytest.approx(2 * (10 + 4 * 0.5 + 2 * 3 + 1))
    assert row.increase < 0 and row.best_increase == pytest.approx(row.increase * 0.9) and row.worst_increase == pytest.approx(row.increase * 1.1)
    whole = budget.revenue_impact(daily(spark), fit, allocation, BudgetConfig(horizon_days=None), parity=True).first()
    assert whole.new_revenue == pytest.approx(2 * (10 + 2 + 2 * 45 + 15)) and whole.best_increase == pytest.approx(whole.increase * 1.1)


def test_margin_over_lookback_and_all_time(spark):
    d = dt.date
    fact = spark.createDataFrame(
        [
            ("s1", "o1", "email", d(2024, 1, 1), dt.datetime(2024, 1, 1), 1),
            ("s0", "o1", "search", d(2024, 1, 2), dt.datetime(2024, 1, 2), 1),
            ("s2", "o2", "email", d(2024, 1, 31), dt.datetime(2024, 1, 31), 1),
            ("s3", "o3", None, d(2024, 1, 31), dt.datetime(2024, 1, 31), 1),
            ("s4", "o4", "organic", d(2024, 1, 31), dt.datetime(2024, 1, 31), 1),
            ("s5", None, "email", d(2024, 1, 31), dt.datetime(2024, 1, 31), 0),
        ],
        "session_id string, order_id string, channel string, session_date date, session_ts timestamp_ntz, purchase_flag int",
    )
    items = spark.createDataFrame([("o1", "p1", 2, 5.0), ("o2", "p1", 1, 9.0), ("o2", "px", 1, 100.0), ("o3", "p1", 1, 1.0)], "order_id string, product_id string, quantity int, unit_price double")
    products = spark.createDataFrame([("p1", "Home", 3.0)], "product_id string, category string, cost double")
    margins = budget.order_margin(items, products)
    assert {r.order_id: float(r.margin) for r in margins.collect()} == {"o1": 4.0, "o2": 6.0, "o3": -2.0}
    owners = budget.order_channels(fact)
    every = {r.channel: float(r.attributed_margin) for r in budget.margin_by_channel(owners, margins).collect()}
    assert every == {"email": 10.0, "organic": 0.0}
    channel_days = spark.createDataFrame(
        [(d(2024, 1, 31), "email", Decimal(3), Decimal(12), 1), (d(2024, 1, 21), "search", Decimal(1), Decimal(1), 1), (d(2024, 1, 20), "email", Decimal(90), Decimal(90), 9)],
        "date date, channel string, total_spend decimal(28,4), attributed_revenue decimal(28,4), attributed_orders bigint",
    )
    since = budget.lookback_start(channel_days, 10)
    recent = budget.margin_by_channel(owners, margins, since)
    rows = {r.channel: r for r in budget.channel_metrics(channel_days, recent, since).collect()}
    assert set(rows) == {"email", "search"}  # ten days back, both ends included
    assert (rows["email"].roas, rows["email"].margin_per_dollar, rows["search"].margin_per_dollar) == (4.0, 2.0, 0.0)


def test_rounds_over_the_table_equal_the_fold(spark):
    random_ = random.Random(8)
    roas = {f"c{i:03}": random_.choice([0.0, random_.uniform(0, 5), random_.uniform(0, 0.1)]) for i in range(40)}
    scenarios = (ShareScenario("a", 100.0, 0.001, 0.06), ShareScenario("b", 100.0, 0.0, 0.026), ShareScenario("c", 50.0, 0.0, 0.9), ShareScenario("d", 50.0, 0.01, 0.02))
    table = spark.createDataFrame([(c, r, 1.0) for c, r in roas.items()], "channel string, roas double, margin_per_dollar double")
    fold, rounds = ({(r.scenario_id, r.channel): r.allocated_spend for r in budget.allocate_by_share(table, scenarios, array_channels=n).collect()} for n in (64, 0))
    assert len(rounds) == 160 and rounds == pytest.approx(fold)
    nothing = spark.createDataFrame([(c, 0.0, 1.0) for c in roas], "channel string, roas double, margin_per_dollar double")
    assert {r.allocated_spend for r in budget.allocate_by_share(nothing, scenarios[:1], array_channels=0).collect()} == {2.5}
