"""The best allocation against all corners of the limits."""

import random
from itertools import product

import pytest

from spendlens.config import ShareScenario
from spendlens.operators import budget

LIMITS = "scenario_id string, channel string, budget_total double, value double, lower double, upper double"


def best_corner(rows, whole):
    """A linear program has its best point where all channels but one are at a limit."""
    budget_total, best = rows[0][2], None
    values = [(r[3], r[4], r[5] if whole or r[3] > 0 else r[4]) for r in rows]
    target = min(max(budget_total, sum(v[1] for v in values)), sum(v[2] for v in values))
    for free in range(len(values)):
        for ends in product((1, 2), repeat=len(values) - 1):
            spent = [v[e] for v, e in zip(values[:free] + values[free + 1 :], ends, strict=True)]
            rest = target - sum(spent)
            _, low, high = values[free]
            if low - 1e-9 <= rest <= high + 1e-9:
                plan = spent[:free] + [rest] + spent[free:]
                revenue = sum(p * v[0] for p, v in zip(plan, values, strict=True))
                best = revenue if best is None else max(best, revenue)
    return best, target


@pytest.mark.parametrize("whole", [True, False])
def test_no_corner_is_better(spark, whole):
    random_, rows = random.Random(11), []
    for s in range(40):
        total, n = random_.choice([50.0, 100.0, 400.0]), random_.randint(1, 5)
        for c in range(n):
            low = random_.uniform(0, 15)
            rows.append((f"s{s}", f"c{c}", total, random_.choice([-1.0, 0.0, 1.5, random_.random() * 4]), low, low + random_.choice([0.0, random_.uniform(0, 80)])))
    made = budget.optimal_spend(spark.createDataFrame(rows, LIMITS), whole).collect()
    for s in {r[0] for r in rows}:
        own, plan = [r for r in rows if r[0] == s], [r for r in made if r.scenario_id == s]
        best, target = best_corner(own, whole)
        assert sum(r.optimal_spend for r in plan) == pytest.approx(target)
        assert sum(r.optimal_spend * r.value for r in plan) == pytest.approx(best)
        assert all(r.lower - 1e-9 <= r.optimal_spend <= max(r.lower, r.upper) + 1e-9 for r in plan)


def test_the_rule_never_beats_it(spark):
    metrics = spark.createDataFrame([("a", 3.0, 1.0), ("b", 1.0, 1.0), ("c", None, 1.0), ("d", 0.5, 0.0)], "channel string, roas double, margin_per_dollar double")
    scenarios = (ShareScenario("base", 100.0), ShareScenario("tight", 100.0, 0.1, 0.2), ShareScenario("floors", 100.0, 0.4, 0.5))
    gap = budget.optimal_gap(budget.optimal_spend(budget.share_limits(metrics, scenarios)), budget.allocate_by_share(metrics, scenarios))
    rows = {r.scenario_id: r for r in gap.collect()}
    assert rows["base"].loss > 0 and rows["tight"].loss == pytest.approx(0) and rows["floors"].loss == pytest.approx(0)
    assert rows["base"].loss_pct == pytest.approx(100 * rows["base"].loss / rows["base"].optimal_revenue)


def test_no_channels(spark):
    assert budget.optimal_spend(spark.createDataFrame([], LIMITS)).count() == 0
