"""The session before each order and shared credit, against plain loops."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from spendlens import schemas
from spendlens.config import CHANNELS, TouchConfig
from spendlens.operators import touches

START = datetime(2024, 1, 1)


def fact(spark, rows):
    """Rows (session, user, minutes, channel, order, minutes to it, revenue)."""
    full = [
        (s, u, None if m is None else START + timedelta(minutes=m), None, "web", c, "C001", False, int(o is not None), o,
         Decimal(r), Decimal(0), Decimal(r), Decimal(r), False, None if after is None else after * 60.0)
        for s, u, m, c, o, after, r in rows
    ]
    return spark.createDataFrame(full, schemas.FACT_SESSIONS)


def grown(seed, n):
    random_ = random.Random(seed)
    rows = []
    for i in range(n):
        user = random_.choice(["hot", "hot", "hot", "a", "b", None])
        row = (f"s{i:04}", user, random_.randrange(0, 60 * 24 * 12, 30), random_.choice([*CHANNELS, None]))
        orders = random_.choice([0, 0, 1, 2])
        for k in range(orders):
            rows.append((*row, f"o{i}-{k}", random_.choice([0, 5, 1500, None]), random_.choice(["10.0001", "0", "-3.3333", "99.99"])))
        if not orders:
            rows.append((*row, None, None, "0"))
    random_.shuffle(rows)
    return rows


def sessions_of(rows):
    return {(s, u, m, c) for s, u, m, c, *_ in rows}


def before(rows, user, at):
    return sorted((m, s, c) for s, u, m, c in sessions_of(rows) if u == user and m is not None and m <= at)


def test_preceding_sessions(spark):
    rows = grown(1, 300)
    want = {}
    for s, u, m, c, o, after, _ in rows:
        if o is None:
            continue
        if after is None:
            want[o] = None
        elif u is None:
            want[o] = s
        else:
            want[o] = before(rows, u, m + after)[-1][1]
    made = touches.preceding_sessions(fact(spark, rows).repartition(4)).collect()
    assert {r.order_id: r.touch_session_id for r in made} == want and len(made) == len(want)
    times = {s: START + timedelta(minutes=m) for s, _, m, _ in sessions_of(rows)}
    assert all(r.touch_ts == times.get(r.touch_session_id) for r in made)
    assert {r.order_id: r.order_ts for r in made} == {o: None if a is None else START + timedelta(minutes=m + a) for _, _, m, _, o, a, _ in rows if o}


def shares(units, weights):
    total, sign = sum(weights), -1 if units < 0 else 1
    parts = [abs(units) * w // total for w in weights]
    order = sorted(range(len(weights)), key=lambda k: (-(abs(units) * weights[k] % total), k))
    for k in order[: abs(units) - sum(parts)]:
        parts[k] += 1
    return [sign * p for p in parts]


@pytest.mark.parametrize("config", [TouchConfig(3, 2.0), TouchConfig(0, 1.0), TouchConfig(30, 0.5)])
def test_credits(spark, config):
    rows = grown(2, 250)
    slots, want = [*CHANNELS, None], {}
    for s, u, m, c, o, after, r in rows:
        if o is None:
            continue
        linear, decay = Counter(), Counter()
        if u is not None and after is not None:
            day = (m + after) // 1440
            for at, _, channel in before(rows, u, m + after):
                if day - at // 1440 <= config.lookback_days:
                    linear[channel] += 1
                    decay[channel] += config.day_weights[day - at // 1440]
        if not linear:
            linear[c], decay[c] = 1, 1
        units = int(Decimal(r) * 10_000)
        by_slot = zip(slots, *[shares(units, [w[x] for x in slots]) for w in (linear, decay)], strict=True)
        want |= {(o, x): (linear[x], Decimal(a) / 10_000, Decimal(b) / 10_000) for x, a, b in by_slot if linear[x]}
    made = touches.multi_touch_credits(fact(spark, rows).repartition(3), config)
    found = {(r.order_id, r.channel): (r.touches, r.linear_credit, r.decay_credit) for r in made.collect()}
    assert found == want
    revenue = defaultdict(Decimal)
    for (o, _), (_, a, b) in found.items():
        revenue[o] += a - b
    assert set(revenue.values()) == {Decimal(0)}
    totals = touches.multi_touch(made).collect()
    everything = sum(Decimal(r) for *_, o, _, r in rows if o)
    assert sum(t.linear_revenue for t in totals) == sum(t.decay_revenue for t in totals) == everything


def test_large_amounts_do_not_overflow(spark):
    rows = [(f"s{i}", "u", i, CHANNELS[i % 5], None, None, "0") for i in range(7)] + [("s9", "u", 9, "email", "o", 1, "99999999999999.9999")]
    made = touches.multi_touch_credits(fact(spark, rows)).collect()
    assert sum(r.decay_credit for r in made) == sum(r.linear_credit for r in made) == Decimal("99999999999999.9999")


def test_no_join_on_an_inequality(spark, capsys):
    rows = fact(spark, grown(3, 20))
    touches.preceding_sessions(rows).explain()
    touches.multi_touch_credits(rows).explain()
    plans = capsys.readouterr().out
    assert "NestedLoop" not in plans and "Cartesian" not in plans


def test_empty(spark):
    none = fact(spark, [])
    assert touches.preceding_touch(touches.preceding_sessions(none)).count() == 0
    assert touches.multi_touch(touches.multi_touch_credits(none)).count() == 0
