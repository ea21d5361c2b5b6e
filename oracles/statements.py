"""One SQL statement per named query, written independently of the DataFrame code."""

from __future__ import annotations

import math
import re

from oracles.fixtures import FIXTURES
from spendlens.operators import report_texts as text
from spendlens.plans.catalog import BOUNDS_SCENARIOS, RATIOS, SHARE_SCENARIOS

CHANNELS = ("email", "organic", "paid_social", "referral", "search")
MONEY = "DECIMAL(18,4)"


def money(expression: str) -> str:
    return f"CAST({expression} AS {MONEY})"


def total(expression: str) -> str:
    return f"CAST(sum({expression}) AS DECIMAL(28,4))"


def whole(expression: str) -> str:
    return f"CAST(sum({expression}) AS BIGINT)"


def div(num: str, den: str, otherwise: str = "0.0") -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE {otherwise} END"


def rounded(expression: str, digits: int) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits})"


def r4(expression: str) -> str:
    return rounded(expression, 4)


def r10(expression: str) -> str:
    return rounded(expression, 10)


def cols(*names: str, digits: int = 4) -> str:
    return ", ".join(f"{rounded(n, 10 if n in RATIOS else digits)} AS {n}" for n in names)


def channel(expression: str) -> str:
    return (
        f"CASE WHEN lower(trim({expression})) IN {CHANNELS} THEN lower(trim({expression})) END"
    )


def first_rows(table: str, key: str) -> str:
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingest_seq) = 1"


CTES: dict[str, str] = dict(FIXTURES)
CTES |= {
    "sessions_1": first_rows("raw_sessions", "session_id"),
    "sessions_c": f"SELECT * REPLACE ({channel('channel')} AS channel) FROM sessions_1",
    "orders_1": first_rows("raw_orders", "order_id"),
    "fence": f"""
SELECT {money("q3 + 3.0e0 * (q3 - q1)")} AS fence FROM
 (SELECT quantile_cont(net_amount, 0.25) AS q1, quantile_cont(net_amount, 0.75) AS q3 FROM orders_1)""",
    "orders_c": f"""
SELECT order_id, session_id, order_ts, {money("gross_amount")} AS gross_amount,
       {money("discount_amount")} AS discount_amount, {money("net_amount")} AS net_amount,
       coalesce({money("net_amount")} > fence, false) AS is_revenue_outlier,
       CASE WHEN {money("net_amount")} > fence THEN fence ELSE {money("net_amount")} END AS net_amount_capped
FROM orders_1 CROSS JOIN fence""",
    "ad_1": first_rows("raw_ad_spend", "date, campaign_id"),
    "ad_c": f"""
SELECT date, campaign_id, {channel("channel")} AS channel, {money("coalesce(spend, 0)")} AS spend,
       CAST(coalesce(impressions, 0) AS BIGINT) AS impressions, CAST(coalesce(clicks, 0) AS BIGINT) AS clicks,
       promo_flag
FROM ad_1""",
    "campaigns_c": f"SELECT campaign_id, {channel('channel')} AS channel FROM raw_campaigns",
    "fs": f"""
SELECT s.session_id, s.user_id, s.session_ts, CAST(s.session_ts AS DATE) AS session_date, s.device, s.channel,
       s.campaign_id, coalesce(CAST(s.session_ts AS DATE) = u.signup_date, false) AS is_new_user,
       CASE WHEN o.order_id IS NULL THEN 0 ELSE 1 END AS purchase_flag, o.order_id,
       coalesce(o.gross_amount, 0) AS gross_amount, coalesce(o.discount_amount, 0) AS discount_amount,
       coalesce(o.net_amount, 0) AS net_amount, coalesce(o.net_amount_capped, 0) AS net_amount_capped,
       coalesce(o.is_revenue_outlier, false) AS is_revenue_outlier,
       date_diff('microsecond', s.session_ts, o.order_ts) / 1e6 AS session_to_order_sec
FROM sessions_c s LEFT JOIN orders_c o ON s.session_id = o.session_id LEFT JOIN raw_users u ON s.user_id = u.user_id""",
    "campaign_out": f"""
SELECT session_date AS date, campaign_id, count(session_id) AS attributed_sessions,
       {whole("purchase_flag")} AS attributed_orders, {total("net_amount_capped")} AS attributed_revenue
FROM fs WHERE campaign_id IS NOT NULL GROUP BY 1, 2""",
    "campaign_out_distinct": f"""
SELECT session_date AS date, campaign_id, count(DISTINCT session_id) AS attributed_sessions,
       {whole("purchase_flag")} AS attributed_orders, {total("net_amount_capped")} AS attributed_revenue
FROM fs WHERE campaign_id IS NOT NULL GROUP BY 1, 2""",
}


def campaign_fact(outcomes: str) -> str:
    return f"""
SELECT date, campaign_id, channel, spend, impressions, clicks, attributed_sessions, attributed_orders,
       attributed_revenue, {div("spend", "clicks")} AS cpc, {div("clicks", "impressions")} AS ctr,
       {div("attributed_orders", "attributed_sessions")} AS cvr, {div("attributed_revenue", "spend")} AS roas,
       {div("spend", "attributed_orders", "NULL")} AS cac_proxy
FROM (SELECT coalesce(a.date, x.date) AS date, coalesce(a.campaign_id, x.campaign_id) AS campaign_id,
             coalesce(a.channel, c.channel) AS channel, coalesce(a.spend, 0) AS spend,
             coalesce(a.impressions, 0) AS impressions, coalesce(a.clicks, 0) AS clicks,
             coalesce(x.attributed_sessions, 0) AS attributed_sessions,
             coalesce(x.attributed_orders, 0) AS attributed_orders,
             coalesce(x.attributed_revenue, 0) AS attributed_revenue
      FROM ad_c a FULL OUTER JOIN {outcomes} x ON a.date = x.date AND a.campaign_id = x.campaign_id
      LEFT JOIN campaigns_c c ON c.campaign_id = coalesce(a.campaign_id, x.campaign_id)) j"""


def segment(keys: str, prefix: str) -> str:
    names = [f"{prefix}_{m}" for m in ("sessions", "orders", "revenue", "spend")]
    not_null = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"""
SELECT *, {div(names[1], names[0])} AS CVR, {div(names[2], names[3])} AS ROAS FROM
 (SELECT {keys}, count(session_id) AS {names[0]}, {whole("purchase_flag")} AS {names[1]},
         {total("gross_amount")} AS {names[2]}, sum(spend_per_session) AS {names[3]}
  FROM ws_users WHERE {not_null} GROUP BY {keys}) g"""


def trend(key: str, prefix: str) -> str:
    return f"""
SELECT *, {div("attributed_orders", "attributed_sessions")} AS {prefix}_cvr,
       {div(prefix + "_revenue", "spend")} AS {prefix}_roas FROM
 (SELECT {key}, {whole("attributed_sessions")} AS attributed_sessions,
         {whole("attributed_orders")} AS attributed_orders, {total("attributed_revenue")} AS {prefix}_revenue,
         {total("spend")} AS spend, max(promo_flag) AS has_promo FROM chd GROUP BY {key}) g"""


CTES |= {
    "fcd": campaign_fact("campaign_out"),
    "fcd_distinct": campaign_fact("campaign_out_distinct"),
    "promo": "SELECT date, channel, max(promo_flag) AS promo_flag FROM ad_c WHERE channel IS NOT NULL GROUP BY 1, 2",
    "fch": f"""
SELECT g.date, g.channel, total_spend, total_impressions, total_clicks, attributed_sessions, attributed_orders,
       attributed_revenue, CAST(isodow(g.date) - 1 AS INT) AS day_of_week,
       CAST(coalesce(p.promo_flag, 0) AS INT) AS promo_flag,
       CAST((g.date - (SELECT min(date) FROM fcd WHERE channel IS NOT NULL)) // 7 AS INT) AS week_index
FROM (SELECT date, channel, {total("spend")} AS total_spend, {whole("impressions")} AS total_impressions,
             {whole("clicks")} AS total_clicks, {whole("attributed_sessions")} AS attributed_sessions,
             {whole("attributed_orders")} AS attributed_orders, {total("attributed_revenue")} AS attributed_revenue
      FROM fcd WHERE channel IS NOT NULL GROUP BY date, channel) g
LEFT JOIN promo p ON g.date = p.date AND g.channel = p.channel""",
    # Analysis variant of the daily tables.
    "cd": f"""
SELECT date, campaign_id, channel, spend, impressions, clicks, attributed_sessions, attributed_orders,
       attributed_revenue, {div("spend", "clicks")} AS CPC, {div("clicks", "impressions")} AS CTR,
       {div("attributed_orders", "attributed_sessions")} AS CVR, {div("attributed_revenue", "spend")} AS ROAS,
       {div("spend", "attributed_orders")} AS CAC
FROM (SELECT g.date, g.campaign_id, a.channel, coalesce(a.spend, 0) AS spend,
             coalesce(a.impressions, 0) AS impressions, coalesce(a.clicks, 0) AS clicks,
             attributed_sessions, attributed_orders, attributed_revenue
      FROM (SELECT session_date AS date, campaign_id, channel, count(session_id) AS attributed_sessions,
                   {whole("purchase_flag")} AS attributed_orders, {total("gross_amount")} AS attributed_revenue
            FROM fs WHERE campaign_id IS NOT NULL AND channel IS NOT NULL GROUP BY 1, 2, 3) g
      LEFT JOIN ad_c a ON g.date = a.date AND g.campaign_id = a.campaign_id) j""",
    "ad_roll": f"""
SELECT date, channel, {total("spend")} AS spend, {whole("impressions")} AS impressions, {whole("clicks")} AS clicks,
       max(promo_flag) AS promo_flag FROM ad_c WHERE channel IS NOT NULL GROUP BY 1, 2""",
    "attr_roll": f"""
SELECT date, channel, {whole("attributed_sessions")} AS attributed_sessions,
       {whole("attributed_orders")} AS attributed_orders, {total("attributed_revenue")} AS attributed_revenue
FROM cd WHERE channel IS NOT NULL GROUP BY 1, 2""",
    "chd": """
SELECT a.date, a.channel, spend, impressions, clicks, coalesce(attributed_sessions, 0) AS attributed_sessions,
       coalesce(attributed_orders, 0) AS attributed_orders, coalesce(attributed_revenue, 0) AS attributed_revenue,
       CAST(isodow(a.date) - 1 AS INT) AS day_of_week, CAST(coalesce(promo_flag, 0) AS INT) AS promo_flag,
       CAST((a.date - (SELECT min(date) FROM ad_roll)) // 7 AS INT) AS week_index
FROM ad_roll a LEFT JOIN attr_roll t ON a.date = t.date AND a.channel = t.channel""",
    "means": "SELECT avg(ROAS) AS avg_roas, avg(CAST(spend AS DOUBLE)) AS avg_spend FROM cd",
    "waste": """
SELECT date, campaign_id, channel, spend, attributed_revenue, ROAS FROM cd CROSS JOIN means
WHERE CAST(spend AS DOUBLE) > avg_spend AND ROAS < avg_roas""",
    "daily": trend("date", "daily"),
    "weekly": trend("week_index", "weekly"),
    # Sessions with their share of the spend, row by row.
    "sps": f"""
SELECT a.date, a.campaign_id, a.channel, a.spend, coalesce(n, 0) AS total_sessions_in_group,
       {div("a.spend", "coalesce(n, 0)")} AS spend_per_session
FROM ad_c a LEFT JOIN (SELECT session_date AS date, campaign_id, channel, count(session_id) AS n FROM fs
                       GROUP BY 1, 2, 3) c
  ON a.date = c.date AND a.campaign_id = c.campaign_id AND a.channel = c.channel""",
    "ws": """
SELECT fs.*, coalesce(p.spend_per_session, 0) AS spend_per_session
FROM fs LEFT JOIN sps p ON fs.session_date = p.date AND fs.campaign_id = p.campaign_id AND fs.channel = p.channel""",
    "ws_users": "SELECT ws.*, u.city_tier FROM ws LEFT JOIN raw_users u ON ws.user_id = u.user_id",
    "seg_cd": segment("channel, device", "attributed"),
    "seg_new": segment("is_new_user", "total"),
    "seg_city": segment("city_tier", "attributed"),
    "members": """
SELECT 'channel' AS segment_kind, channel AS segment, device AS member, CVR, ROAS FROM seg_cd
UNION ALL SELECT 'user', 'New vs Returning Users', CASE WHEN is_new_user THEN 'new' ELSE 'returning' END, CVR, ROAS
FROM seg_new
UNION ALL SELECT 'city', 'City Tier', CAST(city_tier AS STRING), CVR, ROAS FROM seg_city""",
    "metric_members": """
SELECT 'CVR' AS metric, segment_kind, segment, member, CVR AS value FROM members
UNION ALL SELECT 'ROAS', segment_kind, segment, member, ROAS FROM members""",
    "spreads": """
SELECT metric, segment_kind, segment, max(value) AS max_value, min(value) AS min_value,
       max(value) - min(value) AS spread,
       max(CASE WHEN hi = 1 THEN member END) AS best_member, max(CASE WHEN lo = 1 THEN member END) AS worst_member,
       max(CASE WHEN member = 'new' THEN value END) AS new_value,
       max(CASE WHEN member = 'returning' THEN value END) AS returning_value
FROM (SELECT *, row_number() OVER (PARTITION BY metric, segment ORDER BY value DESC, member) AS hi,
             row_number() OVER (PARTITION BY metric, segment ORDER BY value, member) AS lo FROM metric_members) m
GROUP BY 1, 2, 3""",
    "top_seg": """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY spread DESC, segment) AS INT) AS rank
               FROM spreads) s WHERE rank <= 3""",
    # Attribution.
    "lt": f"""
SELECT channel, {total("gross_amount")} AS attributed_revenue, count(order_id) AS attributed_orders
FROM fs WHERE purchase_flag = 1 AND channel IS NOT NULL GROUP BY channel""",
    "aroas": f"""
SELECT lt.*, s.spend, {div("attributed_revenue", "s.spend")} AS attributed_ROAS
FROM lt LEFT JOIN (SELECT channel, {total("spend")} AS spend FROM chd GROUP BY channel) s ON lt.channel = s.channel""",
    "simple_roas": f"""
SELECT *, {div("attributed_revenue", "spend")} AS ROAS FROM
 (SELECT channel, {total("attributed_revenue")} AS attributed_revenue, {total("spend")} AS spend FROM chd
  GROUP BY channel) g""",
    # Regression table.
    "reg": f"""
SELECT b.date, daily_revenue, total_spend, day_of_week, promo_flag,
       {", ".join(f"CAST(coalesce(spend_{c}, 0) AS DOUBLE) AS spend_{c}" for c in CHANNELS)},
       (b.date - DATE '1970-01-01') % 5 = 0 AS is_test
FROM (SELECT date, CAST(sum(attributed_revenue) AS DOUBLE) AS daily_revenue,
             CAST(sum(spend) AS DOUBLE) AS total_spend, max(day_of_week) AS day_of_week, max(promo_flag) AS promo_flag
      FROM chd GROUP BY date) b
LEFT JOIN (SELECT date, {", ".join(f"avg(spend) FILTER (channel = '{c}') AS spend_{c}" for c in CHANNELS)}
           FROM chd GROUP BY date) p ON b.date = p.date""",
}


# Least squares by orthogonal columns: e_k is feature k less its projections on the earlier e_j (e_0 is the constant);
# the slopes then follow from the last feature back to the first, each taking its part out of y.
FREE = ("day_of_week", "promo_flag", *(f"spend_{c}" for c in CHANNELS))


def _least_squares() -> dict[str, str]:
    n = len(FREE)
    ctes = {
        "ols_0": f"SELECT date, daily_revenue AS y, 1.0e0 AS e0, {', '.join(f'CAST({f} AS DOUBLE) AS x{k}' for k, f in enumerate(FREE, 1))} FROM reg WHERE NOT is_test"
    }
    for k in range(1, n + 1):
        parts = " - ".join(
            f"(SELECT sum(x{k} * e{j}) / sum(e{j} * e{j}) FROM ols_{k - 1}) * e{j}" for j in range(k)
        )
        ctes[f"ols_{k}"] = f"SELECT *, x{k} - {parts} AS e{k} FROM ols_{k - 1}"
    ctes[f"back_{n}"] = f"SELECT *, y AS y{n} FROM ols_{n}"
    for k in range(n, 0, -1):
        ctes[f"slope_{k}"] = f"SELECT sum(y{k} * e{k}) / sum(e{k} * e{k}) AS b FROM back_{k}"
        ctes[f"back_{k - 1}"] = f"SELECT *, y{k} - (SELECT b FROM slope_{k}) * x{k} AS y{k - 1} FROM back_{k}"
    spend = [f"(SELECT b FROM slope_{k})" for k, f in enumerate(FREE, 1) if f.startswith("spend_")]
    ctes["shared"] = f"SELECT ({' + '.join(spend)}) / {len(spend) + 1} AS b"
    rows = ["SELECT 'total_spend' AS feature, b AS coefficient FROM shared"]
    for k, f in enumerate(FREE, 1):
        less = " - (SELECT b FROM shared)" if f.startswith("spend_") else ""
        rows.append(f"SELECT '{f}', b{less} FROM slope_{k}")
    ctes["coef"] = "\nUNION ALL ".join(rows)
    ctes["intercept"] = "SELECT avg(y0) AS b FROM back_0"
    terms = " + ".join(f"(SELECT b FROM slope_{k}) * {f}" for k, f in enumerate(FREE, 1))
    ctes["predicted"] = f"SELECT *, (SELECT b FROM intercept) + {terms} AS p FROM reg"
    return ctes


CTES |= _least_squares()


def _resampled(replicates: int) -> dict[str, str]:
    """The same steps with weights, for all replicates side by side: sums become windows over a replicate."""
    cuts, below = [], 0.0
    for k in range(16):
        below += math.exp(-1) / math.factorial(k)
        cuts += [round(below * 2**32)] if round(below * 2**32) < 2**32 else []
    n, own = len(FREE), "OVER (PARTITION BY replicate)"
    ctes = {
        "days_drawn": f"""
SELECT *, {" + ".join(f"CAST(u >= {cut} AS INT)" for cut in cuts)} AS w
FROM (SELECT reg.*, replicate, CAST('0x' || substr(md5(strftime(date, '%Y-%m-%d') || ':' || replicate), 1, 8) AS BIGINT) AS u
      FROM reg CROSS JOIN (SELECT unnest(range(1, {replicates + 1})) AS replicate) r WHERE NOT is_test) d""",
        "boot_0": f"SELECT replicate, w, daily_revenue AS y, 1.0e0 AS e0, "
        f"{', '.join(f'CAST({f} AS DOUBLE) AS x{k}' for k, f in enumerate(FREE, 1))} FROM days_drawn WHERE w > 0",
    }

    def slope(of: str, k: int) -> str:
        square = f"sum(w * e{k} * e{k}) {own}"
        return f"CASE WHEN {square} > 1e-9 THEN sum(w * {of} * e{k}) {own} / {square} ELSE 0 END"

    for k in range(1, n + 1):
        parts = " - ".join(f"({slope(f'x{k}', j)}) * e{j}" for j in range(k))
        ctes[f"boot_{k}"] = f"SELECT *, x{k} - {parts} AS e{k} FROM boot_{k - 1}"
    ctes[f"unboot_{n}"] = f"SELECT *, y AS y{n} FROM boot_{n}"
    for k in range(n, 0, -1):
        ctes[f"unboot_{k - 1}"] = (
            f"SELECT *, y{k} - b{k} * x{k} AS y{k - 1} FROM (SELECT *, {slope(f'y{k}', k)} AS b{k} FROM unboot_{k}) z"
        )
    spend = [k for k, f in enumerate(FREE, 1) if f.startswith("spend_")]
    ctes["boot_slopes"] = f"""
SELECT replicate, {", ".join(f"max(b{k}) AS b{k}" for k in range(1, n + 1))},
       ({" + ".join(f"max(b{k})" for k in spend)}) / {len(spend) + 1} AS part FROM unboot_0 GROUP BY replicate"""
    rows = ["SELECT replicate, 'total_spend' AS feature, part AS coefficient FROM boot_slopes"]
    rows += [f"SELECT replicate, '{f}', b{k}{' - part' if k in spend else ''} FROM boot_slopes" for k, f in enumerate(FREE, 1)]
    ctes["boot_coef"] = "\nUNION ALL ".join(rows)
    return ctes


CTES |= _resampled(100)


def _values(rows: list[tuple], names: str) -> str:
    def literal(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{v!r}e0"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) v({names})"


def metrics(days: int, all_margin: bool = False) -> str:
    window = "" if all_margin else f"AND session_date >= (SELECT max(date) FROM fch) - {days}"
    return f"""
SELECT m.*, {div("attributed_revenue", "total_spend")} AS roas,
       {div("attributed_margin", "total_spend")} AS margin_per_dollar
FROM (SELECT g.*, coalesce(x.margin, 0) AS attributed_margin
      FROM (SELECT channel, {total("total_spend")} AS total_spend, {total("attributed_revenue")} AS attributed_revenue,
                   {whole("attributed_orders")} AS attributed_orders
            FROM fch WHERE date >= (SELECT max(date) FROM fch) - {days} GROUP BY channel) g
      LEFT JOIN (SELECT channel, {total("margin")} AS margin
                 FROM (SELECT * FROM fs WHERE purchase_flag = 1 {window}
                       QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY session_ts, session_id) = 1) o
                 JOIN omargin USING (order_id) GROUP BY channel) x ON g.channel = x.channel) m"""


CTES |= {
    "lines": f"""
SELECT i.order_id, p.category, {money("quantity * unit_price")} AS revenue, {money("quantity * cost")} AS cost
FROM raw_order_items i JOIN raw_products p ON i.product_id = p.product_id""",
    "omargin": f"""
SELECT order_id, {total("revenue")} AS revenue, {total("cost")} AS cost,
       {total("revenue")} - {total("cost")} AS margin FROM lines GROUP BY order_id""",
    "metrics_90": metrics(90),
    "share_scenarios": _values(
        [(s.scenario_id, s.budget_total, s.min_pct, s.max_pct) for s in SHARE_SCENARIOS],
        "scenario_id, budget_total, min_pct, max_pct",
    ),
    "share_0": """
SELECT s.*, m.channel, m.roas, m.margin_per_dollar, n, CASE WHEN n * min_pct > 1 THEN budget_total / n
       ELSE budget_total * min_pct END AS alloc, budget_total * max_pct AS cap
FROM share_scenarios s CROSS JOIN metrics_90 m CROSS JOIN (SELECT count(*) AS n FROM metrics_90) k""",
}


def share_rounds(prefix: str, channels: int) -> dict[str, str]:
    """As many rounds as there are channels: each fills one at least, or spends the rest."""
    return {
        f"{prefix}_{k}": f"""
SELECT * EXCLUDE (alloc, room, rest, pull), alloc + CASE WHEN rest > 1e-6 AND pull > 0
       THEN least(rest * roas * room / pull, room) ELSE 0 END AS alloc
FROM (SELECT *, sum(roas * room) OVER (PARTITION BY scenario_id) AS pull
      FROM (SELECT *, greatest(0, cap - alloc) AS room,
                   budget_total - sum(alloc) OVER (PARTITION BY scenario_id) AS rest FROM {prefix}_{k - 1}) a) b"""
        for k in range(1, channels + 1)
    }


CTES |= share_rounds("share", 6)
CTES |= {
    "many_0": f"""
SELECT s.*, m.campaign_id AS channel, m.roas, 0.0e0 AS margin_per_dollar, n,
       least(budget_total * min_pct, budget_total / n) AS alloc, budget_total * max_pct AS cap
FROM (VALUES ('many', 1000000.0e0, 0.005e0, 0.04e0), ('loose', 1000000.0e0, 0.0e0, 0.1e0))
     s(scenario_id, budget_total, min_pct, max_pct)
CROSS JOIN (SELECT campaign_id, {div("sum(attributed_revenue)", "sum(spend)")} AS roas
            FROM fcd GROUP BY campaign_id) m
CROSS JOIN (SELECT count(DISTINCT campaign_id) AS n FROM fcd) k""",
    **share_rounds("many", 30),
    "many": """
SELECT scenario_id, channel, budget_total, spend AS allocated_spend, spend / budget_total AS allocated_pct,
       budget_total - sum(spend) OVER (PARTITION BY scenario_id) AS unallocated, roas, margin_per_dollar
FROM (SELECT *, CASE WHEN sum(roas) OVER (PARTITION BY scenario_id) > 0 THEN least(alloc, cap)
                     ELSE budget_total / n END AS spend FROM many_30) s""",
}
CTES |= {
    "share": """
SELECT scenario_id, channel, budget_total, spend AS allocated_spend, spend / budget_total AS allocated_pct,
       budget_total - sum(spend) OVER (PARTITION BY scenario_id) AS unallocated, roas, margin_per_dollar
FROM (SELECT *, CASE WHEN sum(roas) OVER (PARTITION BY scenario_id) > 0 THEN least(alloc, cap)
                     ELSE budget_total / n END AS spend FROM share_6) s""",
    "impact_rows": """
SELECT scenario_id, channel, allocated_spend, allocated_pct, roas, margin_per_dollar,
       allocated_spend * roas AS base_revenue, allocated_spend * roas * 1.2e0 AS best_revenue,
       allocated_spend * roas * 0.8e0 AS worst_revenue, allocated_spend * margin_per_dollar AS base_margin,
       allocated_spend * margin_per_dollar * 1.2e0 AS best_margin,
       allocated_spend * margin_per_dollar * 0.8e0 AS worst_margin FROM share""",
    "bounds_scenarios": _values(
        [
            (s.scenario_id, s.budget_total, b.channel, b.min_spend, b.max_spend, dict(s.weight_factor).get(b.channel, 1.0))
            for s in BOUNDS_SCENARIOS
            for b in s.bounds
        ],
        "scenario_id, budget_total, channel, min_spend, max_spend, factor",
    ),
    # Rounds of proportional sharing among the channels that still have room.
    "bounds_0": """
SELECT b.*, c.coefficient AS weight, coalesce(greatest(c.coefficient * factor, 0), 0) AS w, min_spend AS alloc,
       sum(min_spend) OVER (PARTITION BY scenario_id) > budget_total AS infeasible
FROM bounds_scenarios b LEFT JOIN coef c ON c.feature = 'spend_' || b.channel""",
}
for _round in range(1, 7):
    CTES[f"bounds_{_round}"] = f"""
SELECT * EXCLUDE (alloc, rest, room, pull), alloc + CASE WHEN rest > 0 AND room > 0 AND pull > 0
       THEN least(rest * w / pull, room) ELSE 0 END AS alloc
FROM (SELECT *, sum(CASE WHEN room > 1e-9 THEN w ELSE 0 END) OVER (PARTITION BY scenario_id) AS pull
      FROM (SELECT *, max_spend - alloc AS room,
                   budget_total - sum(alloc) OVER (PARTITION BY scenario_id) AS rest FROM bounds_{_round - 1}) a) b"""
CTES |= {
    "bounds": """
SELECT scenario_id, channel, budget_total, min_spend, max_spend, weight, round(alloc, 2) AS allocated_spend,
       infeasible FROM bounds_6""",
}


def impact_of_plan(horizon: str, best: str, worst: str) -> str:
    return f"""
SELECT scenario_id, {cols("baseline_revenue", "new_revenue", "increase", digits=0)},
       {rounded(best, 0)} AS best_increase, {rounded(worst, 0)} AS worst_increase
FROM (SELECT *, new_revenue - baseline_revenue AS increase FROM
 (SELECT scenario_id, h.baseline AS baseline_revenue, h.n_days * ((SELECT b FROM intercept)
         + (SELECT coefficient FROM coef WHERE feature = 'day_of_week') * h.dow
         + (SELECT coefficient FROM coef WHERE feature = 'promo_flag') * h.promo
         + (SELECT coefficient FROM coef WHERE feature = 'total_spend') * plan / {horizon}
         + weighted / {horizon}) AS new_revenue
  FROM (SELECT scenario_id, sum(allocated_spend) AS plan, sum(allocated_spend * weight) AS weighted FROM bounds
        GROUP BY scenario_id) a
  CROSS JOIN (SELECT count(*) AS n_days, sum(p) AS baseline, avg(day_of_week) AS dow, avg(promo_flag) AS promo
              FROM predicted) h) x) y"""


CTES |= {
    "open_days": """
SELECT date, channel, sum(spend) AS spend, sum(attributed_revenue) AS revenue FROM chd WHERE day(date) % 5 <> 0 GROUP BY 1, 2""",
    "calendar": """
SELECT CAST(d AS DATE) AS date, channel FROM (SELECT DISTINCT channel FROM open_days) x
CROSS JOIN (SELECT unnest(generate_series((SELECT min(date) FROM open_days), (SELECT max(date) FROM open_days),
                                          INTERVAL 1 DAY)) AS d) y""",
    "frames": """
SELECT c.date, c.channel,
       (SELECT coalesce(sum(spend), 0) FROM open_days t WHERE t.channel = c.channel AND t.date BETWEEN c.date - 6 AND c.date - 0) AS spend_sum,
       (SELECT coalesce(sum(revenue), 0) FROM open_days t WHERE t.channel = c.channel AND t.date BETWEEN c.date - 6 AND c.date - 0) AS revenue_sum,
       (SELECT coalesce(sum(spend), 0) FROM open_days t WHERE t.channel = c.channel AND t.date BETWEEN c.date - 13 AND c.date - 7) AS spend_before,
       (SELECT coalesce(sum(revenue), 0) FROM open_days t WHERE t.channel = c.channel AND t.date BETWEEN c.date - 13 AND c.date - 7) AS revenue_before
FROM calendar c""",
    # The best plan is the lower limits and then, channel by channel of falling value, what the budget still allows.
    "share_rows": _values([(s.scenario_id, s.budget_total, s.min_pct, s.max_pct) for s in SHARE_SCENARIOS],
                          "scenario_id, budget_total, min_pct, max_pct"),
    "best_plan": """
SELECT scenario_id, channel, budget_total, value, lower, upper, lower + greatest(0, least(upper - lower,
       budget_total - sum(lower) OVER (PARTITION BY scenario_id)
       - coalesce(sum(upper - lower) OVER (PARTITION BY scenario_id ORDER BY value DESC, channel
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS optimal_spend
FROM (SELECT scenario_id, channel, budget_total, coalesce(roas, 0) AS value, budget_total * max_pct AS upper,
             least(budget_total * min_pct, budget_total / count(*) OVER (PARTITION BY scenario_id), budget_total * max_pct) AS lower
      FROM share_rows CROSS JOIN metrics_90) m""",
    "best_bounds": """
SELECT scenario_id, channel, budget_total, value, lower, upper, lower + greatest(0, least(room,
       budget_total - sum(lower) OVER (PARTITION BY scenario_id)
       - coalesce(sum(room) OVER (PARTITION BY scenario_id ORDER BY value DESC, channel
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS optimal_spend
FROM (SELECT *, CASE WHEN value > 0 THEN upper - lower ELSE 0 END AS room
      FROM (SELECT scenario_id, b.channel, budget_total, coalesce(coefficient * factor, 0) AS value, min_spend AS lower, max_spend AS upper
            FROM bounds_scenarios b LEFT JOIN coef c ON c.feature = 'spend_' || b.channel) v) r""",
    "placed": """
SELECT o.order_id, s.user_id, o.order_ts, o.gross_amount, s.session_id, s.channel AS own_channel
FROM orders_c o JOIN sessions_c s ON s.session_id = o.session_id""",
    "preceding": """
SELECT p.order_id, p.user_id, p.order_ts, p.gross_amount AS revenue, p.session_id, s.session_id AS touch_session_id,
       s.session_ts AS touch_ts, s.channel AS touch_channel
FROM placed p LEFT JOIN sessions_c s
  ON s.session_ts <= p.order_ts AND (s.user_id = p.user_id OR p.user_id IS NULL AND s.session_id = p.session_id)
QUALIFY row_number() OVER (PARTITION BY p.order_id ORDER BY s.session_ts DESC, s.session_id DESC) = 1""",
    "touched": """
SELECT order_id, units, channel, count(*) AS linear, CAST(sum(weight) AS HUGEINT) AS decay
FROM (SELECT p.order_id, CAST(p.gross_amount * 10000 AS HUGEINT) AS units, s.channel,
             greatest(1, CAST(round(pow(2.0e0, 20 - date_diff('day', CAST(s.session_ts AS DATE), CAST(p.order_ts AS DATE)) / 3.0e0))
                              AS BIGINT)) AS weight
      FROM placed p JOIN sessions_c s ON s.user_id = p.user_id AND s.session_ts <= p.order_ts
           AND date_diff('day', CAST(s.session_ts AS DATE), CAST(p.order_ts AS DATE)) <= 9)
GROUP BY ALL""",
    "touch_shares": """
SELECT *, CAST(sum(linear) OVER o AS HUGEINT) AS linear_sum, CAST(sum(decay) OVER o AS HUGEINT) AS decay_sum
FROM (SELECT * FROM touched UNION ALL
      SELECT order_id, CAST(gross_amount * 10000 AS HUGEINT), own_channel, 1, 1 FROM placed
      WHERE order_id NOT IN (SELECT order_id FROM touched)) WINDOW o AS (PARTITION BY order_id)""",
    "credits": """
SELECT order_id, channel, linear AS touches,
       CAST(linear_part + CASE WHEN row_number() OVER (PARTITION BY order_id ORDER BY (units * linear) % linear_sum DESC, channel NULLS LAST)
                               <= units - sum(linear_part) OVER (PARTITION BY order_id) THEN 1 ELSE 0 END AS BIGINT) / 10000.0e0
           AS linear_credit,
       CAST(decay_part + CASE WHEN row_number() OVER (PARTITION BY order_id ORDER BY (units * decay) % decay_sum DESC, channel NULLS LAST)
                              <= units - sum(decay_part) OVER (PARTITION BY order_id) THEN 1 ELSE 0 END AS BIGINT) / 10000.0e0
           AS decay_credit
FROM (SELECT *, (units * linear) // linear_sum AS linear_part, (units * decay) // decay_sum AS decay_part FROM touch_shares)""",
}

FCD = ("spend", "attributed_revenue", "cpc", "ctr", "cvr", "roas", "cac_proxy")
FCH = """date, channel, {0}, total_impressions, total_clicks, attributed_sessions, attributed_orders,
       {1}, day_of_week, promo_flag, week_index""".format(cols("total_spend"), cols("attributed_revenue"))
SEGMENT = "attributed_sessions, attributed_orders, " + cols("attributed_revenue", "attributed_spend", "CVR", "ROAS")
METRICS = "channel, attributed_orders, " + cols(
    "total_spend", "attributed_revenue", "roas", "attributed_margin", "margin_per_dollar"
)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _report(template: str, *arguments: str) -> str:
    return f"printf({', '.join([_quoted(template), *arguments])})"


def _finding_cases(part: str) -> str:
    if part == "finding":
        ends = ("best_member", "max_value", "worst_member", "min_value")
        cases = {
            ("CVR", "channel"): _report(text.CVR_CHANNEL_FINDING, "segment", *ends),
            ("CVR", "user"): _report(text.CVR_USER_FINDING, "new_value", "returning_value"),
            ("CVR", "city"): _report(text.CVR_CITY_FINDING, *ends),
            ("ROAS", "channel"): _report(text.ROAS_CHANNEL_FINDING, "segment", *ends),
            ("ROAS", "user"): _report(text.ROAS_USER_FINDING, "new_value", "returning_value"),
            ("ROAS", "city"): _report(text.ROAS_CITY_FINDING, *ends),
        }
    else:
        cases = {
            ("CVR", "channel"): _report(text.CVR_CHANNEL_ACTION, "worst_member", "segment"),
            ("CVR", "user"): _quoted(text.CVR_USER_ACTION),
            ("CVR", "city"): _report(text.CVR_CITY_ACTION, "best_member", "worst_member"),
            ("ROAS", "channel"): _report(text.ROAS_CHANNEL_ACTION, "segment", "worst_member", "segment", "best_member"),
            ("ROAS", "user"): _quoted(text.ROAS_USER_ACTION),
            ("ROAS", "city"): _report(text.ROAS_CITY_ACTION, "worst_member"),
        }
    whens = " ".join(
        f"WHEN metric = '{metric}' AND segment_kind = '{kind}' THEN {value}" for (metric, kind), value in cases.items()
    )
    return f"CASE {whens} END AS {part}"


def _lines(area_no: int, area: str, description: str, source: str, reasons: tuple, experiments: tuple) -> str:
    parts = []
    for kind, lines in (("reason", reasons), ("experiment", experiments)):
        for number, line in enumerate(lines):
            parts.append(
                f"SELECT CAST({area_no} AS INT) AS area_no, {area} AS area, {description} AS description, '{kind}' AS kind, "
                f"CAST({number} AS INT) AS line_no, {_quoted(line)} AS line FROM {source}"
            )
    return "\nUNION ALL ".join(parts)


CTES |= {
    "worst_day": "SELECT *, CAST(spend AS DOUBLE) AS s FROM waste ORDER BY spend DESC, date, campaign_id LIMIT 1",
    "worst_seg": "SELECT * FROM seg_cd ORDER BY ROAS NULLS LAST, channel, device LIMIT 1",
}


def _profile() -> str:
    tables = {
        "sessions": ("session_id", "user_id", "session_ts", "device", "channel", "campaign_id"),
        "orders": ("order_id", "session_id", "user_id", "order_ts", "gross_amount", "discount_amount", "net_amount"),
        "order_items": ("order_id", "product_id", "quantity", "unit_price"),
        "ad_spend": ("date", "campaign_id", "channel", "spend", "impressions", "clicks", "promo_flag"),
        "users": ("user_id", "signup_date", "city_tier"),
        "campaigns": ("campaign_id", "channel"),
        "products": ("product_id", "category", "cost"),
    }
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS non_null, count(*) AS n_rows, "
        f"CAST({len(columns)} AS INT) AS n_columns FROM raw_{t}"
        for t, columns in tables.items()
        for c in columns
    )


def _dq() -> str:
    rows = [
        ("sessions", "rows_read", "count(*)", "raw_sessions"),
        ("sessions", "rows_kept", "count(*)", "sessions_c"),
        ("sessions", "channel_unmapped", "count(*) - count(channel)", "sessions_c"),
        ("sessions", "campaign_missing", "count(*) - count(campaign_id)", "sessions_c"),
        ("sessions", "user_missing", "count(*) - count(user_id)", "sessions_c"),
        ("orders", "rows_read", "count(*)", "raw_orders"),
        ("orders", "rows_kept", "count(*)", "orders_c"),
        ("orders", "net_amount_missing", "count(*) - count(net_amount)", "orders_c"),
        ("orders", "outliers_capped", "count(*) FILTER (is_revenue_outlier)", "orders_c"),
        ("ad_spend", "rows_read", "count(*)", "raw_ad_spend"),
        ("ad_spend", "rows_kept", "count(*)", "ad_1"),
        ("ad_spend", "spend_filled", "count(*) - count(spend)", "ad_1"),
        ("ad_spend", "clicks_filled", "count(*) - count(clicks)", "ad_1"),
        ("ad_spend", "impressions_filled", "count(*) - count(impressions)", "ad_1"),
        ("users", "repeated_keys", "count(*) - count(DISTINCT user_id)", "raw_users"),
        ("campaigns", "repeated_keys", "count(*) - count(DISTINCT campaign_id)", "raw_campaigns"),
        ("products", "repeated_keys", "count(*) - count(DISTINCT product_id)", "raw_products"),
    ]
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{m}' AS metric, CAST({e} AS BIGINT) AS value FROM {source}"
        for t, m, e, source in rows
    )


FINAL = {
    "dedup_sessions": "SELECT session_id, user_id, session_ts, device, channel, campaign_id FROM sessions_c",
    "clean_ad_spend": f"SELECT date, campaign_id, channel, {cols('spend')}, impressions, clicks, promo_flag FROM ad_c",
    "order_outliers": f"""SELECT order_id, session_id, order_ts, is_revenue_outlier,
       {cols("gross_amount", "discount_amount", "net_amount", "net_amount_capped")} FROM orders_c""",
    "dq_report": _dq(),
    "parse_dates": """
SELECT CAST(session_ts AS DATE) AS day, count(*) AS strict_parsed, count(*) FILTER (session_id % 37 <> 0) AS coerced_parsed,
       count(*) FILTER (session_id % 37 = 0) AS coerced_to_null,
       max(CASE WHEN session_id % 37 <> 0 THEN date_trunc('second', session_ts) END) AS last_parsed
FROM raw_sessions GROUP BY 1""",
    "fact_sessions": f"""
SELECT session_id, user_id, session_ts, session_date, device, channel, campaign_id, is_new_user, purchase_flag,
       order_id, is_revenue_outlier,
       {cols("gross_amount", "discount_amount", "net_amount", "net_amount_capped", "session_to_order_sec")} FROM fs""",
    "fact_campaign_daily": f"""SELECT date, campaign_id, channel, impressions, clicks, attributed_sessions,
       attributed_orders, {cols(*FCD)} FROM fcd""",
    "fact_campaign_daily_distinct": f"""SELECT date, campaign_id, channel, impressions, clicks, attributed_sessions,
       attributed_orders, {cols(*FCD)} FROM fcd_distinct""",
    "fact_channel_daily": f"SELECT {FCH} FROM fch",
    "channel_amounts_exact": """
SELECT date, channel, CAST(CAST(total_spend AS DECIMAL(18,4)) AS VARCHAR) AS total_spend,
       CAST(CAST(attributed_revenue AS DECIMAL(18,4)) AS VARCHAR) AS attributed_revenue FROM fch""",
    "curated_rescan": f"SELECT {FCH} FROM fch",
    "sorted_facts": """
SELECT 'fact_campaign_daily' AS fact, row_number() OVER (ORDER BY date NULLS LAST, campaign_id NULLS LAST) - 1 AS position,
       date, campaign_id AS key FROM fcd
UNION ALL
SELECT 'fact_channel_daily' AS fact, row_number() OVER (ORDER BY date NULLS LAST, channel NULLS LAST) - 1 AS position,
       date, channel AS key FROM fch""",
    "channel_roas": f"""
SELECT channel, {cols("attributed_revenue", "spend")}, {r10(div("attributed_revenue", "spend"))} AS ROAS
FROM (SELECT channel, sum(attributed_revenue) AS attributed_revenue, sum(total_spend) AS spend FROM fch
      GROUP BY channel) g""",
    "campaign_daily": f"""SELECT date, campaign_id, channel, impressions, clicks, attributed_sessions, attributed_orders,
       {cols("spend", "attributed_revenue", "CPC", "CTR", "CVR", "ROAS", "CAC")} FROM cd""",
    "ad_spend_rollup": f"SELECT date, channel, {cols('spend')}, impressions, clicks, promo_flag FROM ad_roll",
    "attribution_rollup": f"""SELECT date, channel, attributed_sessions, attributed_orders,
       {cols("attributed_revenue")} FROM attr_roll""",
    "channel_daily_variant": f"""SELECT date, channel, impressions, clicks, attributed_sessions, attributed_orders,
       {cols("spend", "attributed_revenue")}, day_of_week, promo_flag, week_index FROM chd""",
    "top_campaigns_spend": f"""SELECT date, campaign_id, channel, {cols("spend")} FROM
 (SELECT * FROM cd ORDER BY spend DESC, date, campaign_id, channel LIMIT 5) t""",
    "top_campaigns_revenue": f"""SELECT date, campaign_id, channel, {cols("attributed_revenue")} FROM
 (SELECT * FROM cd ORDER BY attributed_revenue DESC, date, campaign_id, channel LIMIT 5) t""",
    "campaign_averages": f"SELECT {cols('avg_roas', 'avg_spend')} FROM means",
    "wasted_spend": f"SELECT date, campaign_id, channel, {cols('spend', 'attributed_revenue', 'ROAS')} FROM waste",
    "daily_trends": f"""SELECT date, attributed_sessions, attributed_orders, has_promo,
       {cols("daily_revenue", "spend", "daily_cvr", "daily_roas")} FROM daily""",
    "weekly_trends": f"""SELECT week_index, attributed_sessions, attributed_orders, has_promo,
       {cols("weekly_revenue", "spend", "weekly_cvr", "weekly_roas")} FROM weekly""",
    "promo_days": "SELECT date FROM daily WHERE has_promo = 1",
    "promo_weeks": "SELECT week_index FROM weekly WHERE has_promo = 1",
    "spend_per_session": f"""SELECT date, campaign_id, channel, total_sessions_in_group,
       {cols("spend", "spend_per_session")} FROM sps""",
    "sessions_with_spend": f"""SELECT session_id, order_id, session_date AS date, campaign_id, channel,
       {cols("spend_per_session")} FROM ws""",
    "seg_channel_device": f"SELECT channel, device, {SEGMENT} FROM seg_cd",
    "seg_new_user": f"""SELECT is_new_user, total_sessions, total_orders,
       {cols("total_revenue", "total_spend", "CVR", "ROAS")} FROM seg_new""",
    "seg_city_tier": f"SELECT city_tier, {SEGMENT} FROM seg_city",
    "category_performance": f"""
SELECT category, {r4("sum(revenue)")} AS gross_revenue, {r4("sum(revenue) - sum(cost)")} AS margin FROM lines
WHERE category IS NOT NULL GROUP BY category""",
    "segment_spreads": f"SELECT metric, segment_kind, segment, {cols('max_value', 'min_value', 'spread')} FROM spreads",
    "top_segments": f"""SELECT metric, rank, segment_kind, segment, {cols("spread")}, best_member, worst_member
FROM top_seg""",
    "segment_findings": f"""SELECT metric, rank, segment, {cols("spread")}, {_finding_cases("finding")},
       {_finding_cases("action")} FROM top_seg""",
    "inefficiencies": "\nUNION ALL ".join(
        [
            _lines(
                1,
                _report(text.CAMPAIGN_AREA, "campaign_id", "channel"),
                _report(text.CAMPAIGN_DESCRIPTION, "campaign_id", "channel", "s", "ROAS", "ROAS"),
                "worst_day",
                text.CAMPAIGN_REASONS,
                text.CAMPAIGN_EXPERIMENTS,
            ),
            _lines(
                2,
                _report(text.SEGMENT_AREA, "channel", "device"),
                _report(text.SEGMENT_DESCRIPTION, "channel", "device", "ROAS"),
                "worst_seg",
                text.SEGMENT_REASONS,
                text.SEGMENT_EXPERIMENTS,
            ),
        ]
    ),
    "last_touch": f"SELECT channel, {cols('attributed_revenue')}, attributed_orders FROM lt",
    "attributed_roas": f"""SELECT channel, attributed_orders,
       {cols("attributed_revenue", "spend", "attributed_ROAS")} FROM aroas""",
    "roas_comparison": f"""
SELECT s.channel, {r10("s.ROAS")} AS simple_ROAS, {r10("a.attributed_ROAS")} AS last_touch_ROAS,
       {r10("abs(s.ROAS - a.attributed_ROAS)")} AS roas_difference
FROM simple_roas s LEFT JOIN aroas a ON s.channel = a.channel""",
    "daily_regression": f"""SELECT date, day_of_week, promo_flag, is_test,
       {cols("daily_revenue", "total_spend", *(f"spend_{c}" for c in CHANNELS))} FROM reg""",
    "regression_metrics": f"""
SELECT count(*) AS n_test,
       {r4("1 - sum((daily_revenue - p) * (daily_revenue - p)) / (var_pop(daily_revenue) * count(*))")} AS r2,
       {r4("avg(abs(daily_revenue - p))")} AS mae,
       {r4("100 * avg(abs((daily_revenue - p) / daily_revenue)) FILTER (daily_revenue <> 0)")} AS mape
FROM predicted WHERE is_test""",
    "regression_coefficients": f"""SELECT feature, {cols("coefficient")},
       {r4("abs(coefficient)")} AS absolute_coefficient,
       CAST(row_number() OVER (ORDER BY round(abs(coefficient), 6) DESC, feature) AS INT) AS rank FROM coef""",
    "channel_performance": f"""
SELECT a.channel, {r10("a.attributed_ROAS")} AS attributed_ROAS, {r4("c.coefficient")} AS regression_coefficient,
       {r4("c.coefficient + (SELECT b FROM shared)")} AS marginal_effect
FROM aroas a LEFT JOIN coef c ON c.feature = 'spend_' || a.channel""",
    "order_margin": f"SELECT order_id, {cols('revenue', 'cost', 'margin')} FROM omargin",
    "margin_by_channel": f"""
SELECT channel, {r4("coalesce(sum(margin), 0)")} AS attributed_margin
FROM (SELECT * FROM fs WHERE purchase_flag = 1
      QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY session_ts, session_id) = 1) o
LEFT JOIN omargin m ON o.order_id = m.order_id WHERE channel IS NOT NULL GROUP BY channel""",
    "channel_metrics": f"SELECT {METRICS} FROM metrics_90",
    "channel_metrics_lookback": f"SELECT {METRICS} FROM ({metrics(9)}) m",
    "channel_metrics_all_margin": f"SELECT {METRICS} FROM ({metrics(9, True)}) m",
    "rounded_report": """SELECT channel, attributed_orders, """
    + ", ".join(
        f"round_even(CAST({c} AS DOUBLE), 2) AS {c}"
        for c in ("total_spend", "attributed_revenue", "roas", "attributed_margin", "margin_per_dollar")
    )
    + " FROM metrics_90",
    "allocate_share": "SELECT scenario_id, channel, "
    + cols("budget_total", "allocated_spend", "allocated_pct", "unallocated", "roas", "margin_per_dollar", digits=2)
    + " FROM share",
    "allocate_share_campaigns": "SELECT scenario_id, channel, "
    + cols("budget_total", "allocated_spend", "allocated_pct", "unallocated", "roas", "margin_per_dollar", digits=2)
    + " FROM many",
    "impact": "SELECT scenario_id, channel, "
    + cols(
        "allocated_spend", "allocated_pct", "roas", "margin_per_dollar", "base_revenue", "best_revenue",
        "worst_revenue", "base_margin", "best_margin", "worst_margin", digits=2,
    )
    + " FROM impact_rows",
    "impact_totals": "SELECT scenario_id, "
    + ", ".join(
        f"{rounded(f'sum({c})', 2)} AS {c}"
        for c in ("base_revenue", "best_revenue", "worst_revenue", "base_margin", "best_margin", "worst_margin")
    )
    + " FROM impact_rows GROUP BY scenario_id",
    "sensitivity": f"""
SELECT scenario_id, CAST(r AS INT) AS roas_change_pct, CAST(b AS INT) AS budget_change_pct,
       {rounded("sum(allocated_spend * roas) * (1 + r / 100.0e0) * (1 + b / 100.0e0)", 2)} AS estimated_revenue
FROM share CROSS JOIN (VALUES (-10), (0), (10)) x(r) CROSS JOIN (VALUES (-10), (0), (10)) y(b)
GROUP BY scenario_id, r, b""",
    "allocate_bounds": "SELECT scenario_id, channel, infeasible, "
    + cols("budget_total", "min_spend", "max_spend", "weight", "allocated_spend")
    + " FROM bounds",
    "allocation_totals": f"""
SELECT scenario_id, {r4("sum(allocated_spend)")} AS allocated,
       {r4("max(budget_total) - sum(allocated_spend)")} AS left_over, bool_or(infeasible) AS infeasible
FROM bounds GROUP BY scenario_id""",
    "revenue_impact": impact_of_plan(
        "30", "greatest(increase * 1.1e0, increase * 0.9e0)", "least(increase * 1.1e0, increase * 0.9e0)"
    ),
    "revenue_impact_full_history": impact_of_plan("h.n_days", "increase * 1.1e0", "increase * 0.9e0"),
    "coefficient_intervals": f"""
SELECT c.feature, {r4("any_value(c.coefficient)")} AS coefficient, {r4("quantile_cont(b.coefficient, 0.025)")} AS lower,
       {r4("quantile_cont(b.coefficient, 0.975)")} AS upper,
       {r4("avg(CAST(round(b.coefficient, 9) > 0 AS INT))")} AS positive_share, count(*) AS replicates
FROM coef c JOIN boot_coef b ON b.feature = c.feature GROUP BY c.feature""",
    "daily_exact_split": """
SELECT date, row_number() OVER (ORDER BY CAST('0x' || substr(md5(':' || strftime(date, '%Y-%m-%d')), 1, 15) AS BIGINT), date)
             <= ceil(0.2 * count(*) OVER ()) AS is_test FROM reg""",
    "rolling_roas": f"""SELECT date, channel, {cols("spend_sum", "revenue_sum")}, {r10("rolling_roas")} AS rolling_roas,
       {r10("previous_roas")} AS previous_roas, {r10("rolling_roas - previous_roas")} AS roas_change
FROM (SELECT *, {div("revenue_sum", "spend_sum", "NULL")} AS rolling_roas,
             {div("revenue_before", "spend_before", "NULL")} AS previous_roas FROM frames) f""",
    "allocate_optimal": f"SELECT scenario_id, channel, {cols('budget_total', 'value', 'lower', 'upper', 'optimal_spend', digits=2)} FROM best_plan",
    "optimal_gap": f"""
SELECT scenario_id, {cols("optimal_revenue", "rule_revenue", digits=2)}, {rounded("optimal_revenue - rule_revenue", 2)} AS loss,
       {rounded("100 * (" + div("optimal_revenue - rule_revenue", "optimal_revenue") + ")", 2)} AS loss_pct
FROM (SELECT p.scenario_id, sum(optimal_spend * value) AS optimal_revenue, sum(allocated_spend * value) AS rule_revenue
      FROM best_plan p JOIN share s ON s.scenario_id = p.scenario_id AND s.channel = p.channel GROUP BY 1) g""",
    "allocate_optimal_bounds": f"SELECT scenario_id, channel, {cols('budget_total', 'value', 'lower', 'upper', 'optimal_spend', digits=2)} FROM best_bounds",
    "distinct_rollups": """
SELECT 'channel' AS grain, c.channel, CAST(NULL AS DATE) AS week, count(DISTINCT session_id) AS sessions,
       count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE purchase_flag = 1) AS buyers
FROM fs LEFT JOIN campaigns_c c ON c.campaign_id = fs.campaign_id GROUP BY 2
UNION ALL SELECT 'week', NULL, CAST(date_trunc('week', session_date) AS DATE), count(DISTINCT session_id), count(DISTINCT user_id),
       count(DISTINCT user_id) FILTER (WHERE purchase_flag = 1) FROM fs GROUP BY 3
UNION ALL SELECT 'total', NULL, NULL, count(DISTINCT session_id), count(DISTINCT user_id),
       count(DISTINCT user_id) FILTER (WHERE purchase_flag = 1) FROM fs""",
    "sketches_within_bounds": """
SELECT CAST(date_trunc('week', session_date) AS DATE) AS week, count(order_id) AS orders, count(DISTINCT user_id) AS users,
       true AS users_fit, true AS q50_fits, true AS q90_fits FROM fs GROUP BY 1""",
    "quarantined_rows": f"""
SELECT CASE WHEN order_id % 13 = 0 AND order_id % 17 = 0 THEN 'order_ts: soon; net_amount: 1.2.3'
            WHEN order_id % 13 = 0 THEN 'order_ts: soon' WHEN order_id % 17 = 0 THEN 'net_amount: 1.2.3' ELSE 'none' END AS reason,
       count(*) AS n, {r4(f"sum(CASE WHEN order_id % 17 <> 0 THEN {money('net_amount')} END)")} AS net_amount
FROM raw_orders GROUP BY 1""",
    "preceding_session": f"""SELECT order_id, user_id, order_ts, {cols("revenue")}, session_id, touch_session_id, touch_ts,
       touch_channel FROM preceding""",
    "preceding_touch": f"""
SELECT touch_channel AS channel, {r4("sum(revenue)")} AS attributed_revenue, count(order_id) AS attributed_orders,
       count(*) FILTER (WHERE session_id <> touch_session_id) AS other_session_orders
FROM preceding WHERE touch_channel IS NOT NULL GROUP BY 1""",
    "multi_touch_credits": f"SELECT order_id, channel, touches, {cols('linear_credit', 'decay_credit')} FROM credits",
    "multi_touch": f"""
SELECT channel, {r4("sum(linear_credit)")} AS linear_revenue, {r4("sum(decay_credit)")} AS decay_revenue,
       count(*) AS assisted_orders FROM credits GROUP BY channel""",
    "source_profile": _profile(),
    "csv_roundtrip": """SELECT session_id, user_id, session_ts, device, channel, campaign_id FROM sessions_1""",
    "weekly_regression": f"""
SELECT week_index, {cols("daily_revenue", "total_spend", *(f"spend_{c}" for c in CHANNELS))}, promo_flag
FROM (SELECT week_index, CAST(sum(attributed_revenue) AS DOUBLE) AS daily_revenue,
             CAST(sum(spend) AS DOUBLE) AS total_spend, max(promo_flag) AS promo_flag,
             {", ".join(f"CAST(coalesce(sum(spend) FILTER (channel = '{c}'), 0) AS DOUBLE) AS spend_{c}" for c in CHANNELS)}
      FROM chd GROUP BY week_index) w""",
    "csv_quoted_text": f"""SELECT product_id,
       ' "' || category || '", sale' || chr(10) || product_id || ' ,"" ' AS category, {cols('cost')} FROM raw_products""",
    "curated_coerced": f"""SELECT CASE WHEN day(date) % 5 <> 0 THEN date END AS date, channel,
       {r4("sum(total_spend)")} AS total_spend FROM fch GROUP BY 1, 2""",
    "repeated_lookups": """
SELECT signup_date, city_tier, count(*) AS n
FROM (SELECT CASE WHEN user_id % 7 = 0 AND user_id % 2 = 1 THEN CAST(signup_date - INTERVAL 1 DAY AS DATE)
                  ELSE signup_date END AS signup_date,
             CASE WHEN user_id % 7 = 0 AND user_id % 2 = 1 THEN NULL ELSE city_tier END AS city_tier FROM raw_users)
GROUP BY 1, 2
UNION ALL SELECT NULL, -1, count(*) FROM raw_order_items WHERE product_id IN (SELECT product_id FROM raw_products)""",
    "json_roundtrip": f"SELECT product_id, category, {cols('cost')} FROM raw_products",
    "missing_source": """SELECT device, count(*) AS session_rows, CAST(0 AS BIGINT) AS known_users FROM raw_sessions
GROUP BY device""",
}
FINAL |= {"late_facts": FINAL["fact_sessions"], "allocate_share_rounds": FINAL["allocate_share_campaigns"]}


def statement(final: str) -> str:
    """The final SELECT behind just those named subqueries it needs."""
    needed: set[str] = set()
    pending = [final]
    while pending:
        body = pending.pop()
        for name in set(re.findall(r"\w+", body)) & CTES.keys() - needed:
            needed.add(name)
            pending.append(CTES[name])
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in CTES.items() if name in needed)
    return f"WITH {ctes}\n{final}" if ctes else final


def oracle_statements() -> dict[str, str]:
    return {name: statement(final) for name, final in FINAL.items()}
