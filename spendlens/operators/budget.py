"""Channel margin, bounded budget allocation over many scenarios at once, impact and sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.config import CHANNELS, BoundsScenario, BudgetConfig, LayoutConfig, ShareScenario
from spendlens.functions.columns import money_sum, ratio, struct_rows, whole_sum
from spendlens.operators.regression import OlsFit
from spendlens.operators.segments import enrich_order_items
from spendlens.session import materialize

TOLERANCE = 1e-6


# --- Margin and channel metrics ------------------------------------------------------------------------------------


def order_margin(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, cost and margin per order, from lines with a known product."""
    return (
        enrich_order_items(order_items, products)
        .groupBy("order_id")
        .agg(money_sum("revenue").alias("revenue"), money_sum("cost").alias("cost"))
        .withColumn("margin", F.col("revenue") - F.col("cost"))
    )


def order_channels(fact_sessions: DataFrame) -> DataFrame:
    """One channel per order: that of its earliest purchase session."""
    first = Window.partitionBy("order_id").orderBy("session_ts", "session_id")
    return (
        fact_sessions.where("purchase_flag = 1")
        .select("order_id", "channel", "session_date", "session_ts", "session_id")
        .withColumn("rn", F.row_number().over(first))
        .where("rn = 1")
        .select("order_id", "channel", "session_date")
    )


def margin_by_channel(orders_to_channel: DataFrame, margins: DataFrame, since: Column | None = None) -> DataFrame:
    """Margin per channel; orders without lines add nothing. ``since`` keeps orders from that date on."""
    orders = orders_to_channel if since is None else orders_to_channel.where(F.col("session_date") >= since)
    return (
        orders.where(F.col("channel").isNotNull())
        .join(margins.select("order_id", "margin"), "order_id", "left")
        .groupBy("channel")
        .agg(F.coalesce(money_sum("margin"), F.lit(0)).alias("attributed_margin"))
    )


def lookback_start(fact_channel_daily: DataFrame, lookback_days: int) -> Column:
    """First date of the lookback, both ends included. Reads the table once more, so hand over a stored one."""
    return fact_channel_daily.agg(F.date_sub(F.max("date"), lookback_days)).scalar()


def channel_metrics(fact_channel_daily: DataFrame, margins: DataFrame, since: Column) -> DataFrame:
    """Spend, revenue, orders, ROAS and margin per dollar per channel since a date."""
    totals = (
        fact_channel_daily.where(F.col("date") >= since)
        .groupBy("channel")
        .agg(
            money_sum("total_spend").alias("total_spend"),
            money_sum("attributed_revenue").alias("attributed_revenue"),
            whole_sum("attributed_orders").alias("attributed_orders"),
        )
    )
    return (
        totals.join(margins, "channel", "left")
        .fillna(0, ["attributed_margin"])
        .withColumns(
            {
                "roas": ratio("attributed_revenue", "total_spend"),
                "margin_per_dollar": ratio("attributed_margin", "total_spend"),
            }
        )
        .select(
            "channel", "total_spend", "attributed_revenue", "attributed_orders", "roas",
            "attributed_margin", "margin_per_dollar",
        )
    )


# --- Allocation by share -------------------------------------------------------------------------------------------


def _shared(channels: str, budget: str) -> Column:
    """The channels with ``allocated``: floors first, then rounds that share the rest by weight x headroom."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    def fold(each: Column) -> Column:
        def one_round(spent: Column, _: Column) -> Column:
            pull = F.zip_with(spent, each, lambda a, c: c["weight"] * F.greatest(F.lit(0.0), c["cap_spend"] - a))
            totals = F.array(F.struct((F.col(budget) - total(spent)).alias("rest"), total(pull).alias("pull")))

            def add(t: Column) -> Column:
                def more(a: Column, c: Column) -> Column:
                    room = F.greatest(F.lit(0.0), c["cap_spend"] - a)
                    share = F.least(t["rest"] * c["weight"] * room / t["pull"], room)
                    return a + F.when((t["rest"] > TOLERANCE) & (t["pull"] > 0), share).otherwise(F.lit(0.0))

                return F.zip_with(spent, each, more)

            return F.transform(totals, add).getItem(0)

        floors = F.transform(each, lambda c: c["floor_spend"])
        spent = F.aggregate(F.sequence(F.lit(1), F.size(each)), floors, one_round)
        return F.zip_with(each, spent, lambda c, a: c.withField("allocated", a))

    return F.transform(F.array(F.col(channels)), fold).getItem(0)  # one element: the array is evaluated once


def _folded(rows: DataFrame) -> DataFrame:
    """``allocated`` by a fold over one array per scenario."""
    columns = ("channel", "roas", "margin_per_dollar", "weight", "floor_spend", "cap_spend")
    return (
        rows.groupBy("scenario_id", "budget_total", "n")
        .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("channels"))
        .select("scenario_id", "budget_total", "n", _shared("channels", "budget_total").alias("shared"))
        .selectExpr("scenario_id", "budget_total", "n", "inline(shared)")
    )


def _in_rounds(rows: DataFrame) -> DataFrame:
    """``allocated`` by rounds over the table: what is left and what pulls are two sums per scenario, combined before the
    shuffle. A round is stored; the driver sees whether one more is needed, no rows. Ends when nothing is left to share."""
    state = materialize(rows.withColumn("allocated", F.col("floor_spend")), "round")
    room = F.greatest(F.lit(0.0), F.col("cap_spend") - F.col("allocated"))
    while True:
        totals = state.groupBy("scenario_id").agg(
            (F.max("budget_total") - F.sum("allocated")).alias("rest"), F.sum(F.col("weight") * room).alias("pull")
        )
        unshared = materialize(totals.where((F.col("rest") > TOLERANCE) & (F.col("pull") > 0)), "rest")
        if unshared.isEmpty():
            return state
        share = F.when(F.col("rest").isNotNull(), F.least(F.col("rest") * F.col("weight") * room / F.col("pull"), room))
        shared = state.join(F.broadcast(unshared), "scenario_id", "left")  # as many rows as the caller has scenarios
        state = materialize(
            shared.withColumn("allocated", F.col("allocated") + F.coalesce(share, F.lit(0.0))).drop("rest", "pull"), "round"
        )


def allocate_by_share(
    metrics: DataFrame,
    scenarios: tuple[ShareScenario, ...] = (ShareScenario(),),
    rescale: bool = False,
    array_channels: int = LayoutConfig.array_channels,
) -> DataFrame:
    """Minimum share to every channel, the rest by ROAS x headroom up to the maximum share, overflow shared again.

    Each round fills at least one channel or spends the rest. Up to ``array_channels`` channels the channels of a scenario
    are one array and the rounds a fold over it, in one plan; more are shared in rounds over the table, so that no task
    holds a scenario. When the maxima cannot hold the budget the remainder is reported as ``unallocated``; ``rescale``
    spreads it over the caps instead. ``metrics`` is counted first, so hand over a stored table.
    """
    everyone = "OVER (PARTITION BY scenario_id)"
    rows = (
        metrics.select(
            "channel", "roas", "margin_per_dollar", F.explode(struct_rows([vars(s) for s in scenarios])).alias("s")
        )
        .selectExpr("*", "s.*", "coalesce(roas, 0D) AS weight", "count(1) OVER (PARTITION BY s.scenario_id) AS n")
        .selectExpr(
            "scenario_id", "channel", "budget_total", "roas", "margin_per_dollar", "weight", "n",
            "least(budget_total * min_pct, budget_total / n) AS floor_spend",
            "budget_total * max_pct AS cap_spend",
        )
    )
    few = metrics.limit(array_channels + 1).count() <= array_channels
    plan = (
        (_folded(rows) if few else _in_rounds(rows))
        .selectExpr("*", f"sum(weight) {everyone} AS weight_sum")
        .selectExpr(
            "*",
            """CASE WHEN weight_sum > 0 THEN least(greatest(allocated, floor_spend), cap_spend)
               ELSE budget_total / n END AS plan""",
        )
    )
    allotted = f"sum(plan) {everyone}"
    spend = f"plan / {allotted} * budget_total" if rescale else "plan"
    return plan.selectExpr(
        "scenario_id",
        "channel",
        "budget_total",
        f"{spend} AS allocated_spend",
        f"{spend} / budget_total AS allocated_pct",
        f"budget_total - {allotted} AS unallocated",
        "roas",
        "margin_per_dollar",
    )


def impact_estimates(allocation: DataFrame, config: BudgetConfig = BudgetConfig()) -> DataFrame:
    """Base, best and worst revenue and margin of each channel's allocation (which carries the channel's rates)."""
    rates = {"revenue": "roas", "margin": "margin_per_dollar"}
    cases = {"base": 1.0, "best": config.best_multiplier, "worst": config.worst_multiplier}
    return allocation.select(
        "scenario_id", "channel", "allocated_spend", "allocated_pct", "roas", "margin_per_dollar",
        *[
            (F.col("allocated_spend") * F.col(rate) * F.lit(factor)).alias(f"{case}_{measure}")
            for measure, rate in rates.items()
            for case, factor in cases.items()
        ],
    )


def impact_totals(impact: DataFrame) -> DataFrame:
    columns = [f"{case}_{measure}" for measure in ("revenue", "margin") for case in ("base", "best", "worst")]
    return impact.groupBy("scenario_id").agg(*[F.sum(c).alias(c) for c in columns])


def sensitivity(allocation: DataFrame, config: BudgetConfig = BudgetConfig()) -> DataFrame:
    """Total revenue when ROAS and budget shift by the given percentages."""
    grid = [
        {"roas_change_pct": r, "budget_change_pct": b}
        for r in config.roas_changes_pct
        for b in config.budget_changes_pct
    ]
    scale = (1 + F.col("roas_change_pct") / 100) * (1 + F.col("budget_change_pct") / 100)
    return (
        allocation.withColumn("cell", F.explode(struct_rows(grid)))
        .select("scenario_id", "allocated_spend", "roas", "cell.*")
        .groupBy("scenario_id", "roas_change_pct", "budget_change_pct")
        .agg(F.sum(F.col("allocated_spend") * F.col("roas") * scale).alias("estimated_revenue"))
    )


# --- The best allocation there is ----------------------------------------------------------------------------------


def share_limits(metrics: DataFrame, scenarios: tuple[ShareScenario, ...] = (ShareScenario(),)) -> DataFrame:
    """The limits of ``allocate_by_share`` as rows: ``lower`` and ``upper`` spend of each channel and its ``value``, the
    revenue of a unit spent."""
    return (
        metrics.select("channel", "roas", F.explode(struct_rows([vars(s) for s in scenarios])).alias("s"))
        .selectExpr("channel", "coalesce(roas, 0D) AS value", "s.*", "count(1) OVER (PARTITION BY s.scenario_id) AS n")
        .selectExpr(
            "scenario_id", "channel", "budget_total", "value",
            "least(budget_total * min_pct, budget_total / n, budget_total * max_pct) AS lower",
            "budget_total * max_pct AS upper",
        )
    )


def bounds_limits(
    performance: DataFrame,
    scenarios: tuple[BoundsScenario, ...] = (BoundsScenario(),),
    weight: str = "regression_coefficient",
) -> DataFrame:
    """The limits of ``allocate_by_bounds`` as rows."""
    limits = performance.sparkSession.createDataFrame(
        [
            (s.scenario_id, s.budget_total, b.channel, b.min_spend, b.max_spend, dict(s.weight_factor).get(b.channel, 1.0))
            for s in scenarios
            for b in s.bounds
        ],
        "scenario_id string, budget_total double, channel string, lower double, upper double, factor double",
    )
    value = F.coalesce(F.col("raw") * F.col("factor"), F.lit(0.0))
    return limits.join(performance.select("channel", F.col(weight).alias("raw")), "channel", "left").select(
        "scenario_id", "channel", "budget_total", value.alias("value"), "lower", "upper"
    )


def optimal_spend(limits: DataFrame, whole_budget: bool = True) -> DataFrame:
    """The allocation of greatest revenue inside the limits: ``limits`` with ``optimal_spend``.

    Revenue is linear, so the best plan gives every channel its lower limit and then fills the channels one after the
    other, by value: two running sums and no rounds. Equal values go by channel name. ``whole_budget`` spends what the
    upper limits can take even where it earns nothing; without it only channels of positive value get more than their
    lower limit. Lower limits above the budget stay as they are (nothing is spare then).
    """
    everyone = Window.partitionBy("scenario_id")
    better = everyone.orderBy(F.desc("value"), "channel").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.col("upper") - F.col("lower"), F.lit(0.0))
    return (
        limits.withColumn("room", room if whole_budget else F.when(F.col("value") > 0, room).otherwise(0.0))
        .withColumns(
            {
                "spare": F.greatest(F.col("budget_total") - F.sum("lower").over(everyone), F.lit(0.0)),
                "taken": F.coalesce(F.sum("room").over(better), F.lit(0.0)),
            }
        )
        .withColumn("optimal_spend", F.col("lower") + F.least("room", F.greatest(F.col("spare") - F.col("taken"), F.lit(0.0))))
        .drop("room", "spare", "taken")
    )


def optimal_gap(optimal: DataFrame, allocation: DataFrame) -> DataFrame:
    """Revenue of the best plan and of ``allocation`` (``allocated_spend``) per scenario, and what the latter loses."""
    pairs = optimal.join(allocation.select("scenario_id", "channel", "allocated_spend"), ["scenario_id", "channel"], "left")
    return (
        pairs.groupBy("scenario_id")
        .agg(
            F.sum(F.col("optimal_spend") * F.col("value")).alias("optimal_revenue"),
            F.sum(F.coalesce("allocated_spend", F.lit(0.0)) * F.col("value")).alias("rule_revenue"),
        )
        .withColumn("loss", F.col("optimal_revenue") - F.col("rule_revenue"))
        .withColumn("loss_pct", 100 * ratio("loss", "optimal_revenue"))
    )


# --- Allocation inside absolute limits -----------------------------------------------------------------------------


def allocate_by_bounds(
    performance: DataFrame,
    scenarios: tuple[BoundsScenario, ...] = (BoundsScenario(),),
    weight: str = "regression_coefficient",
) -> DataFrame:
    """Minimum spend to every channel, the rest in proportion to positive weights, never above the maximum.

    Sharing the rest until nothing moves ends where every channel has min(room, level x weight) for one common level.
    Ordered by room / weight, the channels before some point are full; the level follows from two running sums, with
    no rounds at all. Channels with no positive weight keep their minimum. Minima above the budget are flagged.
    """
    spark = performance.sparkSession
    limits = spark.createDataFrame(
        [
            (s.scenario_id, s.budget_total, b.channel, b.min_spend, b.max_spend, dict(s.weight_factor).get(b.channel, 1.0))
            for s in scenarios
            for b in s.bounds
        ],
        "scenario_id string, budget_total double, channel string, min_spend double, max_spend double, factor double",
    )
    everyone = Window.partitionBy("scenario_id")
    by_fill = everyone.orderBy(F.asc_nulls_last("fill_level"), "channel")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        limits.join(performance.select("channel", F.col(weight).alias("raw_weight")), "channel", "left")
        .withColumn("gap", F.col("max_spend") - F.col("min_spend"))
        .withColumn("weight", F.col("raw_weight") * F.col("factor"))
        .withColumn("open", F.coalesce((F.col("weight") > 0) & (F.col("gap") > 0), F.lit(False)))
        .withColumns(
            {
                "room": F.when(F.col("open"), F.col("gap")).otherwise(0.0),
                "pull": F.when(F.col("open"), F.col("weight")).otherwise(0.0),
                "spare": F.col("budget_total") - F.sum("min_spend").over(everyone),
            }
        )
        .withColumn("fill_level", F.when(F.col("open"), F.col("room") / F.col("pull")))
        .withColumns(
            {
                "room_before": F.coalesce(F.sum("room").over(before), F.lit(0.0)),
                "pull_from": F.sum("pull").over(everyone) - F.coalesce(F.sum("pull").over(before), F.lit(0.0)),
            }
        )
        .withColumn("level", F.when(F.col("open"), (F.col("spare") - F.col("room_before")) / F.col("pull_from")))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("fill_level"), F.col("level"))).over(everyone))
    )
    # No level found: even the full rooms do not use up the budget.
    extra = F.least("room", F.coalesce(F.col("level") * F.col("pull"), F.col("room")))
    return rows.withColumns(
        {
            "allocated_spend": F.round(
                F.col("min_spend") + F.when(F.col("spare") > 0, extra).otherwise(F.lit(0.0)), 2
            ),
            "infeasible": F.col("spare") < 0,
        }
    ).select(
        "scenario_id", "channel", "budget_total", "min_spend", "max_spend",
        F.col("raw_weight").alias("weight"), "allocated_spend", "infeasible",
    )


def allocation_totals(allocation: DataFrame) -> DataFrame:
    """Allocated and left-over budget per scenario."""
    return allocation.groupBy("scenario_id").agg(
        F.sum("allocated_spend").alias("allocated"),
        (F.max("budget_total") - F.sum("allocated_spend")).alias("left_over"),
        F.bool_or("infeasible").alias("infeasible"),
    )


def revenue_impact(
    history: DataFrame, fit: OlsFit, allocation: DataFrame, config: BudgetConfig = BudgetConfig(), parity: bool = False
) -> DataFrame:
    """Model revenue over the history against the same days at the allocated spend, with best and worst cases.

    The allocation covers ``horizon_days`` (None: all days of the history). ``history`` is the daily table, a row per
    day. ``parity`` keeps best = +variation even for a negative change, where it is the worse number.
    """
    days = history.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum(fit.prediction()).alias("baseline"),
        F.avg("day_of_week").alias("day_of_week"),
        F.avg("promo_flag").alias("promo_flag"),
    )
    n_days = days.select("n_days").scalar()
    horizon = n_days if config.horizon_days is None else F.lit(config.horizon_days)
    weight = F.coalesce(
        *[
            F.when(F.col("channel") == channel, F.lit(fit.coefficients[f"spend_{channel}"]).cast("double"))
            for channel in CHANNELS
        ],
        F.lit(0.0),
    )
    coefficient = {f: F.lit(w).cast("double") for f, w in fit.coefficients.items()}
    per_day = (
        F.lit(fit.intercept).cast("double")
        + coefficient["day_of_week"] * days.select("day_of_week").scalar()
        + coefficient["promo_flag"] * days.select("promo_flag").scalar()
        + coefficient["total_spend"] * F.col("plan_spend") / horizon
        + F.col("weighted_spend") / horizon
    )
    change = F.col("increase")
    up, down = change * (1 + config.variation), change * (1 - config.variation)
    return (
        allocation.groupBy("scenario_id")
        .agg(
            F.sum("allocated_spend").alias("plan_spend"),
            F.sum(F.col("allocated_spend") * weight).alias("weighted_spend"),
        )
        .withColumns({"baseline_revenue": days.select("baseline").scalar(), "new_revenue": per_day * n_days})
        .withColumn("increase", F.col("new_revenue") - F.col("baseline_revenue"))
        .withColumns(
            {
                "best_increase": up if parity else F.greatest(up, down),
                "worst_increase": down if parity else F.least(up, down),
            }
        )
        .select("scenario_id", "baseline_revenue", "new_revenue", "increase", "best_increase", "worst_increase")
    )
