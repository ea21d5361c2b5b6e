"""Attribution over a user's earlier sessions: the session before each order, and credit shared by all recent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spendlens.config import CHANNELS, TouchConfig
from spendlens.functions.columns import money_sum
from spendlens.schemas import MONEY, MONEY_TOTAL
from spendlens.session import materialize

#: Sessions whose channel is unknown are touches too, so that credits add up to all revenue.
SLOTS: tuple[str | None, ...] = (*CHANNELS, None)
#: Money has four decimals; credits are shared in whole units of the last one.
UNITS = 10 ** MONEY.scale


def _orders(fact_sessions: DataFrame, revenue_column: str) -> DataFrame:
    """The fact's rows with an order; its time is the session's plus the seconds to it, exact to the microsecond."""
    after = "make_dt_interval(0, 0, 0, CAST(session_to_order_sec AS DECIMAL(18,6)))"
    return fact_sessions.where("order_id IS NOT NULL").select(
        "user_id", F.expr(f"session_ts + {after}").alias("ts"), "session_id", "session_ts", "channel", "order_id",
        F.col(revenue_column).alias("revenue"),
    )


def _timeline(fact_sessions: DataFrame, revenue_column: str) -> DataFrame:
    """Sessions (kind 0) and orders (kind 1) of known users on one time line, by user and day.

    An order belongs to the user of its session. A session with two orders is one touch.
    """
    touches = (
        fact_sessions.select("user_id", "session_ts", "session_id", "channel")
        .distinct()
        .select("user_id", F.col("session_ts").alias("ts"), F.lit(0).alias("kind"), "session_id", "channel")
    )
    orders = _orders(fact_sessions, revenue_column).drop("session_ts").withColumn("kind", F.lit(1))
    rows = touches.unionByName(orders, allowMissingColumns=True).where("user_id IS NOT NULL AND ts IS NOT NULL")
    return rows.withColumn("day", F.to_date("ts"))


def _alone(fact_sessions: DataFrame, revenue_column: str) -> DataFrame:
    """Orders that cannot be placed on a time line: no user or no time."""
    return _orders(fact_sessions, revenue_column).where("user_id IS NULL OR ts IS NULL")


def _so_far() -> WindowSpec:
    """Up to and including each row of a user's day; at one instant sessions come before orders, then by session id."""
    day = Window.partitionBy("user_id", "day").orderBy("ts", "kind", "session_id")
    return day.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def preceding_sessions(fact_sessions: DataFrame, revenue_column: str = "gross_amount") -> DataFrame:
    """Each order with the last session of its user that started before it (or at the same instant): ``order_id``,
    ``user_id``, ``order_ts``, ``revenue``, its own ``session_id``, and ``touch_session_id``, ``touch_ts``, ``touch_channel``.

    An as-of join without an inequality: within a user's day the last session is a running value over one sorted time
    line; the last session of the days before is carried in by a window over one row per user and day. No task holds more
    than a user's day. Of sessions that start together the greatest id counts. Orders without a user have only their own
    session, if it started before them; orders without a time have none.
    """
    rows = materialize(_timeline(fact_sessions, revenue_column), "timeline")
    touch = F.when(F.col("kind") == 0, F.struct("ts", "session_id", "channel"))
    earlier = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("user_id", "day")
        .agg(F.max(touch).alias("latest"))
        .select("user_id", "day", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
    )
    orders = rows.withColumn("seen", F.last(touch, ignorenulls=True).over(_so_far())).where("kind = 1")
    known = orders.join(carried, ["user_id", "day"], "left").withColumn("touch", F.coalesce("seen", "carried"))
    own = F.when(F.col("session_ts") <= F.col("ts"), F.struct(F.col("session_ts").alias("ts"), "session_id", "channel"))
    columns = [
        "order_id", "user_id", F.col("ts").alias("order_ts"), "revenue", "session_id",
        F.col("touch.session_id").alias("touch_session_id"), F.col("touch.ts").alias("touch_ts"),
        F.col("touch.channel").alias("touch_channel"),
    ]
    return known.select(*columns).unionByName(
        _alone(fact_sessions, revenue_column).withColumn("touch", own).select(*columns)
    )


def preceding_touch(preceding: DataFrame) -> DataFrame:
    """Revenue and orders per channel of the preceding session; orders without one stay out."""
    return (
        preceding.where("touch_channel IS NOT NULL")
        .groupBy(F.col("touch_channel").alias("channel"))
        .agg(
            money_sum("revenue").alias("attributed_revenue"),
            F.count("order_id").alias("attributed_orders"),
            F.count_if(F.col("session_id") != F.col("touch_session_id")).alias("other_session_orders"),
        )
    )


def _counts(here: Column) -> list[Column]:
    return [F.count_if(here & F.col("channel").eqNullSafe(F.lit(c))) for c in SLOTS]


def _credits(weights: str) -> Column:
    """Units of the amount ``units`` for each slot, in proportion to ``weights``, by largest remainders: whole units that
    add up to the amount. Equal remainders go by the order of the slots."""
    amount, each = "CAST(abs(units) AS DECIMAL(20,0))", "CAST({} AS DECIMAL(17,0))"
    total = f"aggregate({weights}, CAST(0 AS DECIMAL(17,0)), (a, w) -> CAST(a + w AS DECIMAL(17,0)))"
    # One-element arrays: what a lambda is applied to is computed once.
    shares = f"""transform(array({total}), t -> transform({weights}, (w, k) -> struct(
        -(({amount} * {each.format('w')}) % t) AS rest, k, ({amount} * {each.format('w')}) div t AS share)))[0]"""
    dealt = f"""transform(array(array_sort({shares})), s -> transform(
        array(abs(units) - aggregate(s, 0L, (a, x) -> a + x.share)), more -> array_sort(transform(
            s, (x, i) -> struct(x.k, CAST(sign(units) AS BIGINT) * (x.share + IF(i < more, 1L, 0L)) AS credit))))[0])[0]"""
    return F.expr(f"transform({dealt}, x -> x.credit)")


def multi_touch_credits(
    fact_sessions: DataFrame, config: TouchConfig = TouchConfig(), revenue_column: str = "gross_amount"
) -> DataFrame:
    """``order_id``, ``channel``, ``touches`` and its ``linear_credit`` and ``decay_credit`` of the order's revenue.

    Touches of an order are the sessions of its user up to it, on its day and ``lookback_days`` before. Linear: each has the
    same weight. Decay: half of it for every ``half_life_days`` between the days, as whole numbers (2 ** 20 on the day
    itself), so that sums do not depend on their order. Credits of an order add up to its revenue exactly. Unknown channels
    are a channel of their own (null). Orders without a user or time, or without a touch that recent, credit their own
    session.

    Touches are never paired with orders: they are counted per channel, running within a user's day, and per day for the
    days before, of which an order's day gathers at most ``lookback_days`` rows.
    """
    rows = materialize(_timeline(fact_sessions, revenue_column), "timeline")
    touch = F.col("kind") == 0
    days = rows.groupBy("user_id", "day").agg(F.array(*_counts(touch)).alias("counts"), F.max("kind").alias("orders"))
    before = Window.partitionBy("user_id").orderBy(F.unix_date("day")).rangeBetween(-config.lookback_days, -1)
    weight = F.array(*[F.lit(w).cast("long") for w in config.day_weights])

    def past(slot: int, weighted: bool) -> Column:
        def add(a: Column, p: Column) -> Column:
            count = F.get(p["counts"], F.lit(slot))
            return a + (count * F.get(weight, F.datediff("day", p["day"])) if weighted else count)

        return F.aggregate("before", F.lit(0).cast("long"), add)

    known_days = (
        days.withColumn("before", F.collect_list(F.struct("day", "counts")).over(before))
        .where("orders = 1")
        .select(
            "user_id",
            "day",
            F.array(*[past(k, False) for k in range(len(SLOTS))]).alias("past"),
            F.array(*[past(k, True) for k in range(len(SLOTS))]).alias("past_decayed"),
        )
    )
    today = F.array(*[c.over(_so_far()) for c in _counts(touch)])
    known = (
        rows.withColumn("today", today)
        .where("kind = 1")
        .join(known_days, ["user_id", "day"])
        .select(
            "order_id", "revenue", "channel",
            F.zip_with("past", "today", lambda a, b: a + b).alias("linear"),
            F.zip_with("past_decayed", "today", lambda a, b: a + b * config.day_weights[0]).alias("decay"),
        )
    )
    nothing = F.array_repeat(F.lit(0).cast("long"), len(SLOTS))
    alone = _alone(fact_sessions, revenue_column).select("order_id", "revenue", "channel", nothing.alias("linear"), nothing.alias("decay"))
    own = F.array(*[F.col("channel").eqNullSafe(F.lit(c)).cast("long") for c in SLOTS])
    seen = F.exists("linear", lambda n: n > 0)
    shared = (
        known.unionByName(alone)
        .select(
            "order_id",
            (F.col("revenue") * UNITS).cast("bigint").alias("units"),
            F.when(seen, F.col("linear")).otherwise(own).alias("linear"),
            F.when(seen, F.col("decay")).otherwise(own).alias("decay"),
        )
        .select("order_id", "linear", _credits("linear").alias("linear_units"), _credits("decay").alias("decay_units"))
    )
    slots = F.array(*[F.lit(c).cast("string") for c in SLOTS])
    credited = shared.select(
        "order_id",
        F.explode(F.arrays_zip(slots.alias("channel"), F.col("linear").alias("touches"), "linear_units", "decay_units")).alias("x"),
    ).select("order_id", "x.*")

    def amount(units: str) -> Column:
        return F.expr(f"CAST(CAST({units} AS DECIMAL(24,0)) / {UNITS} AS {MONEY_TOTAL.simpleString()})")

    return credited.where("touches > 0").select(
        "order_id", "channel", "touches", amount("linear_units").alias("linear_credit"), amount("decay_units").alias("decay_credit")
    )


def multi_touch(credits: DataFrame) -> DataFrame:
    """Revenue per channel under both schemes, and the orders that it had a part in; the null channel is the unknown one."""
    return credits.groupBy("channel").agg(
        money_sum("linear_credit").alias("linear_revenue"),
        money_sum("decay_credit").alias("decay_revenue"),
        F.count("order_id").alias("assisted_orders"),
    )
