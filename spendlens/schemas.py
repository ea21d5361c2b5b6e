"""Declared schemas of the raw inputs and of the curated facts.

Money is ``decimal(18,4)``: sums are then exact and do not depend on partition order, and a quartile fence over cent
amounts (quarter steps between two amounts) still fits without rounding.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
MONEY_TOTAL = T.DecimalType(28, 4)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_STR, _INT, _LONG, _DBL, _BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_DATE, _TS = T.DateType(), T.TimestampNTZType()

SESSIONS = _schema(
    session_id=_STR, user_id=_STR, session_ts=_TS, device=_STR, channel=_STR, campaign_id=_STR
)
ORDERS = _schema(
    order_id=_STR, session_id=_STR, order_ts=_TS, gross_amount=MONEY, discount_amount=MONEY, net_amount=MONEY
)
ORDER_ITEMS = _schema(order_id=_STR, product_id=_STR, quantity=_INT, unit_price=MONEY)
AD_SPEND = _schema(
    date=_DATE, campaign_id=_STR, channel=_STR, spend=MONEY, impressions=_LONG, clicks=_LONG, promo_flag=_INT
)
USERS = _schema(user_id=_STR, signup_date=_DATE, city_tier=_INT)
CAMPAIGNS = _schema(campaign_id=_STR, channel=_STR)
PRODUCTS = _schema(product_id=_STR, category=_STR, cost=MONEY)

# Table name -> (file name, schema)
RAW_FILES = {
    "sessions": ("sessions.csv", SESSIONS),
    "orders": ("orders.csv", ORDERS),
    "order_items": ("order_items.csv", ORDER_ITEMS),
    "ad_spend": ("ad_spend_daily.csv", AD_SPEND),
    "users": ("users.csv", USERS),
    "campaigns": ("campaigns.csv", CAMPAIGNS),
    "products": ("products.json", PRODUCTS),
}

FACT_SESSIONS = _schema(
    session_id=_STR,
    user_id=_STR,
    session_ts=_TS,
    session_date=_DATE,
    device=_STR,
    channel=_STR,
    campaign_id=_STR,
    is_new_user=_BOOL,
    purchase_flag=_INT,
    order_id=_STR,
    gross_amount=MONEY,
    discount_amount=MONEY,
    net_amount=MONEY,
    net_amount_capped=MONEY,
    is_revenue_outlier=_BOOL,
    session_to_order_sec=_DBL,
)
FACT_CAMPAIGN_DAILY = _schema(
    date=_DATE,
    campaign_id=_STR,
    channel=_STR,
    spend=MONEY,
    impressions=_LONG,
    clicks=_LONG,
    attributed_sessions=_LONG,
    attributed_orders=_LONG,
    attributed_revenue=MONEY_TOTAL,
    cpc=_DBL,
    ctr=_DBL,
    cvr=_DBL,
    roas=_DBL,
    cac_proxy=_DBL,
)
FACT_CHANNEL_DAILY = _schema(
    date=_DATE,
    channel=_STR,
    total_spend=MONEY_TOTAL,
    total_impressions=_LONG,
    total_clicks=_LONG,
    attributed_sessions=_LONG,
    attributed_orders=_LONG,
    attributed_revenue=MONEY_TOTAL,
    day_of_week=_INT,
    promo_flag=_INT,
    week_index=_INT,
)
