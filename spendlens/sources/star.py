"""Raw marketing tables derived from the star-schema test data (events, nation, region, customer, part, lineitem)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.functions.tables import LazyTables

CAMPAIGN_NUMBERS = 30  # nation keys 0-24, then the five regions

# Declared, so that opening a table costs no job to look at its footers.
STAR_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}



def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _read(spark, sf_dir, "nation").selectExpr("n_nationkey AS k")
    regions = _read(spark, sf_dir, "region").selectExpr("r_regionkey + 25 AS k")
    return nations.union(regions).selectExpr(
        "'C' || lpad(k + 1, 3, '0') AS campaign_id",
        "get(array('Search', 'PAID_SOCIAL', ' email ', 'Referral', 'organic'), k % 5) AS channel",
        "k AS campaign_no",
    )


def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from events; every 50th comes a second time, later and with another device."""
    return (
        _read(spark, sf_dir, "events")
        .selectExpr(
            "event_id AS session_id",
            "user_id",
            "ts",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 25 AS slot",
            "explode(IF(event_id % 50 = 0, array(false, true), array(false))) AS late",
        )
        .selectExpr(
            "session_id",
            "IF(session_id % 10 = 3, NULL, user_id) AS user_id",
            "ts AS session_ts",
            "CASE WHEN late THEN 'dup' WHEN session_id % 3 = 0 THEN 'web' ELSE 'mobile' END AS device",
            """CASE WHEN session_id % 211 = 0 THEN 'unknown'
                    WHEN slot % 5 = 0 THEN get(array('Search', 'SEARCH', ' search '), CAST(session_id % 3 AS INT))
                    WHEN slot % 5 = 1 THEN IF(session_id % 2 = 0, 'Paid_Social', 'paid_social')
                    ELSE get(array('EMAIL', 'referral', 'Organic'), slot % 5 - 2) END AS channel""",
            "IF(session_id % 101 = 0, NULL, 'C' || lpad(slot + 1, 3, '0')) AS campaign_id",
            "session_id + IF(late, 1000000000, 0) AS ingest_seq",
        )
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from purchase events; some sessions have a second order, some orders come a second time."""
    return (
        _read(spark, sf_dir, "events")
        .where("event_type = 'purchase'")
        .selectExpr(
            "event_id",
            "user_id",
            "ts",
            "value",
            "IF(event_id % 4 = 0, 5.0D, 0.0D) AS discount",
            "explode(array_compact(array(0, IF(event_id % 97 = 0, 1, NULL), IF(event_id % 40 = 0, 2, NULL)))) AS copy",
        )
        .selectExpr(
            "IF(copy = 1, -event_id - 1, event_id) AS order_id",
            "event_id AS session_id",
            "user_id",
            "ts + INTERVAL 5 MINUTE AS order_ts",
            "CAST(value + discount AS DECIMAL(18,4)) AS gross_amount",
            "CAST(discount AS DECIMAL(18,4)) AS discount_amount",
            "CAST(IF(event_id % 307 = 0, NULL, value) AS DECIMAL(18,4)) AS net_amount",
            "event_id + CASE copy WHEN 1 THEN 1000000 WHEN 2 THEN 1000000000 ELSE 0 END AS ingest_seq",
        )
    )


def raw_ad_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad spend per day of the events and campaign; some rows come a second time with another spend."""
    days = _read(spark, sf_dir, "events").selectExpr("CAST(ts AS DATE) AS date").distinct()
    numbered = days.selectExpr("date", "day(date) AS dd", f"explode(sequence(0, {CAMPAIGN_NUMBERS - 1})) AS campaign_no")
    return (
        numbered.where("(dd + campaign_no) % 17 <> 0")
        .join(raw_campaigns(spark, sf_dir), "campaign_no")
        .selectExpr(
            "*",
            "dd + campaign_no AS mix",
            "dd * 1000 + campaign_no AS seq",
            "explode(IF((dd * 1000 + campaign_no) % 23 = 0, array(false, true), array(false))) AS late",
        )
        .selectExpr(
            "date",
            "campaign_id",
            "channel",
            """CAST(CASE WHEN late THEN 999 WHEN mix % 13 = 0 THEN NULL
                         ELSE 20 + (dd * 7 + campaign_no * 11) % 50 END AS DECIMAL(18,4)) AS spend""",
            "CAST(IF(mix % 11 = 0, NULL, 1000 + (dd * 13 + campaign_no * 17) % 500) AS BIGINT) AS impressions",
            "CAST(IF(mix % 19 = 0, 0, 10 + (dd + campaign_no * 3) % 40) AS BIGINT) AS clicks",
            "IF(dd % 7 = 0 AND campaign_no % 5 < 3, 1, 0) AS promo_flag",
            "CAST(seq + IF(late, 1000000, 0) AS BIGINT) AS ingest_seq",
        )
    )


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id",
        "DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS signup_date",
        "IF(c_custkey % 41 = 0, NULL, c_nationkey % 3 + 1) AS city_tier",
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id", "p_type AS category", "p_retailprice * 0.6D AS cost"
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_partkey AS product_id",
        "l_quantity AS quantity",
        "l_extendedprice / l_quantity AS unit_price",
    )


READERS = {
    "sessions": raw_sessions,
    "orders": raw_orders,
    "order_items": raw_order_items,
    "ad_spend": raw_ad_spend,
    "users": raw_users,
    "campaigns": raw_campaigns,
    "products": raw_products,
}


def raw_tables(spark: SparkSession, sf_dir: str) -> LazyTables:
    return LazyTables({name: lambda read=read: read(spark, sf_dir) for name, read in READERS.items()})
