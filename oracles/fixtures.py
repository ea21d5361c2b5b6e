"""Raw marketing tables as SQL over the star-schema test tables."""

FIXTURES = {
    "raw_campaigns": """
SELECT 'C' || lpad(CAST(k + 1 AS STRING), 3, '0') AS campaign_id,
       CASE k % 5 WHEN 0 THEN 'Search' WHEN 1 THEN 'PAID_SOCIAL' WHEN 2 THEN ' email '
                  WHEN 3 THEN 'Referral' ELSE 'organic' END AS channel,
       k AS campaign_no
FROM (SELECT n_nationkey AS k FROM nation
      UNION ALL SELECT r_regionkey + 25 AS k FROM region) c""",
    "base_events": """
SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events""",
    "raw_sessions": """
WITH s AS (
  SELECT event_id AS session_id,
         CASE WHEN event_id % 10 = 3 THEN NULL ELSE user_id END AS user_id,
         ts AS session_ts,
         CASE WHEN event_id % 3 = 0 THEN 'web' ELSE 'mobile' END AS device,
         CASE WHEN event_id % 211 = 0 THEN 'unknown' ELSE
           CASE (k % 25) % 5
             WHEN 0 THEN CASE event_id % 3 WHEN 0 THEN 'Search' WHEN 1 THEN 'SEARCH' ELSE ' search ' END
             WHEN 1 THEN CASE event_id % 2 WHEN 0 THEN 'Paid_Social' ELSE 'paid_social' END
             WHEN 2 THEN 'EMAIL' WHEN 3 THEN 'referral' ELSE 'Organic' END END AS channel,
         CASE WHEN event_id % 101 = 0 THEN NULL
              ELSE 'C' || lpad(CAST(k % 25 + 1 AS STRING), 3, '0') END AS campaign_id,
         event_id AS ingest_seq
  FROM base_events)
SELECT * FROM s
UNION ALL
SELECT session_id, user_id, session_ts, 'dup' AS device, channel, campaign_id,
       ingest_seq + 1000000000 AS ingest_seq FROM s WHERE session_id % 50 = 0""",
    "raw_orders": """
WITH o AS (
  SELECT event_id AS order_id, event_id AS session_id, user_id,
         ts + INTERVAL 5 MINUTE AS order_ts,
         value + CASE WHEN event_id % 4 = 0 THEN 5.0e0 ELSE 0.0e0 END AS gross_amount,
         CASE WHEN event_id % 4 = 0 THEN 5.0e0 ELSE 0.0e0 END AS discount_amount,
         CASE WHEN event_id % 307 = 0 THEN NULL ELSE value END AS net_amount,
         event_id AS ingest_seq
  FROM base_events WHERE event_type = 'purchase')
SELECT * FROM o
UNION ALL
SELECT -order_id - 1 AS order_id, session_id, user_id, order_ts, gross_amount,
       discount_amount, net_amount, ingest_seq + 1000000 AS ingest_seq FROM o WHERE order_id % 97 = 0
UNION ALL
SELECT order_id, session_id, user_id, order_ts, gross_amount, discount_amount, net_amount,
       ingest_seq + 1000000000 AS ingest_seq FROM o WHERE order_id % 40 = 0""",
    "raw_ad_spend": """
WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events),
g AS (SELECT d.date, c.campaign_id, c.channel, c.campaign_no,
             CAST(day(d.date) AS INT) AS dd FROM d CROSS JOIN raw_campaigns c),
a AS (SELECT date, campaign_id, channel,
             CASE WHEN (dd + campaign_no) % 13 = 0 THEN NULL
                  ELSE CAST(20 + (dd * 7 + campaign_no * 11) % 50 AS DOUBLE) END AS spend,
             CASE WHEN (dd + campaign_no) % 11 = 0 THEN NULL
                  ELSE 1000 + (dd * 13 + campaign_no * 17) % 500 END AS impressions,
             CASE WHEN (dd + campaign_no) % 19 = 0 THEN 0
                  ELSE 10 + (dd + campaign_no * 3) % 40 END AS clicks,
             CASE WHEN dd % 7 = 0 AND campaign_no % 5 < 3 THEN 1 ELSE 0 END AS promo_flag,
             dd * 1000 + campaign_no AS ingest_seq
      FROM g WHERE (dd + campaign_no) % 17 <> 0)
SELECT * FROM a
UNION ALL
SELECT date, campaign_id, channel, 999.0e0 AS spend, impressions, clicks, promo_flag,
       ingest_seq + 1000000 AS ingest_seq FROM a WHERE ingest_seq % 23 = 0""",
    "raw_users": """
SELECT c_custkey AS user_id, DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS signup_date,
       CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE c_nationkey % 3 + 1 END AS city_tier
FROM customer""",
    "raw_products": """
SELECT p_partkey AS product_id, p_type AS category, p_retailprice * 0.6e0 AS cost FROM part""",
    "raw_order_items": """
SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity,
       l_extendedprice / l_quantity AS unit_price FROM lineitem""",
}
