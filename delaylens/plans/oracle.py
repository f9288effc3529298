"""Independent SQL oracles (DuckDB dialect) for the registered queries.

Each query starts from the benchmark tables (orders, lineitem, part,
supplier, customer, nation, events) through the same documented fixture
mapping, then states the operator's semantics in plain SQL. Doubles are
rounded to 6 places, as on the Spark side.
"""

from __future__ import annotations

MAPPING = """
src_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
    o_orderdate AS order_purchase_timestamp,
    o_orderdate + (o_orderkey*7 % 48) * INTERVAL '1' HOUR AS order_approved_at,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
         ELSE o_orderdate + (48 + o_orderkey*13 % 150) * INTERVAL '1' HOUR END AS order_delivered_carrier_date,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL
         ELSE o_orderdate + (216 + (o_custkey*37 + o_orderkey*7) % 660) * INTERVAL '1' HOUR END AS order_delivered_customer_date,
    o_orderdate + 34 * INTERVAL '1' DAY AS order_estimated_delivery_date
  FROM orders),
src_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
    CASE WHEN l_partkey % 101 = 0 THEN -l_partkey ELSE l_partkey END AS product_id, l_suppkey AS seller_id,
    l_extendedprice AS price, l_extendedprice*l_tax AS freight_value
  FROM lineitem),
src_products AS (
  SELECT p_partkey AS product_id,
    CASE WHEN p_partkey % 61 = 0 THEN NULL ELSE p_type END AS product_category_name,
    CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_size*100.0e0 END AS product_weight_g
  FROM part),
src_sellers AS (
  SELECT s_suppkey AS seller_id,
    CAST(CASE WHEN s_suppkey % 25 = 24 THEN 1000 + s_nationkey ELSE s_nationkey END AS INTEGER) AS seller_zip_code_prefix,
    n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
src_customers AS (
  SELECT c_custkey AS customer_id,
    CAST(CASE WHEN c_custkey % 25 = 24 THEN 1000 + c_nationkey ELSE c_nationkey END AS INTEGER) AS customer_zip_code_prefix,
    n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
src_geo AS (
  SELECT c_nationkey AS geolocation_zip_code_prefix,
    -33e0 + c_nationkey*1.4e0 + (c_custkey % 10)*0.01e0 AS geolocation_lat,
    -73e0 + (c_nationkey*7 % 25)*1.6e0 - (c_custkey % 10)*0.01e0 AS geolocation_lng
  FROM customer),
src_reviews AS (
  SELECT event_id - CASE WHEN event_id % 50 = 1 THEN 1 ELSE 0 END AS order_id,
    CAST(1 + event_id % 5 AS INTEGER) AS review_score
  FROM events),
late_orders AS (
  SELECT *, CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1 ELSE 0 END AS is_late
  FROM src_orders),
master AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp,
    o.order_delivered_customer_date, o.order_estimated_delivery_date, oi.seller_id, o.is_late,
    oi.price, oi.freight_value,
    COALESCE(p.product_weight_g, (SELECT AVG(product_weight_g) FROM src_products)) AS product_weight_g,
    p.product_category_name, s.seller_zip_code_prefix, s.seller_state,
    c.customer_zip_code_prefix, c.customer_state, r.review_score
  FROM late_orders o
  JOIN src_items oi ON o.order_id = oi.order_id
  LEFT JOIN src_products p ON oi.product_id = p.product_id
  LEFT JOIN src_sellers s ON oi.seller_id = s.seller_id
  LEFT JOIN src_customers c ON o.customer_id = c.customer_id
  LEFT JOIN src_reviews r ON o.order_id = r.order_id
  WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL),
master_inner AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp,
    o.order_delivered_customer_date, o.order_estimated_delivery_date, oi.seller_id, o.is_late,
    oi.price, oi.freight_value, p.product_weight_g, p.product_category_name,
    s.seller_zip_code_prefix, s.seller_state, c.customer_zip_code_prefix, c.customer_state
  FROM late_orders o
  JOIN src_items oi ON o.order_id = oi.order_id
  JOIN src_products p ON oi.product_id = p.product_id
  JOIN src_sellers s ON oi.seller_id = s.seller_id
  JOIN src_customers c ON o.customer_id = c.customer_id
  WHERE o.order_status = 'delivered'),
centroid AS (
  SELECT geolocation_zip_code_prefix AS zip, AVG(geolocation_lat) AS lat, AVG(geolocation_lng) AS lng
  FROM src_geo WHERE geolocation_zip_code_prefix IS NOT NULL GROUP BY 1),
geo_master AS (
  SELECT m.*, sc.lat AS s_lat, sc.lng AS s_lng, cc.lat AS c_lat, cc.lng AS c_lng
  FROM master m
  LEFT JOIN centroid sc ON m.seller_zip_code_prefix = sc.zip
  LEFT JOIN centroid cc ON m.customer_zip_code_prefix = cc.zip),
dist_master AS (
  SELECT *, 6371.0e0 * 2 * atan2(sqrt(ac), sqrt(1 - ac)) AS distance_km
  FROM (SELECT *, CASE WHEN a < 0 THEN 0e0 WHEN a > 1 THEN 1e0 ELSE a END AS ac FROM (SELECT *, pow(sin(radians(c_lat - s_lat) / 2), 2)
                  + cos(radians(s_lat)) * cos(radians(c_lat)) * pow(sin(radians(c_lng - s_lng) / 2), 2) AS a
        FROM geo_master) g0) g),
profile AS (
  SELECT seller_id, AVG(is_late) AS seller_late_rate, COUNT(is_late) AS seller_order_count
  FROM dist_master WHERE seller_id IS NOT NULL GROUP BY seller_id),
feat AS (
  SELECT d.order_id, d.seller_id, d.distance_km,
    COALESCE(p.seller_late_rate, (SELECT AVG(seller_late_rate) FROM profile)) AS seller_late_rate,
    COALESCE(d.product_weight_g, (SELECT AVG(product_weight_g) FROM dist_master)) AS product_weight_g,
    d.freight_value, d.price, d.is_late, d.product_category_name, d.customer_state, d.seller_state
  FROM dist_master d LEFT JOIN profile p ON d.seller_id = p.seller_id
  WHERE d.distance_km IS NOT NULL AND NOT isnan(d.distance_km)),
life AS (
  SELECT o.order_id, o.customer_id, oi.seller_id, oi.price, oi.freight_value,
    s.seller_state, c.customer_state,
    (epoch_us(o.order_delivered_carrier_date) - epoch_us(o.order_approved_at)) / 86400000000.0e0 AS time_to_carrier,
    (epoch_us(o.order_delivered_customer_date) - epoch_us(o.order_delivered_carrier_date)) / 86400000000.0e0 AS time_in_transit,
    (epoch_us(o.order_delivered_customer_date) - epoch_us(o.order_purchase_timestamp)) / 86400000000.0e0 AS total_delivery_time,
    epoch_us(o.order_delivered_carrier_date) - epoch_us(o.order_approved_at) AS carrier_us,
    epoch_us(o.order_delivered_customer_date) - epoch_us(o.order_delivered_carrier_date) AS transit_us,
    epoch_us(o.order_delivered_customer_date) - epoch_us(o.order_purchase_timestamp) AS total_us,
    o.is_late
  FROM late_orders o
  JOIN src_items oi ON o.order_id = oi.order_id
  JOIN src_sellers s ON oi.seller_id = s.seller_id
  JOIN src_customers c ON o.customer_id = c.customer_id
  WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL
    AND o.order_approved_at IS NOT NULL AND o.order_delivered_carrier_date IS NOT NULL),
route_stats AS (
  SELECT seller_state, customer_state, AVG(transit_us) / 86400000000.0e0 AS avg_transit_time,
    AVG(is_late) AS late_rate, COUNT(order_id) AS count
  FROM life GROUP BY 1, 2),
scored AS (
  SELECT order_id, seller_id, is_late AS y,
    ((order_id*31 + seller_id*17) % 80 + 20*is_late) / 100e0 AS p
  FROM master)
"""


def q(body: str) -> str:
    return "WITH " + MAPPING.strip() + "\n" + body.strip()


STATES = [f"NATION_{i}" for i in range(25)]
_matrix_cols = ",\n  ".join(
    f"round(max(CASE WHEN customer_state = '{s}' THEN late_rate END), 6) AS \"{s}\"" for s in STATES
)

_sweep = "\nUNION ALL ".join(
    f"""SELECT {t}e0 AS threshold,
  round(CASE WHEN sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) > 0
     THEN sum(CASE WHEN p >= {t}e0 AND y = 1 THEN 1 ELSE 0 END) * 1.0e0 / sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) ELSE 0 END, 6) AS recall,
  round(CASE WHEN sum(CASE WHEN p >= {t}e0 THEN 1 ELSE 0 END) > 0
     THEN sum(CASE WHEN p >= {t}e0 AND y = 1 THEN 1 ELSE 0 END) * 1.0e0 / sum(CASE WHEN p >= {t}e0 THEN 1 ELSE 0 END) ELSE 0 END, 6) AS precision,
  CAST(sum(CASE WHEN p >= {t}e0 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS caught,
  CAST(sum(CASE WHEN p >= {t}e0 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_alarms
FROM scored"""
    for t in ("0.3", "0.4", "0.5", "0.6", "0.7")
)


_scoring = """
SELECT o.order_id, i.seller_id,
  CASE WHEN sc.zip IS NULL THEN 'no_seller_geo' WHEN cc.zip IS NULL THEN 'no_customer_geo' ELSE 'scored' END AS outcome,
  true AS consistent
FROM src_orders o JOIN src_items i ON o.order_id = i.order_id
LEFT JOIN src_sellers s ON i.seller_id = s.seller_id
LEFT JOIN src_customers c ON o.customer_id = c.customer_id
LEFT JOIN centroid sc ON s.seller_zip_code_prefix = sc.zip
LEFT JOIN centroid cc ON c.customer_zip_code_prefix = cc.zip
WHERE o.order_status <> 'delivered'"""


ORACLE: dict[str, str] = {
    "master": q("SELECT * REPLACE (round(price, 6) AS price, round(freight_value, 6) AS freight_value, "
                "round(product_weight_g, 6) AS product_weight_g) FROM master"),
    "master_scan": q("SELECT * REPLACE (round(price, 6) AS price, round(freight_value, 6) AS freight_value, "
                     "round(product_weight_g, 6) AS product_weight_g) FROM master"),
    "delivered_orders": q("""
SELECT order_id, customer_id, order_purchase_timestamp, order_delivered_customer_date,
  order_estimated_delivery_date, is_late
FROM late_orders WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL"""),
    "lifecycle_orders": q("""
SELECT order_id, order_approved_at, order_delivered_carrier_date, order_delivered_customer_date
FROM src_orders WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
  AND order_approved_at IS NOT NULL AND order_delivered_carrier_date IS NOT NULL"""),
    "is_late_flag": q("SELECT order_id, order_status, is_late FROM late_orders"),
    "order_items_joined": q("""
SELECT o.order_id, o.is_late, i.product_id, i.seller_id, round(i.price, 6) AS price,
  round(i.freight_value, 6) AS freight_value
FROM late_orders o JOIN src_items i ON o.order_id = i.order_id
WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL"""),
    "master_inner": q("""
SELECT * REPLACE (round(price, 6) AS price, round(freight_value, 6) AS freight_value,
  round(product_weight_g, 6) AS product_weight_g) FROM master_inner"""),
    "review_fanout": q("""
SELECT o.order_id, COUNT(*) AS rows, COUNT(r.review_score) AS reviewed_rows
FROM src_orders o JOIN src_items i ON o.order_id = i.order_id
LEFT JOIN src_reviews r ON o.order_id = r.order_id
WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL
GROUP BY o.order_id"""),
    "weight_filled_catalog": q("""
SELECT i.order_id, i.product_id,
  round(COALESCE(p.product_weight_g, (SELECT AVG(product_weight_g) FROM src_products)), 6) AS product_weight_g
FROM src_orders o JOIN src_items i ON o.order_id = i.order_id
LEFT JOIN src_products p ON i.product_id = p.product_id
WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL"""),
    "weight_filled_rows": q("""
SELECT order_id, seller_id, round(price, 6) AS price,
  round(COALESCE(product_weight_g, (SELECT AVG(product_weight_g) FROM master_inner)), 6) AS product_weight_g
FROM master_inner"""),
    "geo_centroid": q("SELECT zip, round(lat, 6) AS lat, round(lng, 6) AS lng FROM centroid"),
    "geo_enriched": q("""
SELECT order_id, seller_id, seller_zip_code_prefix, customer_zip_code_prefix,
  round(s_lat, 6) AS s_lat, round(s_lng, 6) AS s_lng, round(c_lat, 6) AS c_lat, round(c_lng, 6) AS c_lng
FROM geo_master"""),
    "order_distance": q("SELECT order_id, seller_id, round(distance_km, 6) AS distance_km FROM dist_master"),
    "seller_profile": q("SELECT seller_id, round(seller_late_rate, 6) AS seller_late_rate, seller_order_count FROM profile"),
    "seller_enriched": q("""
, with_p AS (SELECT seller_id, AVG(is_late) AS r, COUNT(is_late) AS n FROM master WHERE seller_id IS NOT NULL GROUP BY seller_id)
SELECT m.order_id, m.seller_id, m.is_late, round(w.r, 6) AS seller_late_rate, w.n AS seller_order_count
FROM master m LEFT JOIN with_p w ON m.seller_id = w.seller_id"""),
    "seller_rate_filled": q("""
, mp AS (SELECT seller_id, AVG(is_late) AS seller_late_rate FROM master WHERE seller_id IS NOT NULL GROUP BY seller_id)
SELECT i.order_id, i.seller_id, mp.seller_late_rate IS NOT NULL AS known_seller,
  round(COALESCE(mp.seller_late_rate, (SELECT AVG(seller_late_rate) FROM mp)), 6) AS seller_late_rate
FROM src_orders o JOIN src_items i ON o.order_id = i.order_id
LEFT JOIN mp ON i.seller_id = mp.seller_id
WHERE o.order_status <> 'delivered'"""),
    "features": q("""
SELECT order_id, seller_id, round(distance_km, 6) AS distance_km, round(seller_late_rate, 6) AS seller_late_rate,
  round(product_weight_g, 6) AS product_weight_g, round(freight_value, 6) AS freight_value,
  round(price, 6) AS price, is_late
FROM feat"""),
    "features_asof": q("""
, pts AS (SELECT DISTINCT seller_id, order_purchase_timestamp AS t FROM dist_master),
hist AS (
  SELECT pts.seller_id, pts.t, COUNT(r.is_late) AS n, COALESCE(SUM(r.is_late), 0) AS l
  FROM pts LEFT JOIN dist_master r
    ON r.seller_id = pts.seller_id AND r.order_delivered_customer_date < pts.t
  GROUP BY 1, 2),
past AS (
  SELECT t, SUM(c) OVER w AS n, SUM(l) OVER w AS l
  FROM (SELECT order_delivered_customer_date AS t, COUNT(is_late) AS c, SUM(is_late) AS l FROM dist_master GROUP BY 1)
  WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fa AS (
  SELECT d.*, CASE WHEN h.n > 0 THEN h.l * 1.0e0 / h.n END AS asof_rate, past.l * 1.0e0 / past.n AS past_rate
  FROM dist_master d JOIN hist h ON d.seller_id = h.seller_id AND d.order_purchase_timestamp = h.t
  ASOF LEFT JOIN past ON d.order_purchase_timestamp > past.t)
SELECT order_id, seller_id, round(distance_km, 6) AS distance_km,
  round(COALESCE(asof_rate, past_rate), 6) AS seller_late_rate,
  round(COALESCE(product_weight_g, (SELECT AVG(product_weight_g) FROM dist_master)), 6) AS product_weight_g,
  round(freight_value, 6) AS freight_value, round(price, 6) AS price, is_late
FROM fa WHERE distance_km IS NOT NULL"""),
    "features_preview": q("""
SELECT order_id, round(distance_km, 6) AS distance_km, round(seller_late_rate, 6) AS seller_late_rate, is_late
FROM feat ORDER BY order_id, distance_km, seller_late_rate, is_late LIMIT 5"""),
    "features_strict": q("""
, gi AS (
  SELECT m.*, sc.lat AS s_lat, sc.lng AS s_lng, cc.lat AS c_lat, cc.lng AS c_lng
  FROM master_inner m
  LEFT JOIN centroid sc ON m.seller_zip_code_prefix = sc.zip
  LEFT JOIN centroid cc ON m.customer_zip_code_prefix = cc.zip),
di AS (
  SELECT *, 6371.0e0 * 2 * atan2(sqrt(ac), sqrt(1 - ac)) AS distance_km
  FROM (SELECT *, CASE WHEN a < 0 THEN 0e0 WHEN a > 1 THEN 1e0 ELSE a END AS ac FROM (SELECT *, pow(sin(radians(c_lat - s_lat) / 2), 2)
                  + cos(radians(s_lat)) * cos(radians(c_lat)) * pow(sin(radians(c_lng - s_lng) / 2), 2) AS a
        FROM gi) g0) g),
pi AS (SELECT seller_id, AVG(is_late) AS r, COUNT(is_late) AS n FROM di WHERE seller_id IS NOT NULL GROUP BY seller_id)
SELECT d.order_id, d.seller_id, round(d.distance_km, 6) AS distance_km, round(pi.r, 6) AS seller_late_rate,
  round(COALESCE(d.product_weight_g, (SELECT AVG(product_weight_g) FROM di)), 6) AS product_weight_g,
  round(d.freight_value, 6) AS freight_value, round(d.price, 6) AS price, d.is_late, pi.n AS seller_order_count
FROM di d LEFT JOIN pi ON d.seller_id = pi.seller_id
WHERE d.distance_km IS NOT NULL AND pi.r IS NOT NULL"""),
    "stage_durations": q("""
SELECT order_id,
  round((epoch_us(order_delivered_carrier_date) - epoch_us(order_approved_at)) / 86400000000.0e0, 6) AS time_to_carrier,
  round((epoch_us(order_delivered_customer_date) - epoch_us(order_delivered_carrier_date)) / 86400000000.0e0, 6) AS time_in_transit,
  round((epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 86400000000.0e0, 6) AS total_delivery_time
FROM src_orders WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
  AND order_approved_at IS NOT NULL AND order_delivered_carrier_date IS NOT NULL"""),
    "stage_averages": q("""
SELECT round(AVG(carrier_us) / 86400000000.0e0, 6) AS avg_time_to_carrier,
  round(AVG(transit_us) / 86400000000.0e0, 6) AS avg_time_in_transit,
  round(AVG(total_us) / 86400000000.0e0, 6) AS avg_total_delivery_time, COUNT(*) AS rows FROM life"""),
    "route_stats": q("""
SELECT seller_state, customer_state, round(avg_transit_time, 6) AS avg_transit_time,
  round(late_rate, 6) AS late_rate, count FROM route_stats"""),
    "major_routes": q("""
SELECT seller_state, customer_state, round(avg_transit_time, 6) AS avg_transit_time,
  round(late_rate, 6) AS late_rate, count FROM route_stats WHERE count > 50"""),
    "route_matrix": q(f"""
SELECT seller_state,
  {_matrix_cols}
FROM route_stats WHERE count > 50 GROUP BY seller_state"""),
    "kpis": q("""
SELECT COUNT(*) AS rows, COUNT(DISTINCT order_id) AS distinct_orders, round(AVG(is_late), 6) AS late_rate,
  round(AVG(review_score), 6) AS avg_review_score, round(AVG(freight_value), 6) AS avg_freight
FROM master"""),
    "late_by_category": q("""
SELECT product_category_name AS category, COUNT(*) AS late_count
FROM master WHERE is_late = 1 AND product_category_name IS NOT NULL GROUP BY 1"""),
    "worst_categories": q("""
SELECT product_category_name AS category, COUNT(*) AS late_count
FROM master WHERE is_late = 1 AND product_category_name IS NOT NULL GROUP BY 1
ORDER BY late_count DESC, category ASC LIMIT 10"""),
    "confusion": q("""
SELECT CAST(sum(CASE WHEN p >= 0.5e0 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN p >= 0.5e0 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN p < 0.5e0 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN p < 0.5e0 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM scored"""),
    "risk_flag": q("""
SELECT order_id, seller_id, round(p, 6) AS delay_risk_probability, p > 0.5e0 AS is_high_risk,
  CASE WHEN p > 0.5e0 THEN 'HIGH RISK' ELSE 'ON TRACK' END AS risk_label
FROM scored"""),
    "threshold_sweep": q(_sweep),
    "classification_report": q("""
, cells AS (
  SELECT sum(CASE WHEN y = 1 AND p > 0.5e0 THEN 1 ELSE 0 END) * 1.0e0 AS tp,
         sum(CASE WHEN y = 0 AND p > 0.5e0 THEN 1 ELSE 0 END) * 1.0e0 AS fp,
         sum(CASE WHEN y = 1 AND NOT p > 0.5e0 THEN 1 ELSE 0 END) * 1.0e0 AS fn,
         sum(CASE WHEN y = 0 AND NOT p > 0.5e0 THEN 1 ELSE 0 END) * 1.0e0 AS tn
  FROM scored),
pr AS (
  SELECT *,
    CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0,
    CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
    tn + fp AS s0, tp + fn AS s1, tp + fp + fn + tn AS n
  FROM cells),
f AS (
  SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0,
            CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1
  FROM pr)
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1_score, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / n, 6), CAST(n AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(n AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
  round((f0 * s0 + f1 * s1) / n, 6), CAST(n AS BIGINT) FROM f"""),
    "roc_auc": q("""
, per AS (SELECT p, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS neg
          FROM scored GROUP BY p),
cum AS (SELECT p, pos, neg, COALESCE(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM per)
SELECT round(sum(pos * (below + neg / 2.0e0)) / (sum(pos) * 1.0e0 * sum(neg)), 6) AS roc_auc,
  CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM cum"""),
    "ts_parse": q("""
SELECT order_id, order_purchase_timestamp, order_approved_at, order_delivered_carrier_date FROM src_orders"""),
    "unscorable_rows": q("""
SELECT CASE WHEN s_lat IS NULL THEN 'no_seller_geo' ELSE 'no_customer_geo' END AS reason, COUNT(*) AS rows
FROM dist_master WHERE s_lat IS NULL OR c_lat IS NULL GROUP BY 1"""),
    "stage_histogram": q("""
, bounds AS (SELECT min(time_to_carrier) AS lo1, max(time_to_carrier) AS hi1,
                    min(time_in_transit) AS lo2, max(time_in_transit) AS hi2 FROM life),
b AS (
  SELECT 'time_to_carrier' AS stage,
    CAST(CASE WHEN hi1 = lo1 THEN 1 ELSE least(floor(50 * (time_to_carrier - lo1) / (hi1 - lo1)) + 1, 50) END AS INTEGER) AS bin
  FROM life, bounds WHERE time_to_carrier IS NOT NULL
  UNION ALL
  SELECT 'time_in_transit',
    CAST(CASE WHEN hi2 = lo2 THEN 1 ELSE least(floor(50 * (time_in_transit - lo2) / (hi2 - lo2)) + 1, 50) END AS INTEGER)
  FROM life, bounds WHERE time_in_transit IS NOT NULL),
grid AS (SELECT s.stage, CAST(g.bin AS INTEGER) AS bin FROM (VALUES ('time_to_carrier'), ('time_in_transit')) s(stage),
         range(1, 51) g(bin)),
cnt AS (SELECT stage, bin, COUNT(*) AS c FROM b GROUP BY 1, 2)
SELECT g.stage, g.bin,
  round(CASE WHEN g.stage = 'time_to_carrier' THEN lo1 + (hi1 - lo1) * (g.bin - 1) / 50 ELSE lo2 + (hi2 - lo2) * (g.bin - 1) / 50 END, 6) AS bin_lo,
  round(CASE WHEN g.stage = 'time_to_carrier' THEN lo1 + (hi1 - lo1) * g.bin / 50 ELSE lo2 + (hi2 - lo2) * g.bin / 50 END, 6) AS bin_hi,
  CAST(COALESCE(c.c, 0) AS BIGINT) AS count
FROM grid g CROSS JOIN bounds LEFT JOIN cnt c ON g.stage = c.stage AND g.bin = c.bin"""),
    "stratified_split": q("""
, hashed AS (
  SELECT is_late, CAST('0x' || substr(md5('42|' || order_id || '|' || seller_id || '|' || CAST(round(price * 100) AS BIGINT)), 1, 15) AS BIGINT) AS h
  FROM feat),
ranked AS (
  SELECT is_late, h, row_number() OVER (PARTITION BY is_late ORDER BY h) AS rn,
    CAST(round(COUNT(*) OVER (PARTITION BY is_late) * 0.2e0) AS BIGINT) AS k
  FROM hashed)
SELECT is_late AS label, COUNT(*) FILTER (WHERE rn > k) AS train_rows, COUNT(*) FILTER (WHERE rn <= k) AS test_rows,
  CAST(COALESCE(SUM(h % 1000003) FILTER (WHERE rn <= k), 0) AS BIGINT) AS test_digest
FROM ranked GROUP BY is_late"""),
    "seller_rate_asof": q("""
, rows_ AS (
  SELECT o.order_id, i.seller_id, o.order_purchase_timestamp, o.order_delivered_customer_date, o.is_late
  FROM late_orders o JOIN src_items i ON o.order_id = i.order_id
  WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL),
pts AS (SELECT DISTINCT seller_id, order_purchase_timestamp AS t FROM rows_),
hist AS (
  SELECT pts.seller_id, pts.t, COUNT(r.is_late) AS n, COALESCE(SUM(r.is_late), 0) AS l
  FROM pts LEFT JOIN rows_ r ON r.seller_id = pts.seller_id AND r.order_delivered_customer_date < pts.t
  GROUP BY 1, 2)
SELECT r.order_id, r.seller_id, r.order_purchase_timestamp, CAST(h.n AS BIGINT) AS seller_hist_items,
  CAST(h.l AS BIGINT) AS seller_hist_late, round(CASE WHEN h.n > 0 THEN h.l * 1.0e0 / h.n END, 6) AS seller_late_rate_asof
FROM rows_ r JOIN hist h ON r.seller_id = h.seller_id AND r.order_purchase_timestamp = h.t"""),
    "order_funnel": q("""
, c AS (
  SELECT COUNT(*) AS n0,
    COUNT(*) FILTER (WHERE order_approved_at IS NOT NULL) AS n1,
    COUNT(*) FILTER (WHERE order_approved_at IS NOT NULL AND order_delivered_carrier_date IS NOT NULL) AS n2,
    COUNT(*) FILTER (WHERE order_approved_at IS NOT NULL AND order_delivered_carrier_date IS NOT NULL
                      AND order_delivered_customer_date IS NOT NULL) AS n3,
    COUNT(*) FILTER (WHERE order_approved_at IS NOT NULL AND order_delivered_carrier_date IS NOT NULL
                      AND order_delivered_customer_date IS NOT NULL
                      AND order_delivered_customer_date <= order_estimated_delivery_date) AS n4
  FROM src_orders)
SELECT 1 AS stage_order, 'order approved' AS stage, CAST(n1 AS BIGINT) AS orders, round(n1 * 1.0e0 / n0, 6) AS share_of_orders FROM c
UNION ALL SELECT 2, 'handed to carrier', CAST(n2 AS BIGINT), round(n2 * 1.0e0 / n0, 6) FROM c
UNION ALL SELECT 3, 'delivered', CAST(n3 AS BIGINT), round(n3 * 1.0e0 / n0, 6) FROM c
UNION ALL SELECT 4, 'delivered on time', CAST(n4 AS BIGINT), round(n4 * 1.0e0 / n0, 6) FROM c"""),
    "handover_gap": q("""
SELECT seller_id, COUNT(*) AS orders, round(AVG(carrier_us) / 86400000000.0e0, 6) AS mean_gap_days,
  round(quantile_cont(time_to_carrier, 0.5), 6) AS p50_gap_days,
  round(quantile_cont(time_to_carrier, 0.9), 6) AS p90_gap_days
FROM life WHERE time_to_carrier IS NOT NULL GROUP BY seller_id"""),
    "late_by_distance": q("""
SELECT round(floor(distance_km / 250.0e0) * 250.0e0, 6) AS band_start_km,
  COALESCE(seller_state = customer_state, false) AS same_state,
  COUNT(*) AS rows, CAST(SUM(is_late) AS BIGINT) AS late, round(AVG(is_late), 6) AS late_rate,
  round(AVG(distance_km), 6) AS avg_distance_km
FROM feat WHERE distance_km IS NOT NULL GROUP BY 1, 2"""),
    "late_pareto": q("""
, ps AS (SELECT seller_id, CAST(SUM(is_late) AS BIGINT) AS late FROM master WHERE seller_id IS NOT NULL GROUP BY seller_id),
lv AS (SELECT late AS late_per_seller, COUNT(*) AS sellers FROM ps GROUP BY 1),
tot AS (SELECT SUM(late) AS tl, COUNT(*) AS ts FROM ps),
cum AS (
  SELECT late_per_seller, sellers,
    SUM(sellers) OVER (ORDER BY late_per_seller DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_sellers,
    SUM(sellers * late_per_seller) OVER (ORDER BY late_per_seller DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_late
  FROM lv)
SELECT late_per_seller, sellers, CAST(cum_sellers AS BIGINT) AS cum_sellers, CAST(cum_late AS BIGINT) AS cum_late,
  round(cum_sellers * 1.0e0 / ts, 6) AS seller_share,
  round(CASE WHEN tl > 0 THEN cum_late * 1.0e0 / tl ELSE 0 END, 6) AS late_share
FROM cum, tot"""),
    "review_by_late": q("""
SELECT is_late, round(AVG(review_score), 6) AS avg_review_score, COUNT(review_score) AS reviews, COUNT(*) AS rows,
  round(AVG(CASE WHEN review_score = 5 THEN 1.0e0 WHEN review_score IS NOT NULL THEN 0.0e0 END), 6) AS five_star_share
FROM master GROUP BY is_late"""),
    "worst_sellers": q("""
, cut AS (SELECT quantile_cont(seller_late_rate, 0.9) AS c FROM profile WHERE seller_late_rate IS NOT NULL)
SELECT seller_id, round(seller_late_rate, 6) AS seller_late_rate, seller_order_count, round(c, 6) AS cut_rate
FROM profile, cut WHERE seller_late_rate >= c"""),
    "routing_candidates": q("""
, cuts AS (SELECT quantile_cont(distance_km, 0.75) AS dc FROM feat WHERE distance_km IS NOT NULL),
wc AS (SELECT quantile_cont(product_weight_g, 0.75) AS wq FROM feat WHERE product_weight_g IS NOT NULL),
tagged AS (
  SELECT f.*, COALESCE(f.distance_km > dc AND f.product_weight_g > wq, false) AS premium_carrier
  FROM feat f, cuts, wc)
SELECT premium_carrier, COUNT(*) AS rows, round(AVG(is_late), 6) AS late_rate,
  round(AVG(distance_km), 6) AS avg_distance_km, round(AVG(product_weight_g), 6) AS avg_weight_g
FROM tagged GROUP BY 1"""),
    "category_translated": q("""
, lk AS (SELECT DISTINCT product_category_name, lower(product_category_name) AS product_category_name_english
        FROM src_products WHERE product_category_name NOT LIKE 'S%')
SELECT COALESCE(lk.product_category_name_english, m.product_category_name) AS product_category_name_english,
  COUNT(*) AS rows
FROM master m LEFT JOIN lk ON m.product_category_name = lk.product_category_name GROUP BY 1"""),
    "stage_density": q("""
, xs AS (SELECT 'time_to_carrier' AS stage, time_to_carrier AS x FROM life WHERE time_to_carrier IS NOT NULL
         UNION ALL SELECT 'time_in_transit', time_in_transit FROM life WHERE time_in_transit IS NOT NULL),
st AS (SELECT stage, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd, count(x) AS n FROM xs GROUP BY stage),
vals AS (SELECT stage, x, COUNT(*) AS c FROM xs GROUP BY 1, 2),
grid AS (SELECT st.*, i, lo + (hi - lo) * i / 199 AS g, sd * pow(n * 1.0e0, -0.2e0) AS h
         FROM st, range(0, 200) r(i))
SELECT grid.stage, CAST(i AS INTEGER) AS point, round(g, 6) AS x,
  round(SUM(c * exp(-pow((g - x) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 6) AS density
FROM grid JOIN vals ON grid.stage = vals.stage
GROUP BY grid.stage, i, g, n, h"""),
    "demand_by_state": q("""
SELECT product_category_name AS category, customer_state, COUNT(*) AS rows, round(SUM(price), 6) AS revenue,
  round(AVG(distance_km), 6) AS avg_distance_km, round(AVG(is_late), 6) AS late_rate
FROM feat GROUP BY 1, 2"""),
    "calendar_features": q("""
SELECT CAST(dayofweek(order_purchase_timestamp) = 5 AS INTEGER) AS is_friday,
  CAST(month(order_purchase_timestamp) = 12 AS INTEGER) AS is_december,
  COUNT(*) AS rows, round(AVG(is_late), 6) AS late_rate
FROM master GROUP BY 1, 2"""),
    "stream_late_monitor": q("""
, outcomes AS (
  SELECT o.order_id, s.seller_state, o.order_delivered_customer_date AS d, o.is_late,
    CAST(floor((year(o.order_delivered_customer_date) - min(year(o.order_delivered_customer_date)) OVER ()) / 2) AS INTEGER)
      + CASE WHEN o.order_id % 41 = 0 AND month(o.order_delivered_customer_date) <= 10 THEN 2 ELSE 0 END AS arrival
  FROM late_orders o JOIN src_items i ON o.order_id = i.order_id
  LEFT JOIN src_sellers s ON i.seller_id = s.seller_id
  WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL),
seen AS (SELECT arrival, max(max(d)) OVER (ORDER BY arrival) - INTERVAL 2 DAY AS mark FROM outcomes GROUP BY arrival),
kept AS (  -- an outcome is dropped if its window ended before the mark that the slices two and more before its own have set
  SELECT o.* FROM outcomes o ASOF LEFT JOIN seen ON o.arrival - 2 >= seen.arrival
  WHERE seen.mark IS NULL OR date_trunc('day', o.d) + INTERVAL 1 DAY > seen.mark)
SELECT date_trunc('day', d) AS window_start, date_trunc('day', d) + INTERVAL 1 DAY AS window_end,
  seller_state, COUNT(*) AS deliveries, CAST(SUM(is_late) AS BIGINT) AS late,
  round(SUM(is_late) * 1.0e0 / COUNT(*), 6) AS late_rate
FROM kept GROUP BY 1, 2, 3"""),
    "ensure_master": q("SELECT * REPLACE (round(price, 6) AS price, round(freight_value, 6) AS freight_value, "
                       "round(product_weight_g, 6) AS product_weight_g) FROM master"),
    "master_stored": q("SELECT * REPLACE (round(price, 6) AS price, round(freight_value, 6) AS freight_value, "
                       "round(product_weight_g, 6) AS product_weight_g) FROM master"),
    "review_fanout_bucketed": q("""
SELECT o.order_id, COUNT(*) AS rows, COUNT(r.review_score) AS reviewed_rows
FROM src_orders o JOIN src_items i ON o.order_id = i.order_id
LEFT JOIN src_reviews r ON o.order_id = r.order_id
WHERE o.order_status = 'delivered' AND o.order_delivered_customer_date IS NOT NULL
GROUP BY o.order_id"""),
    "dimension_keys": q("""
SELECT 'customers' AS dimension, COUNT(*) AS rows, COUNT(DISTINCT customer_id) AS keys FROM src_customers
UNION ALL SELECT 'products', COUNT(*), COUNT(DISTINCT product_id) FROM src_products
UNION ALL SELECT 'sellers', COUNT(*), COUNT(DISTINCT seller_id) FROM src_sellers"""),
    "raw_csv_roundtrip": q("""
SELECT order_id, review_score,
  CASE WHEN order_id % 7 <> 0 THEN 'so "good", ' || review_score || chr(10) || 'or ' || order_id END AS review_comment_message
FROM src_reviews"""),
    "profile_roundtrip": q("SELECT seller_id, round(seller_late_rate, 6) AS seller_late_rate, seller_order_count FROM profile"),
    "raw_zone_loaded": q("""
SELECT 'products' AS table, 'loaded' AS state, COUNT(*) FILTER (WHERE product_id % 13 <> 0) AS rows,
  COUNT(*) FILTER (WHERE product_id % 13 = 0) AS rejects,
  CAST(SUM(length(product_category_name) + CASE WHEN product_id % 9 = 0 THEN 12 ELSE 0 END) FILTER (WHERE product_id % 13 <> 0) AS BIGINT) AS characters
FROM src_products
UNION ALL SELECT 'sellers', 'loaded', COUNT(*), 0, CAST(SUM(length(seller_state)) AS BIGINT) FROM src_sellers
UNION ALL SELECT 'customers', 'missing', NULL, NULL, NULL"""),
    "records_parsed": q("""
, open_rows AS (
  SELECT o.order_id, i.seller_id, p.product_weight_g, i.freight_value, i.price, o.order_id % 10 AS d
  FROM src_orders o JOIN src_items i ON o.order_id = i.order_id LEFT JOIN src_products p ON i.product_id = p.product_id
  WHERE o.order_status <> 'delivered')
SELECT order_id, seller_id, round(product_weight_g, 6) AS product_weight_g, round(freight_value, 6) AS freight_value,
  CASE WHEN d <> 3 THEN round(price, 6) END AS price, 'ok' AS reason
FROM open_rows WHERE d NOT IN (7, 9)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, CASE WHEN d = 7 THEN 'wrong_type:price' ELSE 'not_a_record' END FROM open_rows WHERE d IN (7, 9)"""),
    "features_adaptive": q("""
SELECT order_id, seller_id, round(distance_km, 6) AS distance_km,
  round(CASE WHEN seller_id % 3 <> 0 THEN seller_id % 20 / 20.0e0 ELSE (SELECT AVG(seller_late_rate) FROM profile) END, 6) AS seller_late_rate,
  round(COALESCE(product_weight_g, (SELECT AVG(product_weight_g) FROM dist_master)), 6) AS product_weight_g, is_late
FROM dist_master WHERE distance_km IS NOT NULL"""),
    "train_gbt": q("""
, hashed AS (
  SELECT is_late, seller_late_rate AS p, CAST('0x' || substr(md5('42|' || order_id || '|' || seller_id || '|' || CAST(round(price * 100) AS BIGINT)), 1, 15) AS BIGINT) AS h
  FROM feat),
fitted AS (
  SELECT is_late, p FROM (SELECT *, row_number() OVER (PARTITION BY is_late ORDER BY h) AS rn, COUNT(*) OVER (PARTITION BY is_late) AS n FROM hashed)
  WHERE rn > CAST(round(n * 0.2e0) AS BIGINT)),
placed AS (SELECT is_late, rank() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0e0 AS r FROM fitted),
auc AS (
  SELECT (SUM(r) FILTER (WHERE is_late = 1) - pos * (pos + 1) / 2.0e0) / (pos * neg) AS rate_auc
  FROM placed, (SELECT COUNT(*) FILTER (WHERE is_late = 1) AS pos, COUNT(*) FILTER (WHERE is_late = 0) AS neg FROM fitted) GROUP BY pos, neg)
SELECT is_late AS label, COUNT(*) - CAST(round(COUNT(*) * 0.2e0) AS BIGINT) AS train_rows,
  CAST(round(COUNT(*) * 0.2e0) AS BIGINT) AS test_rows, CAST(0 AS BIGINT) AS bad_scores,
  round((SELECT rate_auc FROM auc), 6) AS rate_auc, true AS beats_rate
FROM feat GROUP BY is_late"""),
    "score_orders": q(_scoring),
    "stream_scored": q(_scoring),
    "daily_orders": q("""
SELECT CAST(order_purchase_timestamp AS DATE) AS day, COUNT(*) AS orders FROM src_orders GROUP BY 1"""),
}


def oracle_queries() -> dict[str, str]:
    return dict(ORACLE)
