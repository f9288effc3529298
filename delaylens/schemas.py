"""Explicit schemas of the logical tables (no inference anywhere).

Raw CSV schemas list every column of the public e-commerce order export in
file order, because CSV columns are positional; each operator selects only
the columns it reads, so scans prune the rest.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


ORDERS = _struct(
    ("order_id", S),
    ("customer_id", S),
    ("order_status", S),
    ("order_purchase_timestamp", TS),
    ("order_approved_at", TS),
    ("order_delivered_carrier_date", TS),
    ("order_delivered_customer_date", TS),
    ("order_estimated_delivery_date", TS),
)

ORDER_ITEMS = _struct(
    ("order_id", S),
    ("order_item_id", I),
    ("product_id", S),
    ("seller_id", S),
    ("shipping_limit_date", TS),
    ("price", D),
    ("freight_value", D),
)

PRODUCTS = _struct(
    ("product_id", S),
    ("product_category_name", S),
    ("product_name_lenght", I),
    ("product_description_lenght", I),
    ("product_photos_qty", I),
    ("product_weight_g", D),
    ("product_length_cm", D),
    ("product_height_cm", D),
    ("product_width_cm", D),
)

SELLERS = _struct(
    ("seller_id", S),
    ("seller_zip_code_prefix", I),
    ("seller_city", S),
    ("seller_state", S),
)

CUSTOMERS = _struct(
    ("customer_id", S),
    ("customer_unique_id", S),
    ("customer_zip_code_prefix", I),
    ("customer_city", S),
    ("customer_state", S),
)

ORDER_REVIEWS = _struct(
    ("review_id", S),
    ("order_id", S),
    ("review_score", I),
    ("review_comment_title", S),
    ("review_comment_message", S),
    ("review_creation_date", TS),
    ("review_answer_timestamp", TS),
)

GEOLOCATION = _struct(
    ("geolocation_zip_code_prefix", I),
    ("geolocation_lat", D),
    ("geolocation_lng", D),
    ("geolocation_city", S),
    ("geolocation_state", S),
)

CATEGORY_TRANSLATION = _struct(
    ("product_category_name", S),
    ("product_category_name_english", S),
)

# Default raw-zone layout: <table>.csv per logical table. Pass another
# {file name: (table, schema)} mapping to ``load_raw_zone`` for exports that
# use different file names.
RAW_FILES = {
    "orders.csv": ("orders", ORDERS),
    "order_items.csv": ("order_items", ORDER_ITEMS),
    "products.csv": ("products", PRODUCTS),
    "sellers.csv": ("sellers", SELLERS),
    "customers.csv": ("customers", CUSTOMERS),
    "order_reviews.csv": ("order_reviews", ORDER_REVIEWS),
    "geolocation.csv": ("geolocation", GEOLOCATION),
}

# Model inputs, in the order the classifier sees them.
FEATURES = ["distance_km", "seller_late_rate", "product_weight_g", "freight_value", "price"]
LABEL = "is_late"

# Scoring record: what a caller supplies for a not-yet-delivered order.
SCORING_RECORD = _struct(
    ("order_id", S),
    ("seller_id", S),
    ("seller_zip_code_prefix", I),
    ("customer_zip_code_prefix", I),
    ("product_weight_g", D),
    ("freight_value", D),
    ("price", D),
)
