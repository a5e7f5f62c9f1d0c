"""Declared schemas for every table the pipeline reads or writes (no inference)."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DateType, DoubleType, IntegerType,
                               LongType, StringType, StructField, StructType)

# Raw flat GA export: one row per session.
RAW_SESSIONS = StructType([
    StructField("fullVisitorId", StringType()),
    StructField("visitId", LongType()),
    StructField("session_id", StringType()),
    StructField("date", StringType()),                 # yyyyMMdd
    StructField("channelGrouping", StringType()),
    StructField("deviceCategory", StringType()),
    StructField("country", StringType()),
    StructField("totals_pageviews", IntegerType()),
    StructField("totals_bounces", IntegerType()),
    StructField("totals_hits", IntegerType()),
    StructField("totals_transactions", IntegerType()),
    StructField("totals_transactionRevenue", LongType()),   # micros
])

# Raw flat GA export: one row per e-commerce hit.
RAW_HITS = StructType([
    StructField("session_id", StringType()),
    StructField("hitNumber", IntegerType()),
    StructField("hit_type", StringType()),
    StructField("eCommerceAction_action_type", IntegerType()),
    StructField("productSKU", StringType()),
    StructField("v2ProductCategory", StringType()),
    StructField("productPrice", DoubleType()),
])

PRODUCTS = StructType([
    StructField("productSKU", StringType()),
    StructField("v2ProductCategory", StringType()),
    StructField("productPrice", DoubleType()),
])

# Nested export: one row per session with a repeated hits record. Our nested
# writer cuts a session into several records (``hit_fragment``) of one
# ``record_id``, so that no single array grows without bound.
NESTED_HIT = StructType([
    StructField("hitNumber", IntegerType()),
    StructField("eCommerceAction", StructType([StructField("action_type", StringType())])),
])

NESTED_SESSIONS = StructType([
    StructField("fullVisitorId", StringType()),
    StructField("visitId", LongType()),
    StructField("date", StringType()),
    StructField("channelGrouping", StringType()),
    StructField("device", StructType([StructField("deviceCategory", StringType())])),
    StructField("geoNetwork", StructType([StructField("country", StringType())])),
    StructField("totals", StructType([
        StructField("pageviews", IntegerType()),
        StructField("transactions", IntegerType()),
        StructField("transactionRevenue", LongType()),
    ])),
    StructField("hits", ArrayType(NESTED_HIT)),
])

# Clean tables.
CLEAN_SESSIONS = StructType([
    StructField("session_id", StringType()),
    StructField("fullVisitorId", StringType()),
    StructField("date", DateType()),
    StructField("channel", StringType()),
    StructField("device", StringType()),
    StructField("country", StringType()),
    StructField("pageviews", IntegerType()),
    StructField("reached_product_view", BooleanType()),
    StructField("reached_cart", BooleanType()),
    StructField("reached_checkout", BooleanType()),
    StructField("purchased", BooleanType()),
    StructField("revenue", DoubleType()),
    StructField("revenue_micros", LongType()),
])

PURCHASES = StructType([
    StructField("session_id", StringType()),
    StructField("date", DateType()),
    StructField("productSKU", StringType()),
    StructField("category", StringType()),
    StructField("channel", StringType()),
    StructField("device", StringType()),
    StructField("item_value", DoubleType()),
])
