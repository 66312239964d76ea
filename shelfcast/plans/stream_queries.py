"""Queries that run as streams, and the SQL that states their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.shared import removed, shared_folder
from ..streaming import rolling
from .panel_queries import query, tidy

_WINDOWS = ", ".join(
    [f"first(sales_count) OVER (PARTITION BY store_id, product_id ORDER BY day RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING) AS sales_lag_{k}" for k in rolling.LAGS]
    + [f"round({f}(sales_count) OVER (PARTITION BY store_id, product_id ORDER BY day RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS sales_{kind}_{n}" for n in rolling.SPANS for kind, f in (("mean", "avg"), ("std", "stddev_samp"))]
)
_LAGS = ", ".join(f"round(sales_lag_{k}, 6) AS sales_lag_{k}" for k in rolling.LAGS)


@query(
    f"""WITH daily AS (
  SELECT CAST(ts AS DATE) AS date, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, user_id AS store_id, event_type AS product_id, sum(value) AS sales_count
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL
), told AS (SELECT date, store_id, product_id, sales_count, {_WINDOWS} FROM daily)
SELECT * REPLACE (round(sales_count, 6) AS sales_count, {_LAGS}) FROM told
WHERE date + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events WHERE value IS NOT NULL)"""
)
def st_rolling_features(spark, sf_dir):
    """The events as a stream of sales of (user, kind): every day that its watermark has passed."""
    table = f"{sf_dir}/events.parquet"
    # a stream takes a folder or a pattern; the table is a file or a folder
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{table}*")
    # times without a zone are told as those of UTC
    ts = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts))") if dict(stream.dtypes)["ts"] == "timestamp_ntz" else F.col("ts")
    sales = stream.select(ts.alias("ts"), F.col("user_id").alias("store_id"), F.col("event_type").alias("product_id"), F.col("value").alias("quantity"))
    features = rolling.rolling_features(rolling.daily_sales(sales))
    name = f"{shared_folder(spark)}/tables/stream-{uuid.uuid4().hex}"
    try:
        rolling.drained(spark, features, name, f"{name}-state")
    finally:
        removed(spark, f"{name}-state")
    return tidy(spark.read.schema(features.schema).parquet(name))
