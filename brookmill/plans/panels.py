"""Panels of a live dashboard as named queries over the lake's tables: each returns a small DataFrame."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.operators.dedup import keep_first


def since(df: DataFrame, column: str, minutes: int) -> DataFrame:
    """Rows of the last minutes (15, 30, 60 and 240 are offered); the bound is a literal and reaches the scan."""
    return df.where(F.col(column) >= F.lit(datetime.now(timezone.utc) - timedelta(minutes=minutes)))


def open_breaches(alerts: DataFrame) -> DataFrame:
    closed = alerts.where("alert_type = 'DELIVERED_AFTER_BREACH'").select("order_id")
    return alerts.where("alert_type = 'SLA_BREACH'").join(closed, "order_id", "left_anti")


def kpis(zones: DataFrame, alerts: DataFrame, checkouts: DataFrame, events: DataFrame) -> DataFrame:
    """One row: orders, gmv, open_breaches, conversion_rate, p95_latency_seconds (from broker to silver)."""
    latency = (F.unix_micros("silver_processed_at") - F.unix_micros("kafka_ts")) / 1e6
    parts = [
        zones.agg(F.sum("orders_placed").alias("orders"), F.sum("gmv").alias("gmv")),
        open_breaches(alerts).agg(F.countDistinct("order_id").alias("open_breaches")),
        checkouts.agg(F.avg(F.col("converted").cast("int")).alias("conversion_rate")),
        events.agg(F.percentile(latency, 0.95).alias("p95_latency_seconds")),
    ]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")  # one row each
    return out.drop("_k")


def per_minute(zones: DataFrame) -> DataFrame:
    return zones.groupBy("window_start").agg(F.sum("orders_placed").alias("orders"), F.sum("gmv").alias("gmv")).orderBy("window_start")


def per_zone(zones: DataFrame) -> DataFrame:
    return zones.groupBy("zone").agg(F.sum("orders_placed").alias("orders"), F.sum("gmv").alias("gmv")).orderBy(F.desc("gmv"), "zone")


def longest_open(alerts: DataFrame, n: int = 15) -> DataFrame:
    minutes = F.round(F.col("open_seconds") / 60, 1).alias("open_minutes")
    return open_breaches(alerts).orderBy(F.desc("detected_at"), "order_id").limit(n).select("order_id", "zone", "restaurant_id", "last_status", "detected_at", minutes)


def statuses(current: DataFrame) -> DataFrame:
    return current.groupBy("status").count().orderBy(F.desc("count"), "status")


def stream_health(progress: DataFrame, layers: tuple[str, ...] = ()) -> DataFrame:
    """Newest progress of each query with the late rows it has dropped so far."""
    rows = progress.where(F.split("query", "_")[0].isin(*layers)) if layers else progress
    last = keep_first(rows, ["query"], [F.desc("batch_id"), F.desc("timestamp")]).drop("rows_dropped_by_watermark")
    return last.join(rows.groupBy("query").agg(F.sum("rows_dropped_by_watermark").alias("rows_dropped_by_watermark")), "query", "left")


def dead_letters(dead: DataFrame) -> DataFrame:
    return dead.groupBy("source_topic", "primary_reason").count().orderBy(F.desc("count"), "source_topic", "primary_reason")
