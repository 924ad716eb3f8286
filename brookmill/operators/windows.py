"""Event-time windows, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.schemas import USER_SESSIONS, ZONE_METRICS, shaped


def _watermarked(df: DataFrame, event_time: str, delay: str | None) -> DataFrame:
    return df if delay is None else df.withWatermark(event_time, delay)


def windowed(df: DataFrame, event_time: str, width: str, keys: list[str], measures: list[Column], *, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows: window_start, window_end, keys, measures. delay: watermark, for streams in append mode."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    grouped = _watermarked(df, event_time, delay).groupBy(window.alias("_w"), *keys).agg(*measures)
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in grouped.columns if c != "_w"])


def sessions(df: DataFrame, event_time: str, gap: str, keys: list[str], measures: list[Column], *, delay: str | None = None) -> DataFrame:
    """Sessions that end after `gap` without an event; a gap of exactly that length still belongs to the session."""
    grouped = _watermarked(df, event_time, delay).groupBy(F.session_window(event_time, gap).alias("_w"), *keys).agg(*measures)
    return grouped.select(F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *[c for c in grouped.columns if c != "_w"])


def count_where(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def any_where(condition: Column, name: str) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)).cast("boolean").alias(name)


def seconds(later: str, earlier: str) -> Column:
    """Seconds between two timestamps (with or without zone), to the microsecond."""
    return (F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))) / F.lit(1e6)


def zone_metrics(orders: DataFrame, delay: str | None = None, width: str = "1 minute") -> DataFrame:
    """Orders and value by zone and minute."""
    status = F.col("status")
    of_placed = lambda c: F.when(status == "PLACED", F.col(c))
    counted = {"orders_placed": "PLACED", "orders_delivered": "DELIVERED", "orders_cancelled": "CANCELLED"}
    measures = [count_where(status == value, name) for name, value in counted.items()]
    measures += [F.sum(of_placed("amount")).alias("gmv"), F.approx_count_distinct(of_placed("customer_id")).alias("unique_customers"), F.count("*").alias("events")]
    found = windowed(orders, "event_ts", width, ["zone"], measures, delay=delay)
    return shaped(found, ZONE_METRICS, gmv=F.coalesce("gmv", F.lit(0)), emitted_at=F.current_timestamp())


def user_sessions(clicks: DataFrame, gap_seconds: int, delay: str | None = None) -> DataFrame:
    """Sessions of a customer by inactivity, whatever session ids the clients sent."""
    order = F.struct("event_ts", "event_id")
    measures = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ("zone", "device")]
    measures += [any_where(F.col("event_type") == value, name) for name, value in (("added_to_cart", "add_to_cart"), ("reached_checkout", "checkout_started"))]
    measures += [F.count("*").alias("events"), F.approx_count_distinct("restaurant_id").alias("restaurants_viewed")]
    measures += [f("event_ts").alias(name) for f, name in ((F.min, "_first"), (F.max, "_last"))]
    found = sessions(clicks, "event_ts", f"{gap_seconds} seconds", ["customer_id"], measures, delay=delay)
    return shaped(found, USER_SESSIONS, active_seconds=seconds("_last", "_first"), emitted_at=F.current_timestamp())
