"""Time-bounded outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.operators.windows import seconds
from brookmill.schemas import CHECKOUT_CONVERSION, CLICKS, shaped


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_time: str, right_time: str, within_seconds: int, how: str = "left_outer", delay: str | None = None) -> DataFrame:
    """Rows of right whose time is 0 to within_seconds after that of left, ends included.

    An equi-join on keys with the bound as residual; in streams the bound and the watermarks let state expire, so every
    unmatched left row comes out once both sides have passed it.
    """
    if delay is not None:
        left, right = left.withWatermark(left_time, delay), right.withWatermark(right_time, delay)
    on = [F.col(a) == F.col(b) for a, b in keys]
    on += [F.col(right_time) >= F.col(left_time), F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within_seconds} SECONDS")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(right, condition, how)


def checkout_conversion(clicks: DataFrame, orders: DataFrame, within_seconds: int, delay: str | None = None) -> DataFrame:
    """Each checkout with the orders placed in its session soon after, or none."""
    of_click = [f.name for f in CHECKOUT_CONVERSION.fields if f.name in CLICKS.names]
    checkouts = clicks.where("event_type = 'checkout_started'").select(*of_click, F.col("event_ts").alias("checkout_ts"))
    placed = orders.where("status = 'PLACED'").select(F.col("session_id").alias("_session"), "order_id", "amount", F.col("event_ts").alias("order_ts"))
    joined = interval_join(checkouts, placed, [("session_id", "_session")], "checkout_ts", "order_ts", within_seconds, delay=delay)
    return shaped(joined, CHECKOUT_CONVERSION, converted=F.col("order_id").isNotNull(), seconds_to_order=seconds("order_ts", "checkout_ts"), emitted_at=F.current_timestamp())
