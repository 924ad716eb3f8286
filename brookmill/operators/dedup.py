"""De-duplication: the first row of each key in batch, and within a watermark in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a given total order. Catalyst limits groups before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_arrivals(df: DataFrame, key: str = "event_id") -> DataFrame:
    return keep_first(df, [key], ["kafka_ts", "kafka_partition", "kafka_offset"])


def within_watermark(df: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Streams: the first arrival of each key; state is dropped `delay` after its event time, later repeats with it."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
