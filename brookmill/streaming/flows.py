"""The dataflows: raw log to bronze, bronze to silver, silver to gold, with their sinks and checkpoints."""

from __future__ import annotations

import json
import signal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brookmill import schemas
from brookmill.config import Settings
from brookmill.operators.dedup import first_arrivals, within_watermark
from brookmill.operators.frames import decode_frames, parse_clicks
from brookmill.operators.joins import checkout_conversion
from brookmill.operators.latest import insert_only, latest_orders, rank_of
from brookmill.operators.quality import apply_rules, click_rules, dead_letters, order_rules, route
from brookmill.operators.sla import sla_alerts
from brookmill.operators.windows import user_sessions, zone_metrics
from brookmill.sources.registry import SchemaResolver
from brookmill.store import Folder, TableStore, occurring

#: How columns of orders_current move in a merge.
ORDERS_MERGE = dict(
    rank="status_rank", event_time="last_event_ts", follow=["status", "status_rank"], latest=["last_event_ts", "updated_at"],
    earliest=["placed_ts"], fill=["amount", "payment_method", "session_id"],
)
LOG = "topic string, kafka_partition int, kafka_offset long, kafka_ts timestamp, key binary, value binary"
ORDER_BUCKETS = 16


# -- bronze -------------------------------------------------------------------


def kafka_log(spark: SparkSession, s: Settings) -> DataFrame:
    """The log as a stream from Kafka (needs Spark's Kafka package)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", s.kafka_bootstrap)
        .option("subscribe", f"{s.order_topic},{s.click_topic}")
        .option("startingOffsets", s.starting_offsets)
        .option("maxOffsetsPerTrigger", s.max_offsets_per_trigger)
        .option("failOnDataLoss", "false")
        .load()
    )
    return raw.select("topic", F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_ts"), "key", "value")


def file_log(spark: SparkSession, folder: str, files_per_trigger: int = 200) -> DataFrame:
    """The log as a stream of Parquet files of its rows."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def bronze_rows(log: DataFrame) -> DataFrame:
    return log.withColumns({"ingested_at": F.current_timestamp(), "ingest_date": F.current_date()}).select(*schemas.BRONZE.names)


def _started(df: DataFrame, name: str, s: Settings, once: bool):
    writer = df.writeStream.queryName(name).option("checkpointLocation", s.paths.checkpoint(name))
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=s.trigger_interval)


def append_files(df: DataFrame, name: str, path: str, s: Settings, once: bool, partition_by: tuple = ()) -> StreamingQuery:
    """Append-only file sink; its metadata log makes it exactly once. One query for each folder."""
    return _started(df, name, s, once).format("parquet").outputMode("append").partitionBy(*partition_by).start(path)


def start_bronze(log: DataFrame, s: Settings, once: bool = False) -> StreamingQuery:
    return append_files(bronze_rows(log), "bronze_ingest", s.paths.table("events_raw"), s, once, ("topic", "ingest_date"))


def bronze_stream(spark: SparkSession, s: Settings, topic: str) -> DataFrame:
    """Rows of one topic; the filter prunes partitions."""
    path = s.paths.table("events_raw")
    return spark.readStream.schema(schemas.BRONZE).option("maxFilesPerTrigger", s.max_files_per_trigger).option("basePath", path).parquet(path).where(F.col("topic") == topic)


# -- silver -------------------------------------------------------------------


def ensure_silver(spark: SparkSession, s: Settings) -> dict[str, TableStore]:
    p = s.paths.table
    return {
        "order_events": TableStore(spark, p("order_events")).ensure(schemas.ORDER_EVENTS, ["event_date"]),
        "orders_current": TableStore(spark, p("orders_current")).ensure(schemas.ORDERS_CURRENT, buckets=ORDER_BUCKETS),
        "clickstream": TableStore(spark, p("clickstream")).ensure(schemas.CLICKS, ["event_date"]),
        "dead_letter": TableStore(spark, p("dead_letter")).ensure(schemas.DEAD_LETTER, ["detected_date"]),
    }


def judged_orders(bronze: DataFrame, resolver: SchemaResolver, skew_seconds: int) -> DataFrame:
    return apply_rules(decode_frames(bronze, resolver), order_rules(skew_seconds), "parse_error")


def judged_clicks(bronze: DataFrame, skew_seconds: int) -> DataFrame:
    return apply_rules(parse_clicks(bronze), click_rules(skew_seconds), "parse_error")


def silver_orders(valid: DataFrame) -> DataFrame:
    """Valid order events in the table's shape, the first arrival of each id."""
    shaped = valid.withColumns({"status_rank": rank_of("status"), "event_date": F.to_date("event_ts"), "bronze_ingested_at": F.col("ingested_at"), "silver_processed_at": F.current_timestamp()})
    return first_arrivals(shaped).select(*schemas.ORDER_EVENTS.names)


def silver_clicks(valid: DataFrame) -> DataFrame:
    return valid.withColumns({"event_date": F.to_date("event_ts"), "silver_processed_at": F.current_timestamp()}).select(*schemas.CLICKS.names)


def order_batch(batch: DataFrame, batch_id: int, *, tables: dict[str, TableStore], resolver: SchemaResolver, skew_seconds: int, application: str = "silver_orders", changes: str | None = None) -> dict:
    """One micro-batch of order messages: dead letters, new events, current state, in this order. Each commit takes effect once however often the batch is repeated.

    changes: folder that gets each batch's new events as a feed for streams, published once for each batch number.
    """
    judged = judged_orders(batch, resolver, skew_seconds).persist()
    try:
        valid, invalid = route(judged)
        tables["dead_letter"].append(dead_letters(invalid, application), txn=(application, batch_id))
        events = silver_orders(valid).persist()
        try:
            if changes:
                have = tables["order_events"].read().where(occurring(events, "event_date"))
                fresh = insert_only(have, events, ["event_date", "event_id"])
                Folder(batch.sparkSession, changes).publish(fresh.select(*schemas.ORDER_EVENTS.names), f"batch={batch_id}")
            tables["order_events"].merge_insert_only(events, ["event_date", "event_id"], prune="event_date", txn=(application, batch_id))
            tables["orders_current"].upsert(latest_orders(events), "order_id", txn=(application, batch_id), **ORDERS_MERGE)
        finally:
            events.unpersist()
        counts = judged.groupBy("is_valid").count().collect()
    finally:
        judged.unpersist()
    by = {r["is_valid"]: r["count"] for r in counts}
    return {"valid": by.get(True, 0), "invalid": by.get(False, 0)}


def click_batch(batch: DataFrame, batch_id: int, *, table: TableStore, changes: str, application: str = "silver_clicks") -> None:
    """One micro-batch of clicks to the table and to the feed, each of which takes it once however often it is repeated."""
    batch.persist()
    try:
        table.append(batch, txn=(application, batch_id))
        Folder(batch.sparkSession, changes).publish(batch, f"batch={batch_id}")
    finally:
        batch.unpersist()


def start_silver(spark: SparkSession, s: Settings, resolver: SchemaResolver, once: bool = False) -> list[StreamingQuery]:
    """Orders (merged batch by batch), clicks (de-duplicated within a watermark) and dead letters of clicks."""
    tables, skew = ensure_silver(spark, s), s.max_future_skew_seconds

    def orders(batch: DataFrame, batch_id: int) -> None:
        order_batch(batch, batch_id, tables=tables, resolver=resolver, skew_seconds=skew, changes=f"{s.paths.table('order_events')}_changes")

    def appended(table: str, application: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, batch_id: tables[table].append(batch, txn=(application, batch_id)) and None

    def clicks(batch: DataFrame, batch_id: int) -> None:
        click_batch(batch, batch_id, table=tables["clickstream"], changes=f"{s.paths.table('clickstream')}_changes")

    judged = judged_clicks(bronze_stream(spark, s, s.click_topic), skew)
    valid, invalid = route(judged)
    unique = silver_clicks(within_watermark(valid, ["event_id"], "event_ts", s.clickstream_dedup_window))
    return [
        _started(bronze_stream(spark, s, s.order_topic), "silver_orders", s, once).foreachBatch(orders).start(),
        _started(unique, "silver_clicks", s, once).foreachBatch(clicks).start(),
        _started(dead_letters(invalid, "silver_clicks"), "silver_clicks_dlq", s, once).foreachBatch(appended("dead_letter", "silver_clicks_dlq")).start(),
    ]


# -- gold ---------------------------------------------------------------------


def changes(spark: SparkSession, s: Settings, table: str, schema) -> DataFrame:
    """New rows of a silver table as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", s.max_files_per_trigger).parquet(f"{s.paths.table(table)}_changes/batch=*")


def start_gold(spark: SparkSession, s: Settings, once: bool = False) -> list[StreamingQuery]:
    orders = lambda: changes(spark, s, "order_events", schemas.ORDER_EVENTS)
    clicks = lambda: changes(spark, s, "clickstream", schemas.CLICKS)
    flows = {
        "zone_metrics_1m": zone_metrics(orders(), s.watermark_delay),
        "sla_alerts": sla_alerts(orders(), s.order_sla_seconds, s.order_state_ttl_seconds, s.alert_watermark_delay),
        "checkout_conversion": checkout_conversion(clicks(), orders(), s.checkout_to_order_seconds, s.alert_watermark_delay),
        "user_sessions": user_sessions(clicks(), s.session_gap_seconds, s.watermark_delay),
    }
    return [append_files(df, f"gold_{name}", s.paths.table(name), s, once) for name, df in flows.items()]


def supervise(spark: SparkSession) -> int:
    """Waits until a query ends; stops all on SIGTERM or SIGINT. 0 after a signal, 1 after a failure."""
    asked = []

    def stop(*_):
        asked.append(True)
        for q in spark.streams.active:
            q.stop()

    for number in (signal.SIGTERM, signal.SIGINT):
        signal.signal(number, stop)
    try:
        spark.streams.awaitAnyTermination()
    except Exception as e:  # noqa: BLE001  reported, then the process ends
        print(json.dumps({"failed": str(e)[:2000]}))
        stop()
        return 1
    return 0 if asked else 1
