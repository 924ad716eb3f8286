"""Contracts of the event tables and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T



def _table(columns: str) -> T.StructType:
    """Columns as "name type" or "name type not null", separated by ", "; needs no session, unlike Spark's own parser."""
    simple = {"string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType(), "date": T.DateType(), "binary": T.BinaryType()}
    kinds = simple | {"decimal(10,2)": T.DecimalType(10, 2), "decimal(20,2)": T.DecimalType(20, 2), "array<string>": T.ArrayType(T.StringType())}
    fields = [c.split(" ", 2) for c in columns.split(", ")]
    return T.StructType([T.StructField(f[0], kinds[f[1]], len(f) < 3) for f in fields])


# Fixed values.
STATUS_RANK = {"PLACED": 1, "ACCEPTED": 2, "PICKED_UP": 3, "DELIVERED": 4, "CANCELLED": 4}
CLICK_TYPES = ("app_open", "search", "view_restaurant", "add_to_cart", "checkout_started")
NOT_FRAMED, UNKNOWN_SCHEMA, UNDECODABLE, MALFORMED = "NOT_CONFLUENT_AVRO", "UNKNOWN_SCHEMA_ID", "AVRO_DECODE_ERROR", "MALFORMED_JSON"
ORDER_TOPIC, CLICK_TOPIC = "order_events", "clickstream"

#: Latest version of an order event; earlier ones lack payment_method.
ORDER_EVENT = _table(
    "event_id string, order_id string, customer_id string, session_id string, restaurant_id string, zone string, "
    "status string, amount decimal(10,2), event_ts timestamp, payment_method string"
)
#: A click as it arrives: event_ts in epoch milliseconds.
CLICK_EVENT = _table(
    "event_id string, session_id string, customer_id string, event_type string, restaurant_id string, zone string, "
    "device string, event_ts long"
)

BRONZE = _table(
    "topic string, kafka_partition int, kafka_offset long, kafka_ts timestamp, key binary, value binary, "
    "ingested_at timestamp, ingest_date date"
)
ORDER_EVENTS = _table(
    "event_id string not null, order_id string not null, customer_id string, session_id string, restaurant_id string, "
    "zone string, status string, status_rank int, amount decimal(10,2), payment_method string, event_ts timestamp, "
    "event_date date, schema_id long, kafka_partition int, kafka_offset long, kafka_ts timestamp, "
    "bronze_ingested_at timestamp, silver_processed_at timestamp"
)
ORDERS_CURRENT = _table(
    "order_id string not null, customer_id string, session_id string, restaurant_id string, zone string, status string, "
    "status_rank int, amount decimal(10,2), payment_method string, placed_ts timestamp, last_event_ts timestamp, "
    "updated_at timestamp"
)
CLICKS = _table(
    "event_id string not null, session_id string, customer_id string, event_type string, restaurant_id string, "
    "zone string, device string, event_ts timestamp, event_date date, kafka_partition int, kafka_offset long, "
    "kafka_ts timestamp, silver_processed_at timestamp"
)
DEAD_LETTER = _table(
    "source_topic string, pipeline_stage string, kafka_partition int, kafka_offset long, kafka_ts timestamp, "
    "event_id string, primary_reason string, error_reasons array<string>, raw_value binary, detected_at timestamp, "
    "detected_date date"
)
ALERTS = (
    "order_id string, zone string, restaurant_id string, alert_type string, last_status string, "
    "placed_ts timestamp, detected_at timestamp, open_seconds double"
)
# Columns of the gold tables.
ZONE_METRICS = _table(
    "window_start timestamp, window_end timestamp, zone string, orders_placed long, gmv decimal(20,2), orders_delivered long, "
    "orders_cancelled long, unique_customers long, events long, emitted_at timestamp"
)
CHECKOUT_CONVERSION = _table(
    "session_id string, customer_id string, zone string, restaurant_id string, device string, checkout_ts timestamp, "
    "order_id string, amount decimal(10,2), order_ts timestamp, converted boolean, seconds_to_order double, emitted_at timestamp"
)
USER_SESSIONS = _table(
    "session_start timestamp, session_end timestamp, customer_id string, zone string, device string, events long, "
    "active_seconds double, added_to_cart boolean, reached_checkout boolean, restaurants_viewed long, emitted_at timestamp"
)


def shaped(df, contract: T.StructType, **computed):
    """df in the shape of a contract: its columns in order and type, from `computed` where that has them."""
    return df.select(*[(computed[f.name] if f.name in computed else df[f.name]).cast(f.dataType).alias(f.name) for f in contract.fields])
