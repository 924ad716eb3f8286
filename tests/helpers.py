"""Builders of rows for the stream tests."""

from datetime import datetime, timedelta, timezone
from decimal import Decimal

from brookmill.functions.avro import encode, frame
from brookmill.schemas import BRONZE
from brookmill.sources.simulate import SCHEMAS

BASE = datetime(2026, 1, 15, 10, tzinfo=timezone.utc)


def order(event_id, order_id, status, offset_s=0, version=1, **other):
    value = dict(event_id=event_id, order_id=order_id, customer_id="C000001", session_id="S-1", restaurant_id="R0001", zone="ZONE_01", status=status, amount=Decimal("250.00"), event_ts=BASE + timedelta(seconds=offset_s)) | other
    return frame(version, encode(SCHEMAS[version], value))


def bronze(spark, values, topic="order_events", start=0):
    rows = []
    for i, value in enumerate(values, start):
        at = BASE + timedelta(seconds=i)
        rows.append((topic, 0, i, at, b"k", value, at + timedelta(milliseconds=500), BASE.date()))
    return spark.createDataFrame(rows, BRONZE)
