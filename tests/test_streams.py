"""Real streaming queries: file source, several batches, restarts."""

import os
import time
from datetime import timedelta

import pytest
from helpers import BASE, bronze, order

from brookmill import schemas
from brookmill.config import Settings
from brookmill.operators import dedup, sla, windows
from brookmill.plans import panels
from brookmill.sources.registry import StaticResolver
from brookmill.sources.simulate import SCHEMAS, Faults, Rates, log_rows
from brookmill.streaming import flows, metrics
from brookmill.verify import dead_letter_breakdown, maintain, register_views, reset, verify

RESOLVER = StaticResolver(SCHEMAS)


def _files(spark, folder, batches, schema):
    """One file for each batch, in order of time."""
    os.makedirs(folder)
    for k, rows in enumerate(batches):
        part = f"{folder}/../part{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        name = next(n for n in os.listdir(part) if n.endswith(".parquet"))
        target = f"{folder}/{k:03d}.parquet"
        os.rename(f"{part}/{name}", target)
        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))


def _run(df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp-{name}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


EVENT = "order_id string, customer_id string, zone string, restaurant_id string, status string, amount decimal(10,2), event_ts timestamp"


def _event(status, s, order_id="O1", zone="Z1"):
    from decimal import Decimal

    return (order_id, "C1", zone, "R1", status, Decimal("10.00"), BASE + timedelta(seconds=s))


def test_windows_drop_what_is_later_than_the_watermark(spark, tmp_path):
    batches = [[_event("PLACED", 0)], [_event("PLACED", 600)], [_event("PLACED", 1200)], [_event("PLACED", 1500)], [_event("PLACED", 5)], [_event("DELIVERED", 3000)]]
    _files(spark, f"{tmp_path}/in", batches, EVENT)
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = _run(windows.zone_metrics(source, "2 minutes"), "zones", tmp_path)
    rows = spark.table("zones").orderBy("window_start").collect()
    assert rows[0]["orders_placed"] == 1 and str(rows[0]["gmv"]) == "10.00"
    import json

    assert sum(metrics.summarise(json.loads(p.json))["rows_dropped_by_watermark"] for p in query.recentProgress) == 1


def test_sla_timers_fire_on_streams(spark, tmp_path):
    batches = [[_event("PLACED", 0), _event("PLACED", 0, "O2")], [_event("DELIVERED", 60, "O2")], [_event("PLACED", 900, "O3")], [_event("PLACED", 905, "O6")], [_event("PLACED", 910, "O7")], [_event("DELIVERED", 920)], [_event("PLACED", 2400, "O4")], [_event("PLACED", 2500, "O5")]]
    _files(spark, f"{tmp_path}/in", batches, EVENT)
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    _run(sla.sla_alerts(source, 240, 900, "5 minutes"), "alerts", tmp_path)
    got = {(r["order_id"], r["alert_type"]) for r in spark.table("alerts").collect()}
    assert ("O1", "SLA_BREACH") in got and ("O1", "DELIVERED_AFTER_BREACH") in got
    assert not any(o == "O2" for o, _ in got)


def test_repeats_within_the_watermark(spark, tmp_path):
    schema = "event_id string, event_ts timestamp"
    batches = [[("a", BASE), ("a", BASE)], [("a", BASE), ("b", BASE + timedelta(seconds=5))]]
    _files(spark, f"{tmp_path}/in", batches, schema)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    _run(dedup.within_watermark(source, ["event_id"], "event_ts", "10 minutes"), "unique_ids", tmp_path)
    assert sorted(r["event_id"] for r in spark.table("unique_ids").collect()) == ["a", "b"]


def test_order_batches_are_idempotent_and_move_forward(spark, tmp_path):
    s = Settings(lake_root=str(tmp_path))
    tables = flows.ensure_silver(spark, s)
    run = lambda values, n: flows.order_batch(bronze(spark, values), n, tables=tables, resolver=RESOLVER, skew_seconds=300)
    first = [order("E1", "O1", "DELIVERED", 120), order("E1", "O1", "DELIVERED", 120), order("E3", "O1", "TELEPORTED"), b"garbage"]
    assert run(first, 0) == {"valid": 2, "invalid": 2}
    run(first, 0)
    run([order("E1", "O1", "DELIVERED", 120), order("E4", "O1", "PICKED_UP", 60), order("E5", "O1", "PLACED", 0, version=2, payment_method="CARD")], 1)
    assert tables["order_events"].read().count() == 3
    assert tables["dead_letter"].read().count() == 2
    row = tables["orders_current"].read().first()
    assert (row["status"], row["status_rank"], row["payment_method"]) == ("DELIVERED", 4, "CARD")
    assert row["placed_ts"] is not None and row["last_event_ts"] > row["placed_ts"]


def _read_feed(spark, feed, schema, tmp_path, name):
    """Adds what a stream over the feed hasn't seen yet."""
    source = spark.readStream.schema(schema).parquet(f"{feed}/batch=*")
    source.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp-{name}").option("path", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(schema).parquet(f"{tmp_path}/{name}")


def test_feeds_carry_each_event_once(spark, tmp_path, monkeypatch):
    s = Settings(lake_root=str(tmp_path / "lake"))
    tables = flows.ensure_silver(spark, s)
    feed, orders = f"{tmp_path}/clicks_changes", f"{tmp_path}/orders_changes"
    row = {f.name: None for f in schemas.CLICKS.fields} | {"event_id": "E1", "event_ts": BASE, "event_date": BASE.date()}
    batch = spark.createDataFrame([tuple(row[n] for n in schemas.CLICKS.names)], schemas.CLICKS)
    values = [order("E1", "O1", "PLACED"), order("E2", "O1", "ACCEPTED", 30)]
    run = lambda: flows.order_batch(bronze(spark, values), 0, tables=tables, resolver=RESOLVER, skew_seconds=300, changes=orders)
    with monkeypatch.context() as m:  # ended when files are written, but not published
        m.setattr(flows.Folder, "publish", lambda self, df, name: df.write.parquet(f"{self.root}/.{name}.lost") or (_ for _ in ()).throw(RuntimeError("lost")))
        for again in (lambda: flows.click_batch(batch, 0, table=tables["clickstream"], changes=feed), run):
            with pytest.raises(RuntimeError):
                again()
    for _ in range(2):
        flows.click_batch(batch, 0, table=tables["clickstream"], changes=feed)
        run()
        assert _read_feed(spark, feed, schemas.CLICKS, tmp_path, "seen_clicks").count() == 1 == tables["clickstream"].read().count()
        assert _read_feed(spark, orders, schemas.ORDER_EVENTS, tmp_path, "seen_orders").count() == 2 == tables["order_events"].read().count()


def test_unknown_schema_ids_are_dead_letters_however_many(spark, tmp_path):
    s = Settings(lake_root=str(tmp_path))
    tables = flows.ensure_silver(spark, s)
    values = [b"\x00" + (1_000 + k).to_bytes(4, "big") + b"body" for k in range(20_000)] + [order("E1", "O1", "PLACED")]
    got = flows.order_batch(bronze(spark, values), 0, tables=tables, resolver=RESOLVER, skew_seconds=300)
    assert got == {"valid": 1, "invalid": 20_000} and tables["dead_letter"].read().count() == 20_000


def test_crash_between_commits(spark, tmp_path, monkeypatch):
    s = Settings(lake_root=str(tmp_path))
    tables = flows.ensure_silver(spark, s)
    values = [order("E1", "O1", "PLACED"), b"garbage"]
    for broken in ("order_events", "orders_current"):
        method = {"order_events": "merge_insert_only", "orders_current": "upsert"}[broken]
        with monkeypatch.context() as m:
            m.setattr(tables[broken], method, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                flows.order_batch(bronze(spark, values), 0, tables=tables, resolver=RESOLVER, skew_seconds=300)
    flows.order_batch(bronze(spark, values), 0, tables=tables, resolver=RESOLVER, skew_seconds=300)
    assert [tables[t].read().count() for t in ("dead_letter", "order_events", "orders_current")] == [1, 1, 1]


def test_lake_end_to_end_and_reconciled(spark, tmp_path):
    from brookmill.functions.avro import EPOCH

    s = Settings(lake_root=str(tmp_path / "lake"), watermark_delay="5 seconds")
    rows, manifest = log_rows(7, 1_768_471_200_000, 400, Rates(sessions_per_second=1.0), Faults(0.05, 0.05, 0.05), switch_after=60)
    rows = [(t, p, o, EPOCH + timedelta(milliseconds=ms), k, v) for t, p, o, ms, k, v in rows]
    half = len(rows) // 2
    _files(spark, f"{tmp_path}/all", [rows[:half], rows[half:]], flows.LOG)
    os.makedirs(f"{tmp_path}/log")
    listener = metrics.register(spark, s.paths.metrics)
    for name in ("000.parquet", "001.parquet"):
        os.rename(f"{tmp_path}/all/{name}", f"{tmp_path}/log/{name}")
        flows.start_bronze(flows.file_log(spark, f"{tmp_path}/log", 1), s, once=True).awaitTermination(120)
        for query in flows.start_silver(spark, s, RESOLVER, once=True):
            query.awaitTermination(240)
        for query in flows.start_gold(spark, s, once=True):
            query.awaitTermination(240)
    checks = verify(spark, s, manifest).collect()
    assert all(r["ok"] for r in checks), [tuple(r) for r in checks]
    assert set(register_views(spark, s)) >= {"events_raw", "order_events", "orders_current", "clickstream", "dead_letter"}
    assert spark.sql("select sum(orders_placed) from zone_metrics_1m").first()[0] is not None
    t = spark.table
    totals = panels.kpis(t("zone_metrics_1m"), t("sla_alerts"), t("checkout_conversion"), t("order_events")).first()
    assert totals["orders"] > 0 and 0 <= totals["conversion_rate"] <= 1 and totals["p95_latency_seconds"] is not None
    assert panels.per_minute(t("zone_metrics_1m")).count() and panels.per_zone(t("zone_metrics_1m")).count()
    assert panels.statuses(t("orders_current")).count() and panels.dead_letters(t("dead_letter")).count()
    assert panels.longest_open(t("sla_alerts")).count() <= 15
    assert panels.since(t("order_events"), "event_ts", 15).count() == 0
    assert dead_letter_breakdown(spark.table("dead_letter")).count() > 1
    assert all(r["after"] <= r["before"] for r in maintain(spark, s).collect())
    assert all(r["ok"] for r in verify(spark, s, manifest).collect())
    time.sleep(1)
    spark.streams.removeListener(listener)
    assert metrics.recent(spark, s.paths.metrics).where("query = 'silver_orders'").count() >= 1
    health = panels.stream_health(metrics.recent(spark, s.paths.metrics), ("silver", "gold")).collect()
    assert len({r["query"] for r in health}) == len(health) >= 5
    assert reset(s, ["silver"]) and "order_events" not in register_views(spark, s)


def test_eventlog_source(spark):
    from brookmill.sources.eventlog import EventLog

    spark.dataSource.register(EventLog)
    rows = spark.read.format("eventlog").option("seconds", 20).option("rate", 2).load()
    assert rows.columns == [c.split()[0] for c in flows.LOG.split(", ")] and rows.count() > 20
    assert schemas.ORDER_TOPIC in {r["topic"] for r in rows.select("topic").distinct().collect()} or rows.count()
