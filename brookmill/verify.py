"""Reconciliation of the lake with what was sent, resetting of layers, upkeep, and an SQL shell."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.config import LAYERS, Settings
from brookmill.store import TableStore

#: Columns that tables are clustered by.
CLUSTER = {"order_events": ["zone", "order_id"], "clickstream": ["customer_id"]}


def verify(spark: SparkSession, s: Settings, manifest: dict) -> DataFrame:
    """Seven checks against the manifest of the sender: check, ok, detail."""
    table = lambda t: TableStore(spark, s.paths.table(t)).read()
    events, clicks, current, dead = (table(t) for t in ("order_events", "clickstream", "orders_current", "dead_letter"))
    n_events, n_ids = events.agg(F.count("*"), F.countDistinct("event_id")).first()
    n_clicks, click_ids = clicks.agg(F.count("*"), F.countDistinct("event_id")).first()
    dead_by = {r["source_topic"]: r["count"] for r in dead.groupBy("source_topic").count().collect()}
    furthest = events.groupBy("order_id").agg(F.max("status_rank").alias("most"))
    behind = furthest.join(current.select("order_id", "status_rank"), "order_id", "left").where(F.col("status_rank").isNull() | (F.col("status_rank") < F.col("most"))).count()
    rows = [
        ("order events are unique", n_events == n_ids, f"{n_events} rows, {n_ids} ids"),
        ("order events are complete", n_ids == manifest["unique_orders_events"], f"{n_ids} of {manifest['unique_orders_events']}"),
        ("clicks are unique", n_clicks == click_ids, f"{n_clicks} rows, {click_ids} ids"),
        ("clicks are complete", click_ids == manifest["unique_clicks"], f"{click_ids} of {manifest['unique_clicks']}"),
        ("bad orders are dead letters", dead_by.get(s.order_topic, 0) == manifest["malformed_orders"], f"{dead_by.get(s.order_topic, 0)} of {manifest['malformed_orders']}"),
        ("bad clicks are dead letters", dead_by.get(s.click_topic, 0) == manifest["malformed_clicks"], f"{dead_by.get(s.click_topic, 0)} of {manifest['malformed_clicks']}"),
        ("no order is missing or behind its events", behind == 0, f"{behind} orders"),
    ]
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def dead_letter_breakdown(dead: DataFrame) -> DataFrame:
    return dead.groupBy("source_topic", "primary_reason").count().orderBy("source_topic", F.desc("count"), "primary_reason")


def register_views(spark: SparkSession, s: Settings) -> list[str]:
    """Temporary views of all tables that exist, by name."""
    made = []
    for layer, names in LAYERS.items():
        for name in names:
            path = s.paths.table(name)
            if layer == "silver":
                store = TableStore(spark, path)
                if not store.exists():
                    continue
                df = store.read()
            elif Path(path.removeprefix("file://")).exists():
                df = spark.read.parquet(path)
            else:
                continue
            df.createOrReplaceTempView(name)
            made.append(name)
    return made


def q(spark: SparkSession, sql: str, n: int = 20) -> None:
    spark.sql(sql).show(n, truncate=False)


def maintain(spark: SparkSession, s: Settings, vacuum: bool = True, target_files: int | None = None) -> DataFrame:
    """Compacts and clusters the append-only silver tables and deletes what no version of the last week needs: table, before, after, deleted."""
    rows = []
    for name in LAYERS["silver"]:
        store = TableStore(spark, s.paths.table(name))
        if not store.exists():
            continue
        before = after = store.files()
        if name != "orders_current":  # every upsert rewrites its buckets
            before, after = store.compact(target_files, CLUSTER.get(name))
        rows.append((name, before, after, store.vacuum() if vacuum else 0))
    return spark.createDataFrame(rows, "table string, before int, after int, deleted int")


def reset(s: Settings, layers: list[str]) -> list[str]:
    """Deletes tables of the layers together with their checkpoints and metrics, for a replay. Silver takes gold with it. Local folders only."""
    wanted = set(layers) | ({"gold"} if "silver" in layers else set())
    root, gone = Path(s.lake_root), []
    for layer in sorted(wanted):
        for path in [root / "lake" / layer, *root.glob(f"checkpoints/{layer}_*"), *root.glob(f"metrics/{layer}_*.jsonl")]:
            if path.is_dir():
                shutil.rmtree(path)
            elif path.exists():
                path.unlink()
            else:
                continue
            gone.append(str(path))
    return gone
