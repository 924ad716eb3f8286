"""Settings, each overridable by an environment variable of the same name in capitals, and the folder layout."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

LAYERS = {
    "bronze": ("events_raw",),
    "silver": ("order_events", "orders_current", "clickstream", "dead_letter"),
    "gold": ("zone_metrics_1m", "sla_alerts", "checkout_conversion", "user_sessions"),
}


@dataclass(frozen=True)
class Paths:
    root: str

    def table(self, name: str) -> str:
        layer = next(k for k, names in LAYERS.items() if name in names)
        return f"{self.root}/lake/{layer}/{name}"

    def checkpoint(self, query: str) -> str:
        return f"{self.root}/checkpoints/{query}"

    @property
    def metrics(self) -> str:
        return f"{self.root}/metrics"


@dataclass(frozen=True)
class Settings:
    lake_root: str = "data"
    order_topic: str = "order_events"
    click_topic: str = "clickstream"
    kafka_bootstrap: str = ""
    schema_registry_url: str = ""
    trigger_interval: str = "10 seconds"
    starting_offsets: str = "earliest"
    max_offsets_per_trigger: int = 50_000
    max_files_per_trigger: int = 200
    watermark_delay: str = "2 minutes"
    alert_watermark_delay: str = "5 minutes"
    clickstream_dedup_window: str = "10 minutes"
    order_sla_seconds: int = 240
    order_state_ttl_seconds: int = 900
    session_gap_seconds: int = 180
    checkout_to_order_seconds: int = 300
    max_future_skew_seconds: int = 300

    @classmethod
    def from_env(cls, **given) -> Settings:
        out = {}
        for f in fields(cls):
            raw = os.environ.get(f.name.upper())
            if raw is not None:
                out[f.name] = int(raw) if isinstance(f.default, int) else raw
        return cls(**(out | given))

    @property
    def paths(self) -> Paths:
        return Paths(self.lake_root)
