"""Jobs from the command line: python -m brookmill {bronze,silver,gold,simulate,verify,maintain,reset,compat,sql} ..."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import timedelta
from pathlib import Path

from brookmill import verify as checks
from brookmill.config import Settings
from brookmill.functions.avro import EPOCH
from brookmill.session import build_session
from brookmill.sources.registry import FolderResolver, RegistryResolver, StaticResolver, breaks
from brookmill.sources.simulate import SCHEMAS, Faults, Rates, log_rows, merged
from brookmill.streaming import flows, metrics


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="brookmill")
    jobs = top.add_subparsers(dest="job", required=True)
    bronze = jobs.add_parser("bronze", help="log to bronze")
    bronze.add_argument("--log", help="folder of log files; Kafka without it")
    for name in ("silver", "gold"):
        jobs.add_parser(name)
    for name in ("bronze", "silver", "gold"):
        jobs.choices[name].add_argument("--once", action="store_true", help="catch up and stop")
    jobs.choices["silver"].add_argument("--schemas", help="folder of {id}.avsc")
    simulate = jobs.add_parser("simulate", help="write a simulated log and add its counts to a manifest")
    simulate.add_argument("folder")
    simulate.add_argument("--seed", type=int, default=1)
    simulate.add_argument("--seconds", type=int, default=300)
    simulate.add_argument("--rate", type=float, default=5.0)
    simulate.add_argument("--clean", action="store_true", help="without faults")
    jobs.add_parser("verify").add_argument("manifest")
    jobs.add_parser("maintain").add_argument("--no-vacuum", action="store_true")
    jobs.add_parser("reset").add_argument("layers", nargs="+", choices=["bronze", "silver", "gold"])
    compat = jobs.add_parser("compat", help="can the new schema read data of the old one?")
    compat.add_argument("new")
    compat.add_argument("old")
    jobs.add_parser("sql").add_argument("statement")
    return top


def main(argv: list[str] | None = None) -> int:
    a, s = parser().parse_args(argv), Settings.from_env()
    if a.job == "compat":
        found = breaks(*(json.loads(Path(p).read_text()) for p in (a.new, a.old)))
        print("\n".join(found) or "compatible")
        return int(bool(found))
    if a.job == "reset":
        print("\n".join(checks.reset(s, a.layers)))
        return 0
    spark = build_session(f"brookmill-{a.job}")
    if a.job == "simulate":
        rows, counts = log_rows(a.seed, 1_768_471_200_000, a.seconds, Rates(sessions_per_second=a.rate), None if a.clean else Faults(seed=a.seed))
        spark.createDataFrame([(t, p, o, EPOCH + timedelta(milliseconds=ms), k, v) for t, p, o, ms, k, v in rows], flows.LOG).write.mode("append").parquet(a.folder)
        manifest = Path(s.lake_root) / "manifest.json"
        manifest.parent.mkdir(parents=True, exist_ok=True)
        manifest.write_text(json.dumps(merged(json.loads(manifest.read_text()) if manifest.exists() else {}, counts)))
        return 0
    if a.job == "verify":
        rows = checks.verify(spark, s, json.loads(Path(a.manifest).read_text())).collect()
        print("\n".join(f"{'ok  ' if r['ok'] else 'FAIL'} {r['check']}: {r['detail']}" for r in rows))
        return int(not all(r["ok"] for r in rows))
    if a.job == "maintain":
        checks.maintain(spark, s, vacuum=not a.no_vacuum).show(truncate=False)
        return 0
    if a.job == "sql":
        checks.register_views(spark, s)
        checks.q(spark, a.statement)
        return 0
    metrics.register(spark, s.paths.metrics)
    if a.job == "bronze":
        running = [flows.start_bronze(flows.file_log(spark, a.log, s.max_files_per_trigger) if a.log else flows.kafka_log(spark, s), s, a.once)]
    elif a.job == "silver":
        resolver = FolderResolver(a.schemas) if a.schemas else RegistryResolver(s.schema_registry_url) if s.schema_registry_url else StaticResolver(SCHEMAS)
        running = flows.start_silver(spark, s, resolver, a.once)
    else:
        running = flows.start_gold(spark, s, a.once)
    if a.once:
        for query in running:
            query.awaitTermination()
        return 0
    return flows.supervise(spark)


if __name__ == "__main__":
    sys.exit(main())
