"""Sessions, and the package's own code on every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What stateful streams need besides Spark's defaults.
STREAMING = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str, *, master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with the RocksDB state store. Environment: SPARK_MASTER, SHUFFLE_PARTITIONS, SPARK_DRIVER_MEMORY, SPARK_LOG_LEVEL."""
    builder = SparkSession.builder.appName(app_name)
    if master or os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or os.environ.get("SHUFFLE_PARTITIONS", "200")),
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "4g"),
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | STREAMING | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("SPARK_LOG_LEVEL", "WARN"))
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python functions find it there."""
    sc = spark.sparkContext
    if getattr(sc, "_brookmill_shipped", False):
        return
    top = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="brookmill-code-")) / "brookmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(target))
    sc._brookmill_shipped = True
