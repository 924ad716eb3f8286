"""What several corpus operators share: reading, durable intermediate tables, bounded collection."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.session import ship


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(sc, "_brookmill_shared", None)
        if root is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = sc._brookmill_shared = "file://" + tempfile.mkdtemp(prefix="brookmill-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df as files in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that is small by construction; more than `most` of them is an error, never a cut."""
    rows = df.limit(most + 1).coalesce(1).collect()  # all partitions at once, unlike a bare limit
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; raise the documented bound if that is meant")
    return rows


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows to a table of one row a key, whose column n (dropped) counts the rows of that key; total: at least the sum of n.

    Keys of more than a quarter of an even partition's rows, of which there are at most four for each shuffle partition,
    are broadcast; the rows of all others are shuffled. So no task gets much more than its share, whatever a key holds.
    """
    most = total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = [c for c in table.columns if c not in (key, "n")]
    hot = table.where(F.col("n") > most).select(key, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    at_once = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in values])
    shuffled = marked.where("_hot is null").drop("_hot").join(table.where(F.col("n") <= most).drop("n"), key)
    return at_once.unionByName(shuffled.select(*rows.columns, *values))


def in_slices(batches, rows: int = 512):
    """Arrow batches in parts of so many rows, so that what a function makes of one stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def lean(run):
    """A function on batches that, when done, returns free memory to the system: its worker stays, idle, beside later stages."""

    def done(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # C libraries without it
            ctypes.CDLL(None).malloc_trim(0)

    return done


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the undirected links a[i]-b[i]."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        lo, hi = np.minimum(la, lb), np.maximum(la, lb)
        open_ = lo != hi
        if not open_.any():
            break
        np.minimum.at(label, hi[open_], lo[open_])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        a, b = a[open_], b[open_]
    return label


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column of x is constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)) / 10
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(y) / 10 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w
