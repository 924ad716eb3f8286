"""Exact de-duplication by content sort.

Normalised bytes are range-partitioned by splitters that Spark samples, sorted (externally, spilling to disk), and
neighbours are compared in full, so that equals, which now stand side by side, form a group. Before the shuffle every
Arrow batch keeps one row of each text, with the count and the best id of its copies: a text that fills a third of the
corpus reaches the sort as one row for each batch, not for each document.

Defined cases: a null text counts as empty and is equal to the empty text; case is folded for A-Z only; null ids lose
against any other and stay only where a group has no id at all; rows that repeat both id and text are one document to
`decide` (all of them carry its verdict), while `survivors` keeps exactly one row of each group; other columns, whatever
their names, pass through `survivors` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of one text in a batch from which they are dealt to SALTS tasks; only texts with as many copies have a row for each.
MANY, SALTS = 256, 64


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _better(a, b, largest: bool) -> bool:
    """Is id a to be kept rather than id b?"""
    if a is None or b is None:
        return b is None and a is not None
    return a > b if largest else a < b


def _combine(largest: bool):
    """One row for each text of a batch: its bytes, number of copies and the id to keep."""
    schema = pa.schema([("norm", pa.binary()), ("id", pa.int64()), ("copies", pa.int64())])

    def run(batches):
        for batch in batches:
            best: dict[bytes, list] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = best.setdefault(normalise(text), [doc_id, 0])
                got[1] += 1
                if _better(doc_id, got[0], largest):
                    got[0] = doc_id
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(best), pa.binary()), pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.int64())],
                schema=schema,
            )

    return run


def _neighbours(largest: bool):
    """Groups of adjacent equal bytes of a sorted partition: digest, id to keep, number of rows."""
    schema = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def run(batches):
        held = None
        for batch in batches:
            out: list[tuple] = []
            for norm, doc_id, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held is not None and held[0] == norm:
                    held[2] += copies
                    if _better(doc_id, held[1], largest):
                        held[1] = doc_id
                    continue
                if held is not None:
                    out.append((hashlib.sha256(held[0]).hexdigest(), held[1], held[2]))
                held = [norm, doc_id, copies]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(held[0]).hexdigest()]), pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int64())], schema=schema)

    return run


def _members(batches):
    """Ids by text, one row for each text of a batch; where there are many, salted by batch and their first id."""
    schema = pa.schema([("sha", pa.string()), ("ids", pa.list_(pa.int64())), ("salt", pa.int32())])
    for k, batch in enumerate(batches):
        ids: dict[str, list] = {}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.setdefault(hashlib.sha256(normalise(text)).hexdigest(), []).append(doc_id)
        salts = [(k + hash(v[0])) % SALTS if len(v) >= MANY else 0 for v in ids.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(list(ids.values()), pa.list_(pa.int64())), pa.array(salts, pa.int32())], schema=schema)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sorted(texts: DataFrame, partitions: int) -> DataFrame:
    """Range-partitioned by the first bytes and a hash of the whole, sorted by all bytes in each partition.

    The hash parts texts that begin alike, and keeps the sampled splitters, which pass through the driver, a few bytes each.
    """
    ranged = texts.repartitionByRange(partitions, F.substring(F.col("norm"), 1, 16), F.xxhash64("norm"))
    return ranged.sortWithinPartitions("norm")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row for each distinct text: sha (of the normalised bytes), keep_id, group_size."""
    largest = keep == "largest"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.mapInArrow(_combine(largest), "norm binary, id long, copies long")
    ordered = _sorted(texts, _partitions(docs))
    return ordered.mapInArrow(_neighbours(largest), "sha string, keep_id long, group_size long")


def decide(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Verdicts reach the ids by digest and salt, so that the ids of a text with very many copies go to many tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    members = rows.mapInArrow(_members, "sha string, ids array<long>, salt int")
    found = groups(docs, id_col=id_col, text_col=text_col, keep=keep)
    salts = F.when(F.col("group_size") >= MANY, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = found.withColumn("salt", F.explode(salts))
    return (
        members.join(found, ["sha", "salt"])
        .select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", F.col("sha").alias("text_sha256"))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with the columns of docs.

    Whole rows travel with their bytes through the one range shuffle, so nothing is joined back by id.
    """
    largest, names = keep == "largest", docs.columns
    key_at, text_at = names.index(id_col), names.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    fields = [T.StructField("norm", T.BinaryType())] + list(plain.schema.fields)
    schema = T.StructType(fields)

    def first_pass(batches):
        for batch in batches:
            ids, texts = batch.column(key_at).to_pylist(), batch.column(text_at).to_pylist()
            at: dict[bytes, int] = {}
            for i, text in enumerate(texts):
                norm = normalise(text)
                if norm not in at or _better(ids[i], ids[at[norm]], largest):
                    at[norm] = i
            kept = batch.take(pa.array(list(at.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.binary()), *kept.columns], names=[f.name for f in fields])

    def second_pass(batches):
        held = None  # bytes, id, one-row batch
        for batch in batches:
            norms, ids = batch.column(0).to_pylist(), batch.column(1 + key_at).to_pylist()
            ready, here = [], []
            best = None  # row of this batch that stands for the group now open
            for i, norm in enumerate(norms):
                if held is not None and held[0] == norm:
                    if _better(ids[i], held[1], largest):
                        held, best = (norm, ids[i], None), i
                    continue
                if held is not None:
                    ready.append(held[2]) if best is None else here.append(best)
                held, best = (norm, ids[i], None), i
            if best is not None:
                held = (held[0], held[1], batch.slice(best, 1).select(list(range(1, len(fields)))))
            yield from ready
            if here:
                yield batch.take(pa.array(here, pa.int64())).select(list(range(1, len(fields))))
        if held is not None:
            yield held[2]

    texts = _sorted(plain.mapInArrow(first_pass, schema), _partitions(docs))
    return texts.mapInArrow(second_pass, plain.schema).toDF(*names)
