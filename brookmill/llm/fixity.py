"""Merkle fixity audit of WARC replicas.

Records of an archive file lie at ascending offsets. Each is hashed; hashes are gathered into a tree over fixed, aligned
ranges of offsets: the lowest nodes cover LEAF_BYTES of the file each, every higher one FANOUT nodes, up to one root for
each file. A node's hash covers its children's places and hashes in order. Two replicas are compared from the roots
down, and only the children of nodes that differ are looked at in the next level; below the lowest differing ranges the
records themselves are compared: damaged, missing, or added.

With DataFrame functions only. A range has a bounded number of children, so a file that holds a third of all bytes is
many groups, not one.

Defined cases: null fields of a page count as empty; a null page_id goes to file -1; rows that repeat a page are records
each; other columns are not read; empty replicas have no roots, and files on one side only differ at their root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookmill.llm.common import durable

LEAF_BYTES, FANOUT = 1 << 16, 16
RECORDS_PER_FILE = 1_000


def warc_record(url: Column, payload: Column) -> Column:
    """Bytes of one response record: header block, blank line, payload, two line ends."""
    size = F.octet_length(payload).cast("string")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size,
        F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def archived(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Pages as WARC records: page_id, file, offset, length, digest (of the record's bytes). Files take ranges of ids."""
    return _placed(_hashed(pages, id_col, url_col, body_col, per_file)).select("page_id", "file", "offset", "length", "digest")


def _hashed(pages: DataFrame, id_col: str, url_col: str, body_col: str, per_file: int) -> DataFrame:
    """page_id, file, url, record, length, digest."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    page_id = F.col(id_col).cast("long")
    file = F.coalesce(F.floor(page_id / per_file), F.lit(-1)).cast("long")
    rows = pages.select(page_id.alias("page_id"), file.alias("file"), text(url_col).alias("url"), warc_record(text(url_col), text(body_col)).alias("record"))
    return rows.withColumns({"length": F.octet_length("record").cast("long"), "digest": F.sha2("record", 256)})


def _placed(hashed: DataFrame) -> DataFrame:
    """With the offset of each record: the lengths of those before it in its file."""
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def _above(level: DataFrame, place: Column) -> DataFrame:
    """Nodes over the rows (file, place, hash) of one level."""
    child = F.concat_ws(":", F.col("place").cast("string"), "hash")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", child.alias("c")))), lambda s: s["c"]), ",")
    return level.groupBy("file", place.alias("up")).agg(F.sha2(joined, 256).alias("hash")).select("file", F.col("up").alias("place"), "hash")


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """Levels of nodes (file, place, hash), from ranges of LEAF_BYTES to roots. A record belongs to the range that it begins in."""
    leaves = records.select("file", F.col("offset").alias("place"), F.concat_ws("/", F.col("length").cast("string"), "digest").alias("hash"))
    levels = [durable(_above(leaves, F.floor(F.col("place") / LEAF_BYTES).cast("long")))]
    for _ in range(height):
        levels.append(durable(_above(levels[-1], F.floor(F.col("place") / FANOUT).cast("long"))))
    return levels


def height_for(*replicas: DataFrame) -> int:
    """Levels above the lowest ranges until one node covers the longest file."""
    most = max((r.agg(F.max("offset")).first()[0] or 0) for r in replicas)
    nodes, height = most // LEAF_BYTES + 1, 0
    while nodes > 1:
        nodes, height = -(-nodes // FANOUT), height + 1
    return height


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.withColumnRenamed("hash", "a"), b.withColumnRenamed("hash", "b")
    return x.join(y, ["file", "place"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "place")


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that differ between two replicas (columns file, offset, length, digest): file, offset, status, digest_a, digest_b."""
    height = height_for(a, b)
    ours, theirs = tree(a, height), tree(b, height)
    wrong = _differing(ours[height], theirs[height])
    for k in range(height - 1, -1, -1):
        parent = F.floor(F.col("place") / FANOUT).cast("long").alias("up")
        open_ = wrong.select("file", F.col("place").alias("up"))
        below = [t[k].select("*", parent).join(open_, ["file", "up"], "left_semi").select("file", "place", "hash") for t in (ours, theirs)]
        wrong = _differing(*below)
    ranges = durable(wrong.select("file", F.col("place").alias("range")))
    inside = [r.withColumn("range", F.floor(F.col("offset") / LEAF_BYTES).cast("long")).join(ranges, ["file", "range"], "left_semi").groupBy("file", "offset", "length", "digest").agg(F.count("*").alias(f"n_{s}")) for r, s in ((a, "a"), (b, "b"))]
    x = inside[0].select("file", "offset", F.concat_ws("/", F.col("length").cast("string"), "digest").alias("digest_a"))
    y = inside[1].select("file", "offset", F.concat_ws("/", F.col("length").cast("string"), "digest").alias("digest_b"))
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "added").otherwise("damaged")
    both = x.join(y, ["file", "offset"], "full_outer").where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
    return both.select("file", "offset", status.alias("status"), F.substring_index("digest_a", "/", -1).alias("digest_a"), F.substring_index("digest_b", "/", -1).alias("digest_b"))


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of the first replica with its verdict: page_id, file, offset, length, digest, status."""
    found = mismatches(records, replica).where("status != 'added'").select("file", "offset", F.col("status").alias("_status"))
    return records.join(found, ["file", "offset"], "left").select("page_id", "file", "offset", "length", "digest", F.coalesce("_status", F.lit("intact")).alias("status"))


def damaged_copy(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """A replica as a faulty store might return it, for drills: of about 32 records (by the digest of the address) one has a byte changed and one is lost.

    The byte after the record's version line is changed in the record itself, which is then hashed like any other; offsets
    and lengths are those of the undamaged file.
    """
    mark = F.substring(F.sha2("url", 256), 1, 2)
    flipped = F.sha2(F.overlay(F.col("record"), F.lit("w"), F.lit(11)), 256)
    flaws = _hashed(pages, id_col, url_col, body_col, per_file).withColumns({"mark": mark, "found": F.when(mark.between("00", "07"), flipped).otherwise(F.col("digest"))})
    return _placed(flaws).where(~F.col("mark").between("08", "0f")).select("page_id", "file", "offset", "length", F.col("found").alias("digest"))
