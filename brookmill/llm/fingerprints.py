"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A text is the multiset of its paragraphs: pieces that end with a line break or, within a line, with the blank after a
full stop, exclamation or question mark (nothing is lost: the pieces joined are the text). Every paragraph is hashed to a
wide vector, and a document's fingerprint is the sum of the vectors of its paragraphs, lane by lane, modulo a power of
two. So order doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its vector: `add` and
`subtract` do that for fingerprints alone. The vector has three parts:

* 8 lanes modulo 2^32 hashed uniformly: equal multisets, and in practice only those, agree in all of them;
* 63 lanes modulo 2^20 hashed to 0 or 1: with n paragraphs, 2 * lane - n is a sum of random signs, so the mean square
  over lanes estimates the number of paragraphs (by squared multiplicity), and that of a difference of two fingerprints
  estimates in how many they differ: likeness = 1 - |a - b|^2 / (|a|^2 + |b|^2), cut to 0..1;
* the number of paragraphs modulo 2^32.

Fingerprints of one length for any text; no shuffle. Neighbours by id take one shuffle of the texts, which an edited text
needs whole, to ranges that are as many as four times the shuffle partitions.

Defined cases: a null text counts as empty and has one empty paragraph; rows that repeat an id are ordered by a hash of the
text, then by the text, and a much repeated id is split among ranges by that hash (rows equal in both share a task); where a
sum of signs passes 524,287 (one paragraph that often in a text), likeness is wrong and equality still right; null ids come first; other columns are not read; an empty table gives no rows; a single row is its own next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookmill.llm.common import bounded

WIDE, SIGNS = 8, 63
#: Three 20-bit fields, 21 bits apart, in one long: fields never carry into each other.
PART, HALF = (1 << 20) - 1, 1 << 19
FIELD = PART | PART << 21 | PART << 42
ONES = 1 | 1 << 21 | 1 << 42
LOW = 0xFFFFFFFF
BREAK = r"(?<=[\n ])(?<=\n|[.!?] )(?!\z)"
#: Ranges for each shuffle partition, and rows looked at for each range to place them.
RANGES, LOOKED_AT = 4, 32
LEAST = -(1 << 63)


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def paragraphs(text: Column) -> Column:
    return F.split(text, BREAK)


def hashes(parts: Column) -> Column:
    """Five 64-bit hashes of each paragraph."""
    return F.transform(parts, lambda p: F.array(*[F.xxhash64(F.lit(k), p) for k in range(5)]))


def lanes(hashed: Column) -> Column:
    """Lanes of a document in one walk over its hashes: 8 wide ones, 21 longs of three sign lanes each, number of paragraphs."""

    def half(h: Column, k: int) -> Column:
        return (F.shiftrightunsigned(h[k // 2], 32) if k % 2 else h[k // 2]).bitwiseAND(_long(LOW))

    def step(acc: Column, h: Column) -> Column:
        wide = [(acc[k] + half(h, k)).bitwiseAND(_long(LOW)) for k in range(WIDE)]
        signs = [(acc[WIDE + i] + F.shiftrightunsigned(h[4], i).bitwiseAND(_long(ONES))).bitwiseAND(_long(FIELD)) for i in range(21)]
        return F.array(*wide, *signs, (acc[WIDE + 21] + 1).bitwiseAND(_long(LOW)))

    return F.aggregate(hashed, F.array(*[_long(0)] * (WIDE + 22)), step)


def _masks() -> Column:
    return F.array(*[_long(LOW)] * WIDE, *[_long(FIELD)] * 21, _long(LOW))


def _headroom() -> Column:
    """A multiple of each lane's modulus, so that a difference never goes below zero."""
    return F.array(*[_long(LOW + 1)] * WIDE, *[_long(1 << 20 | 1 << 41 | 1 << 62)] * 21, _long(LOW + 1))


def add(a: Column, b: Column) -> Column:
    """Lanes of the two multisets together."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), _masks(), lambda x, m: x.bitwiseAND(m))


def subtract(a: Column, b: Column) -> Column:
    """Lanes of multiset a without the paragraphs of b."""
    return F.zip_with(F.zip_with(F.zip_with(a, _headroom(), lambda x, r: x + r), b, lambda x, y: x - y), _masks(), lambda x, m: x.bitwiseAND(m))


def encoded(lane: Column) -> Column:
    """Lanes as a string of hexadecimal digits."""
    wide = [F.lpad(F.hex(lane[k]), 8, "0") for k in range(WIDE)]
    signs = [F.lpad(F.hex(lane[WIDE + k]), 16, "0") for k in range(21)]
    return F.lower(F.concat(*wide, *signs, F.lpad(F.hex(lane[WIDE + 21]), 8, "0")))


def _signs(lane: Column) -> Column:
    """The 63 sums of signs."""
    n = lane[WIDE + 21]
    packed = F.slice(lane, WIDE + 1, 21)
    return F.transform(
        F.flatten(F.transform(packed, lambda x: F.array(*[F.shiftrightunsigned(x, s).bitwiseAND(_long(PART)) for s in (0, 21, 42)]))),
        lambda v: F.pmod(2 * v - n + HALF, _long(2 * HALF)) - HALF,
    )


def _square(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0..1 from two arrays of lanes; 1 for equal multisets."""
    x, y = _signs(a), _signs(b)
    apart = _square(F.zip_with(x, y, lambda p, q: F.pmod(p - q + HALF, _long(2 * HALF)) - HALF))
    whole = _square(x) + _square(y)
    near = F.greatest(F.lit(0.0), F.lit(1.0) - apart / F.greatest(whole, F.lit(1.0)))
    equal = F.slice(a, 1, WIDE) == F.slice(b, 1, WIDE)
    # estimates of different texts stay below 1
    return F.when(equal, F.lit(1.0)).otherwise(F.least(near, F.lit(0.999)))


def fingerprinted(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with the lanes of a text column in `out`."""
    return df.withColumn("_hashes", hashes(paragraphs(text))).withColumn(out, lanes(F.col("_hashes"))).drop("_hashes")


def _longs(values: list[int]) -> Column:
    """One constant array, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _cuts(keyed: DataFrame, n: int) -> list[tuple[int, int]]:
    """Least (_key, _tie) of about n ranges of alike many rows, each a row of the table; the least row comes first.

    A sample of keys places them. _tie is LEAST, for all rows of the key, unless the key holds more than two ranges' rows.
    """
    total, least = keyed.agg(F.count("*"), F.min("_key")).first()
    if not total:
        return [(0, LEAST)]
    rate, most = min(1.0, LOOKED_AT * n / total), 4 * LOOKED_AT * n + 10_000
    sampled = lambda rows: rows if rate == 1.0 else rows.sample(rate, seed=5)
    keys = {r["_key"]: r["n"] for r in bounded(sampled(keyed.select("_key")).groupBy("_key").agg(F.count("*").alias("n")), most, "sampled ids")}
    keys.setdefault(least, 1)
    share = max(1.0, sum(keys.values()) / n)
    heavy = [k for k, c in keys.items() if c > max(2 * share, LOOKED_AT)]
    seen = [(k, LEAST, c) for k, c in keys.items() if k not in set(heavy)]
    if heavy:
        rows = keyed.where(F.col("_key").isin(heavy)).select("_key", "_tie")
        ties = {(r["_key"], r["_tie"]): r["n"] for r in bounded(sampled(rows).groupBy("_key", "_tie").agg(F.count("*").alias("n")), most, "sampled rows")}
        for r in bounded(rows.groupBy("_key").agg(F.min("_tie").alias("t")), most, "repeated ids"):
            ties.setdefault((r["_key"], r["t"]), 1)
        seen += [(k, t, c) for (k, t), c in ties.items()]
    cuts, held = [], share
    for k, t, c in sorted(seen):
        if held >= share:
            cuts.append((k, t))
            held = 0
        held += c
    return cuts


def with_next(df: DataFrame, key: str, tie: str, columns: dict[str, str]) -> DataFrame:
    """df with columns of the next row in ascending order of `key` (ties by a hash of `tie`, then by it); the first row follows the last.

    Rows are dealt to ranges of keys; a copy of the first row of each range goes to the range before as its last row, so
    each range finds its successors alone. Only sampled keys and the least row of each range reach the driver.
    """
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns({"_key": F.coalesce(F.col(key), _long(LEAST)), "_tie": F.xxhash64(tie)})
    cuts = _cuts(keyed.select("_key", "_tie"), n)
    keys, ties, last = _longs([k for k, _ in cuts]), _longs([t for _, t in cuts]), len(cuts)
    own_key, own_tie = F.col("_key"), F.col("_tie")

    def further(at: Column, step: Column) -> Column:
        k, t = F.try_element_at(keys, at + step), F.try_element_at(ties, at + step)
        return F.when((k < own_key) | ((k == own_key) & (t <= own_tie)), at + step).otherwise(at)

    steps = F.array(*[F.lit(1 << b) for b in reversed(range(last.bit_length()))])
    ranged = keyed.withColumn("_range", F.aggregate(steps, F.lit(0), further))
    at = F.col("_range")
    tie_of_cut = F.try_element_at(ties, at)
    leads = (F.try_element_at(keys, at) == own_key) & ((tie_of_cut == _long(LEAST)) | (tie_of_cut == own_tie))
    own = F.struct(at.alias("r"), F.lit(0).alias("g"))
    ghost = F.struct(F.when(at == 1, F.lit(last)).otherwise(at - 1).alias("r"), F.lit(1).alias("g"))
    dealt = ranged.withColumn("_at", F.explode(F.when(leads, F.array(own, ghost)).otherwise(F.array(own))))
    in_order = Window.partitionBy(F.col("_at.r")).orderBy(F.col("_at.g"), "_key", "_tie", tie)
    following = {out: F.lead(c).over(in_order) for c, out in columns.items()}
    return dealt.withColumns(following).where("_at.g = 0").drop("_at", "_key", "_tie", "_range")


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `lanes` and `fingerprint`, one row for each document."""
    return fingerprinted(docs, F.coalesce(F.col(text_col).cast("string"), F.lit("")), "lanes").withColumn("fingerprint", encoded(F.col("lanes")))


def edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    The edited text: the last quarter of the code points gives way to as many from the start of the next document.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = fingerprinted(rows, F.col("text"), "lanes")
    paired = with_next(marked, "doc_id", "text", {"text": "next_text", "lanes": "next_lanes"})
    n = F.char_length("text").cast("long")
    quarter = F.floor(n / 4).cast("int")
    changed = F.concat(F.substring(F.col("text"), F.lit(1), (n - quarter).cast("int")), F.substring(F.col("next_text"), F.lit(1), quarter))
    both = fingerprinted(paired.select("doc_id", "lanes", "next_lanes", n.alias("n_chars"), changed.alias("edited")), F.col("edited"), "edited_lanes")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        encoded(F.col("lanes")).alias("fingerprint"),
        encoded(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )


def combine(lanes_by_group: DataFrame, group_col: str, lane_col: str = "lanes") -> DataFrame:
    """Fingerprint of the documents of each group taken together, by plain sums with map-side combination."""
    size = WIDE + 22
    sums = lanes_by_group.groupBy(group_col).agg(*[F.sum(F.col(lane_col)[k].bitwiseAND(_long(LOW))).alias(f"w{k}") for k in range(WIDE)], *[F.sum(F.shiftrightunsigned(F.col(lane_col)[WIDE + k], s).bitwiseAND(_long(PART))).alias(f"s{k}_{s}") for k in range(21) for s in (0, 21, 42)], F.sum(F.col(lane_col)[size - 1]).alias("n"))
    packed = [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.col(f"s{k}_{s}").bitwiseAND(_long(PART)), s) for s in (0, 21, 42)]) for k in range(21)]
    out = F.array(*[F.col(f"w{k}").bitwiseAND(_long(LOW)) for k in range(WIDE)], *packed, F.col("n").bitwiseAND(_long(LOW)))
    return sums.select(group_col, out.alias(lane_col))
