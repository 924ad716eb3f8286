"""Near-duplicates by the Jaccard similarity of word shingles: the wide form of the SimHash operator.

Two texts are linked if the sets of their shingles (runs of `width` lower-cased words, as 64-bit hashes) have a Jaccard
similarity of `least` or more; a class is everything that can be reached over links, and one row of each class stays.

Texts of equal sets are one node, named by a row that has it. Candidates are the links of the SimHash tries (fingerprints within 3 bits) and, as a
similarity of 0.8 means some 10 differing bits of 64, where a trie no longer prunes, nodes that agree in a band of MinHash
minima: a signature of BANDS times ROWS minima is cut into bands, and at 0.8 all bands differ with a probability of 7e-6.
Components over these candidates hold every candidate pair, so each is verified on its own, where its sets go: pairs
that share a band are compared by their minima (those that agree in fewer than NEAR of them are
dropped: at 0.8, more than five standard deviations), then by their whole sets. Pairs within 3 bits, found again by tries
over the component, are compared by their whole sets at once, whatever their minima. A pair that is joined already isn't
compared, so a group of near copies costs about one comparison for each member.

A component beyond PART_BYTES of sets (8 bytes a distinct shingle and NODE_BYTES a node) is dealt by a hash of its nodes
into parts of about that size, and every two parts meet in a task of their own; the classes found there are links, whose
components are the classes. So a task holds two parts at most, and no pair is lost; the work on such a component grows
with the square of its number of parts. Rows of a crowded band or hub are joined by `spread_join`, without a shuffle.
Rows are picked by number where they lie: only the texts of candidates are shuffled, and the rows that stay aren't.

Defined cases: texts without words, null ones included, are one class; texts of fewer words than a shingle are one
shingle; of a class the row with the smallest id stays, a null id counts as larger than any other, and of rows that
repeat an id one stays; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm.common import durable, in_slices, lean, new_folder, spread_join
from brookmill.llm.graph import connected
from brookmill.llm.simhash import BITS, _shingles, links, near_pairs

BANDS, ROWS = 30, 5
#: Minima of which two candidates must agree in this many, at a similarity of 0.8.
NEAR = 95
#: Bytes of sets that a part of a large component holds, and what a node counts besides its set.
PART_BYTES, NODE_BYTES = 48 << 20, 1700
#: Blocks of 64 row numbers that are broadcast, of 24 bytes each.
MOST_BLOCKS = 1 << 20
#: Shingles whose minima are taken at a time.
PART = 1 << 11
_random = np.random.default_rng(42)
_TIMES, _PLUS = (_random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES = _TIMES | np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    parts = [np.array(h, np.uint64) for h in _shingles((text or "").encode("utf-8", "surrogatepass").lower(), width)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """MinHash signature of a set; all ones for the empty one."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(found), PART):
        mixed = found[k : k + PART, None] * _TIMES + _PLUS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """One 64-bit key for each band, its number included."""
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def majority(found: np.ndarray) -> int:
    """SimHash of a set as a signed long: bits set in more than half of its hashes."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(found), PART):
        ones += np.unpackbits(found[k : k + PART].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big", signed=True)


def _signed(width: int):
    def run(batches):
        for batch in in_slices(batches):
            sets = [shingle_set(t.as_py(), width) for t in batch.column(2)]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            keys = [band_keys(minima(s)) for s in sets]
            fps = pa.array([majority(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), fps], names=["row", "id", "digest", "keys", "fp"])

    return lean(run)


def _with_sets(width: int):
    def run(batches):
        for batch in in_slices(batches):
            sets = [shingle_set(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["root", "node", "found"])

    return lean(run)


class _Classes:
    """Classes of one component's nodes, joined as links are found."""

    def __init__(self, sets: list[np.ndarray], least: float):
        self.sets, self.limit = sets, least
        self.size = np.array([len(s) for s in sets])
        self.minima = [minima(s) for s in sets]
        self.short = np.array([m.astype(np.uint16) for m in self.minima]).reshape(-1, BANDS * ROWS)
        self.agree = NEAR - round((0.8 - least) * BANDS * ROWS)
        self.label = np.arange(len(sets))
        self.members = {k: [k] for k in range(len(sets))}

    def join(self, a: int, b: int) -> None:
        a, b = self.label[a], self.label[b]
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.label[moved] = a
        self.members[a] += moved

    def alike(self, a: int, b: int) -> bool:
        both = len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True))
        return both >= self.limit * (self.size[a] + self.size[b] - both)

    def meet(self, k: int, others: list[int], agree: int) -> None:
        """Joins node k with those of the others that are like it, if so many minima agree."""
        at = np.array(others)
        at = at[self.label[at] != self.label[k]]
        n = self.size[k]
        at = at[(np.minimum(self.size[at], n) >= self.limit * np.maximum(self.size[at], n) - 1e-9)]
        if agree:
            at = at[(self.short[at] == self.short[k]).sum(axis=1) >= agree]
        for j in at:
            if self.label[j] != self.label[k] and self.alike(k, j):
                self.join(k, j)

    def apart(self, nodes: list[int]) -> bool:
        return len(nodes) > 1 and len(set(self.label[nodes].tolist())) > 1

    def bucket(self, nodes: list[int], agree: int) -> None:
        """Compares all these nodes. Those of the largest class are looked at in growing parts until one is like the node."""
        large, rest, sort_at = [], [], 64
        for k in nodes:
            if rest:
                self.meet(k, rest, agree)
            start, size = 0, 16
            while start < len(large) and self.label[large[0]] != self.label[k]:
                self.meet(k, large[start : start + size], agree)
                start, size = start + size, size * 8
            (large if large and self.label[large[0]] == self.label[k] else rest).append(k)
            if len(rest) >= sort_at or not large:
                seen = large + rest
                names, counts = np.unique(self.label[seen], return_counts=True)
                most = names[counts.argmax()]
                large = [j for j in seen if self.label[j] == most]
                rest = [j for j in seen if self.label[j] != most]
                sort_at = max(64, 2 * len(rest))

    def bands(self) -> None:
        """Compares nodes that share a band."""
        buckets: dict[int, list[int]] = {}
        for k, m in enumerate(self.minima):
            for key in band_keys(m):
                buckets.setdefault(key, []).append(k)
        for nodes in buckets.values():
            if self.apart(nodes):
                self.bucket(nodes, self.agree)

    def tries(self) -> None:
        """Compares nodes whose fingerprints differ in at most 3 bits; nothing is left to do where all are one class."""
        if not self.apart(list(self.members)):
            return
        fps, at = np.unique(np.array([majority(s) for s in self.sets], np.int64).view(np.uint64), return_inverse=True)
        held = [[] for _ in fps]
        for k, g in enumerate(at):
            held[g].append(k)
        for nodes in held:
            if self.apart(nodes):
                self.bucket(nodes, 0)
        whole, lead = np.array([not self.apart(nodes) for nodes in held]), np.array([nodes[0] for nodes in held])
        for i, j in near_pairs(fps):
            left = ~(whole[i] & whole[j] & (self.label[lead[i]] == self.label[lead[j]]))
            for a, b in zip(i[left], j[left]):
                if self.apart(nodes := held[a] + held[b]):
                    self.bucket(nodes, 0)


def classes_of(sets: list[np.ndarray], least: float) -> np.ndarray:
    """A label for each of the sets of one component."""
    found = _Classes(sets, least)
    found.bands()
    found.tries()
    return found.label


def _verified(least: float):
    """Each cell's rows lie together; gives (node, class) for every node that isn't its class's name."""
    schema = pa.schema([("node", pa.int64()), ("class", pa.int64())])

    def settle(nodes: list[int], sets: list[np.ndarray]):
        label = classes_of(sets, least)
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in moved], pa.int64()), pa.array([nodes[label[k]] for k in moved], pa.int64())], schema=schema)

    def run(batches):
        now, nodes, sets = None, [], []
        for batch in in_slices(batches):
            for cell, node, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if cell != now and nodes:
                    yield settle(nodes, sets)
                    nodes, sets = [], []
                now = cell
                nodes.append(node)
                sets.append(np.frombuffer(found, np.uint64))
        if nodes:
            yield settle(nodes, sets)

    return lean(run)


def _by_trie(nodes: DataFrame) -> DataFrame:
    """(u, v): links of nodes whose SimHash fingerprints are equal or linked by the trie self-join."""
    hubs = durable(nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count("*").alias("n")))
    name = lambda c: hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"{c}_hub"))
    linked = links(hubs.select("fp")).join(name("u"), "u").join(name("v"), "v").select(F.col("u_hub").alias("u"), F.col("v_hub").alias("v"))
    equal = spread_join(nodes.select("fp", "node"), hubs, "fp", nodes.count())
    return linked.unionByName(equal.where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v")))


def _moved(sets: DataFrame, least: float, part_bytes: int) -> DataFrame:
    """(node, class) of the nodes that aren't their class's name. sets: root, node, found.

    The roots of large components are broadcast: one row of 24 bytes for each part_bytes of sets at most.
    """
    weight = F.sum(F.length("found") + NODE_BYTES).alias("weight")
    large = sets.groupBy("root").agg(weight).where(F.col("weight") > part_bytes)
    large = durable(large.select("root", F.ceil(F.col("weight") / part_bytes).alias("parts")))
    split, cells = not large.isEmpty(), sets.withColumnRenamed("root", "cell")
    if split:
        dealt = sets.join(F.broadcast(large), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("own != other or parts = 1")
        cells = dealt.withColumn("cell", F.concat_ws(":", "root", F.least("own", "other"), F.greatest("own", "other")))
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.select("cell", "node", "found").repartition(n, "cell").sortWithinPartitions("cell", "node")
    found = cells.mapInArrow(_verified(least), "node long, class long")
    if not split:
        return durable(found)
    return connected(found.select(F.col("node").alias("u"), F.col("class").alias("v"))).withColumnRenamed("root", "class")


def _among(rows: DataFrame, wanted: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """The rows whose number (column row) is in wanted (column row), which has no nulls.

    Numbers are looked up in blocks of 64 bits, which are broadcast, so rows stay where they are; beyond `most` blocks the
    rows are shuffled to their blocks instead.
    """
    block, at = F.shiftright("row", 6).alias("block"), "cast(row & 63 as int)"
    blocks = durable(wanted.groupBy(block).agg(F.bit_or(F.expr(f"shiftleft(1L, {at})")).alias("bits")))
    found = rows.select(block, *rows.columns).join(F.broadcast(blocks) if blocks.count() <= most else blocks, "block")
    return found.where(f"getbit(bits, {at}) = 1").select(*rows.columns)


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs that stay, one of each class, with their columns."""
    if not 0.8 <= least <= 1:
        raise ValueError("bands are laid out for similarities of 0.8 and more")
    names = docs.columns
    plain = [f"c{k}" for k in range(len(names))]
    path = new_folder(docs.sparkSession, "near-rows")  # compressed, where a checkpoint isn't
    docs.toDF(*plain).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    doc_id, text = F.col(plain[names.index(id_col)]).cast("long"), F.col(plain[names.index(text_col)]).cast("string")
    signed = durable(rows.select("row", doc_id.alias("id"), text.alias("text")).mapInArrow(_signed(width), "row long, id long, digest binary, keys array<long>, fp long"))
    first = F.struct(F.col("id").isNull().alias("without"), "id", "row")
    nodes = signed.groupBy("digest").agg(F.min(first).alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    nodes = durable(nodes.select(F.col("first.row").alias("node"), "first", "keys", "fp"))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most"), F.count("*").alias("n"))
    hubs = hubs.where("hub != most").select("key", "hub", "n")
    banded = spread_join(keyed, hubs, "key", BANDS * nodes.count()).where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    candidates = connected(banded.unionByName(_by_trie(nodes)).distinct())
    candidates = durable(candidates.unionByName(candidates.select(F.col("root").alias("node"), "root")).distinct())
    texts = _among(rows.select("row", text.alias("text")), candidates.select(F.col("node").alias("row"))).withColumnRenamed("row", "node")
    texts = texts.join(candidates, "node").select("root", "node", "text")
    sets = durable(texts.mapInArrow(_with_sets(width), "root long, node long, found binary"))
    moved = _moved(sets, least, part_bytes)
    named = nodes.select("node", "first").join(moved, "node", "left").groupBy(F.coalesce("class", "node").alias("class")).agg(F.min("first").alias("first"))
    kept = named.select(F.col("first.row").alias("row"))
    return _among(rows, kept).select(*plain).toDF(*names)
