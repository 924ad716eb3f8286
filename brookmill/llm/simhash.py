"""SimHash near-duplicates by a binary-trie self-join.

A document's fingerprint has 64 bits: bit i is set if it is set in more than half of the hashes of its word shingles
(repeats included). Fingerprints within `budget` differing bits are linked, and a document's class is everything that
can be reached over links.

The self-join works on distinct fingerprints. Two that differ in at most 3 bits agree on at least one of four 16-bit
blocks, so each is dealt to four tries: the bits rotated to bring one block to the front, partitioned by that block.
In a trie, pairs of nodes are walked together from the shared block down, one bit at a time, adding up the bits in
which the two paths differ; a pair of nodes is dropped as soon as its sum exceeds the budget. A node is a range of the
sorted fingerprints, so a whole front of node pairs moves one level with a few array operations. Each task reports a
spanning set of the links it found (a node and the smallest it reaches), from which components are joined together.

A block that very many distinct fingerprints share is dealt out again by the bits that remain, in four parts of which
one must again agree, until no group is large; so a hot group is split without losing a pair. Verdicts reach the documents
by fingerprint, those of hot fingerprints by a broadcast of bounded size, so their documents aren't shuffled.

Defined cases: null or empty texts and texts without words have fingerprint zero and are linked like any other; texts of
fewer words than a shingle are one shingle; rows that repeat an id each give a row; a null id counts as larger than any
other; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm.common import components, durable, spread_join
from brookmill.llm.graph import connected

BITS = 64
#: Bytes of text that are cut into words at a time.
CHUNK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _shingles(text: bytes, width: int):
    """Arrays of shingle hashes of a whole text, chunk by chunk, each chunk beginning with the last words of the one before."""
    digest, held, at, any_yet = xxhash.xxh64_intdigest, [], 0, False
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        words = held + text[at:end].split()
        at = end
        if len(words) >= width:
            joined, ends, total = b" ".join(words), [], -1
            starts = []
            for w in words:
                starts.append(total + 1)
                total += len(w) + 1
                ends.append(total)
            yield [digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :])]
            any_yet = True
        held = words[max(0, len(words) - width + 1) :] if len(words) >= width else words
    if not any_yet and held:
        yield [digest(b" ".join(held), 42)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) words of a text."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for hashes in _shingles((text or "").encode("utf-8", "surrogatepass").lower(), width):
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_pairs(values: np.ndarray, depth: int, budget: int, front: int = 1 << 18):
    """Pairs (i, j), i < j, of sorted distinct values within `budget` bits that share their first `depth` bits.

    The front of node pairs is kept in blocks of bounded size, deepest first, so memory doesn't grow with the pairs.
    Yields index arrays.
    """
    n = len(values)
    if n < 2:
        return
    head = values >> np.uint64(BITS - depth) if depth else np.zeros(n, np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1], [True]]))
    lo, hi = cut[:-1], cut[1:]
    many = hi - lo > 1
    stack = [(depth, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int64))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, al, ah, bl, bh, differ = stack.pop()
        if len(al) > front:
            for k in range(0, len(al), front):
                stack.append((d, *(x[k : k + front] for x in (al, ah, bl, bh, differ))))
            continue
        same = al == bl
        leaf = (ah - al == 1) & (bh - bl == 1) & ~same
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = _ones(values[i] ^ values[j]) <= budget
            if near.any():
                yield i[near], j[near]
            rest = ~leaf
            al, ah, bl, bh, differ, same = al[rest], ah[rest], bl[rest], bh[rest], differ[rest], same[rest]
        if not len(al) or d == BITS:
            continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((values >> np.uint64(BITS - 1 - d)) & np.uint64(1), dtype=np.int64)])
        c = ones[d]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        nodes = []
        for x_lo, x_hi, y_lo, y_hi, more, which in ((al, am, bl, bm, 0, None), (am, ah, bm, bh, 0, None), (al, am, bm, bh, 1, None), (am, ah, bl, bm, 1, ~same)):
            ok = (x_hi > x_lo) & (y_hi > y_lo) & (differ + more <= budget)
            if which is not None:
                ok &= which
            ok &= ~((x_lo == y_lo) & (x_hi - x_lo == 1))
            nodes.append((x_lo[ok], x_hi[ok], y_lo[ok], y_hi[ok], differ[ok] + more))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*nodes))))


def near_pairs(values: np.ndarray, few: int = 256):
    """Index arrays of the pairs (i, j), i < j, of sorted distinct values within 3 bits: from four tries, so some pairs are repeated, or by comparing a few values one with another."""
    if len(values) <= few:
        yield np.nonzero(np.triu(_ones(values[:, None] ^ values) <= 3, 1))
        return
    step = BITS // 4
    for turn in range(0, BITS, step):
        turned = values << np.uint64(turn) | values >> np.uint64(BITS - turn) if turn else values
        order = np.argsort(turned)
        for i, j in trie_pairs(turned[order], step, 3):
            yield np.minimum(order[i], order[j]), np.maximum(order[i], order[j])


def _rotations(fp, depth: int, step: int):
    """The value with each of the four blocks of `step` bits after its first `depth` brought forward to that place."""
    rest, out = BITS - depth, []
    for k in range(4):
        turn = k * step
        if turn == 0:
            out.append(fp)
            continue
        low = (1 << rest) - 1
        low = low - (1 << 64) if low >= 1 << 63 else low
        tail = fp.bitwiseAND(F.lit(low).cast("long"))
        turned = F.shiftleft(tail, turn).bitwiseAND(F.lit(low).cast("long")).bitwiseOR(F.shiftrightunsigned(tail, rest - turn))
        top = fp.bitwiseAND(F.lit(~low).cast("long"))
        out.append(top.bitwiseOR(turned))
    return out


def _dealt(nodes: DataFrame, hot: int) -> list[tuple[DataFrame, int]]:
    """(fp, value, key) with the number of bits that a key fixes: one table for each level of splitting."""
    level, depth, parts = nodes.select("fp", F.col("fp").alias("value"), F.lit("").alias("key")), 0, []
    while True:
        step = max(1, (BITS - depth) // 4)
        turned = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("value")) for k, v in enumerate(_rotations(F.col("value"), depth, step))])
        level = level.select("fp", "key", F.explode(turned).alias("t")).select("fp", F.col("t.value").alias("value"), F.concat_ws("/", "key", F.concat(F.col("t.k"), F.lit(":"), F.hex(F.shiftrightunsigned(F.col("t.value"), BITS - depth - step)))).alias("key"))
        depth += step
        sizes = level.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
        if depth >= BITS - 8 or sizes.isEmpty():
            parts.append((level, depth))
            return parts
        sizes = durable(sizes.select("key"))
        parts.append((level.join(sizes, "key", "left_anti"), depth))
        level = durable(level.join(sizes, "key", "left_semi"))


def links(nodes: DataFrame, *, budget: int = 3, hot: int = 2_000_000) -> DataFrame:
    """(u, v): spanning links among distinct fingerprints (column fp) within `budget` bits.

    hot: most fingerprints of one key that go to one task (16 bytes each); larger groups are dealt out again.
    """
    if budget > 3:
        raise ValueError("four blocks find pairs of at most 3 differing bits")

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = None
    for part, depth in _dealt(nodes, hot):
        turn = F.regexp_replace("key", ":[^/]*", "").alias("turn")
        got = part.repartition(n, "key").select("fp", "value", turn).mapInArrow(_by_turn(depth, budget), "u long, v long")
        found = got if found is None else found.unionByName(got)
    return found.distinct()


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3) -> DataFrame:
    """One row for each document: doc_id, fp, component_id (smallest id reachable over links, its own included)."""
    marked = durable(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = connected(links(nodes, budget=budget).select("u", "v")).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "n", "component_id")
    return spread_join(marked, by_fp, "fp", marked.count()).select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay: of each class the document with the smallest id (with all rows that repeat that id).

    Only ids of dropped documents are joined back to the rows. Rows without an id can't be told apart and stay.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, **how)
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["_dropped"], "left_anti")


def _gathered(pairs, least: int = 1 << 20):
    """Pairs in blocks of some size, so that components are joined seldom and memory stays bounded."""
    held, n = [], 0
    for i, j in pairs:
        held.append((i, j))
        n += len(i)
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _by_turn(depth: int, budget: int):
    """Each task walks its tries, one for each way of turning; equal turned values of one trie are one fingerprint."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held: dict[str, list] = {}
        for batch in batches:
            fp, value = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turns = batch.column(2).dictionary_encode()
            codes = turns.indices.to_numpy()
            for c, turn in enumerate(turns.dictionary.to_pylist()):
                held.setdefault(turn, []).append((fp[codes == c], value[codes == c]))
        for parts in held.values():
            fp = np.concatenate([p[0] for p in parts])
            value = np.concatenate([p[1] for p in parts]).view(np.uint64)
            value, first = np.unique(value, return_index=True)
            fp = fp[first]
            label = np.arange(len(value))
            for i, j in _gathered(trie_pairs(value, depth, budget)):
                label = components(len(value), np.concatenate([i, np.arange(len(value))]), np.concatenate([j, label]))
            moved = np.flatnonzero(label != np.arange(len(value)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], schema=schema)

    return run
