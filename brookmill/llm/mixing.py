"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to), so the flow problem has one supply node
for each pattern, whatever the corpus holds. Pattern capacity is offered once for each allowed use, later uses at a
higher cost (convex), and routed to the quotas of the pattern's sources; unmet quota costs more than any use. As all
cost lies on the supply arcs, cheapest-first augmentation is optimal: one maximum flow for each use, in ascending cost.

The tokens a pattern gives are full uses of all its documents plus a rest, for which documents are chosen in the order
of a seeded hash: the cut lies where the running sum reaches the rest, found by summing hash ranges, each narrower than
the one before, so that no source is ever sorted in one task. What whole documents leave open (less than one of them,
as a rule) is then filled, largest fitting document first, until none fits. A document's uses thus follow from its own columns and one small row for its pattern.

Defined cases: null text has size 0; a null source is a source of its own, sorted last; documents of size 0 or of no
source are never taken; rows that repeat an id are hashed with size and text and so taken each for itself, identical
rows together; other columns pass through `mixed` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookmill.llm.common import bounded, durable, text_or_empty

#: Most membership patterns; their flow is solved on the driver and broadcast, under 100 bytes each.
MAX_PATTERNS = 20_000
#: Hash bits that one round of narrowing resolves, and rounds until the rest is sorted.
STEP_BITS, STEPS = 10, 4

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def weighted_targets(sizes: list[tuple[str | None, int]], weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Targets of sources: weights repeat over sources by code point (null last) and split `share` of all sizes; none exceeds `most` times its size, the excess going to the others by weight."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-32-be", "surrogatepass")))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(ordered)}
    size, free, out = dict(ordered), dict(weight), {}
    rest = share * sum(size.values())
    while free:
        unit = rest / sum(free.values())
        above = [s for s in free if free[s] * unit > most * size[s]]
        if not above:
            out |= {s: w * unit for s, w in free.items()}
            break
        for s in above:
            out[s] = most * size[s]
            rest -= out[s]
            del free[s]
    return out


class _Flow:
    """Maximum flow by shortest augmenting layers; capacities can be raised between calls."""

    def __init__(self):
        self.to, self.room, self.out = [], [], defaultdict(list)

    def arc(self, a, b, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _layers(self, s, t) -> dict:
        depth, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] and self.to[e] not in depth:
                    depth[self.to[e]] = depth[x] + 1
                    queue.append(self.to[e])
        return depth

    def push(self, s, t) -> None:
        while t in (depth := self._layers(s, t)):
            at = {x: 0 for x in depth}
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    most = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    path, x = [], s
                while at[x] < len(self.out[x]):
                    e = self.out[x][at[x]]
                    if self.room[e] and depth.get(self.to[e]) == depth[x] + 1:
                        break
                    at[x] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    x = self.to[e ^ 1]
                    at[x] += 1
                    continue
                path.append(e)
                x = self.to[e]


def route(capacity: dict[str, int], members: dict[str, list], quota: dict, uses: int = 2) -> dict[str, dict]:
    """Tokens that each pattern gives to each of its sources: {pattern: {source: tokens}}, at the least total cost of repeated uses."""
    flow, supply, given = _Flow(), {}, {}
    for p, size in capacity.items():
        supply[p] = flow.arc("s", ("p", p), 0)
        for s in members[p]:
            given[p, s] = flow.arc(("p", p), ("q", s), size * uses)
    for s, q in quota.items():
        flow.arc(("q", s), "t", q)
    for _ in range(uses):
        for p, size in capacity.items():
            flow.room[supply[p]] += size
        flow.push("s", "t")
    out: dict[str, dict] = {p: {} for p in capacity}
    for (p, s), e in given.items():
        out[p][s] = flow.room[e ^ 1]
    return out


@dataclass
class Plan:
    """Outcome for each pattern and source; `columns` gives every document its part."""

    patterns: DataFrame  # pattern, full, cut, extra (array of hashes), routes
    source_size: dict
    target: dict


def _hashed(docs: DataFrame, sources: Column, size: Column, id_col: str, text_col: str, seed: int) -> DataFrame:
    of = F.array_sort(F.array_distinct(sources))
    return docs.withColumns({"_size": size, "_sources": of}).withColumns({"_pattern": F.coalesce(F.to_json(F.col("_sources")), F.lit("[]")), "_h": F.xxhash64(F.lit(seed), F.col(id_col), F.col("_size"), F.xxhash64(F.col(text_col)))})


def plan(docs: DataFrame, *, sources: Column, size: Column, targets=weighted_targets, uses: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Plan]:
    """Solves the mix. sources: array of the sources of a document. targets: function from [(source, size)] to {source: tokens}. Returns docs with _pattern, _size and _h, and the plan."""
    spark = docs.sparkSession
    marked = _hashed(docs, sources, size, id_col, text_col, seed)
    light = durable(marked.select("_pattern", "_sources", "_size", "_h"))
    totals = bounded(light.groupBy("_pattern").agg(F.sum("_size").alias("size"), F.first("_sources").alias("sources")), MAX_PATTERNS, "membership patterns")
    totals = sorted(totals, key=lambda r: r["_pattern"])
    capacity = {r["_pattern"]: r["size"] or 0 for r in totals}
    members = {r["_pattern"]: list(r["sources"] or []) for r in totals}
    source_size: dict = defaultdict(int)
    for p, of in members.items():
        for s in of:
            source_size[s] += capacity[p]
    target = targets(list(source_size.items()))
    routed = route(capacity, members, {s: round(t) for s, t in target.items()}, uses)
    full, rest = {}, {}
    for p, cap in capacity.items():
        full[p], rest[p] = divmod(sum(routed[p].values()), cap) if cap else (0, 0)

    # where the hash order of a pattern is cut: first 10 bits, then 10 more of that range, and so on
    order = F.shiftrightunsigned("_h", 1)  # 63 bits, never negative
    cut = {p: (0, r) for p, r in rest.items() if r}  # lower end of the range under search, tokens still to choose in it
    bits = 63
    for _ in range(STEPS):
        if not cut:
            break
        low = spark.createDataFrame([(p, *c) for p, c in cut.items()], "_pattern string, low long, left long")
        shift = bits - STEP_BITS
        inside = light.join(F.broadcast(low), "_pattern").where(F.shiftright(order, bits) == F.shiftright("low", bits))
        sums = inside.groupBy("_pattern", F.shiftright(order, shift).alias("range")).agg(F.sum("_size").alias("n"), F.first("left").alias("left"))
        running = F.sum("n").over(Window.partitionBy("_pattern").orderBy("range"))  # at most 2^STEP_BITS rows
        reached = sums.withColumn("before", running - F.col("n")).where((F.col("before") < F.col("left")) & (F.col("before") + F.col("n") >= F.col("left")) & (F.col("n") > 0))
        for r in bounded(reached.select("_pattern", "range", "before"), len(cut), "membership patterns"):
            cut[r["_pattern"]] = (r["range"] << shift, cut[r["_pattern"]][1] - r["before"])
        bits = shift
    # what a range of 2^23 hashes holds more than the cut is left to the fills
    last = {p: c[0] for p, c in cut.items()}
    gap = {p: c[1] for p, c in cut.items()}
    extra: dict[str, list] = defaultdict(list)
    tried = set(cut)  # patterns in which a document may still fit
    while open_ := [(p, last[p], gap[p], extra[p]) for p in sorted(tried) if gap[p] > 0]:
        tried = set()
        want = spark.createDataFrame(open_, "_pattern string, low long, gap long, taken array<long>")
        fits = light.join(F.broadcast(want), "_pattern").where((F.col("_size") > 0) & (order >= F.col("low")) & (F.col("_size") <= F.col("gap")) & ~F.array_contains("taken", F.col("_h")))
        for r in bounded(fits.groupBy("_pattern").agg(F.max(F.struct("_size", "_h")).alias("best")), MAX_PATTERNS, "membership patterns"):
            extra[r["_pattern"]].append(r["best"]["_h"])
            gap[r["_pattern"]] -= r["best"]["_size"]
            tried.add(r["_pattern"])
    rows = [(p, full[p], last.get(p, 0), extra[p], [(s, n) for s, n in routed[p].items() if n]) for p in capacity]
    table = spark.createDataFrame(rows, "_pattern string, full long, cut long, extra array<long>, routes array<struct<source:string,tokens:long>>")
    return marked, Plan(table, dict(source_size), target)


def chosen(marked: DataFrame, solved: Plan) -> DataFrame:
    """docs with _uses (times a document is taken) and routes (tokens of its pattern by source)."""
    order = F.shiftrightunsigned("_h", 1)
    part = F.when((order < F.col("cut")) | F.array_contains("extra", F.col("_h")), 1).otherwise(0)
    return marked.join(F.broadcast(solved.patterns), "_pattern").withColumn("_uses", F.when(F.col("_size") > 0, F.col("full") + part).otherwise(F.lit(0)).cast("long"))


def mix(docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, uses."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    marked, solved = plan(rows, sources=F.array("source"), size=word_count(text_or_empty()), **how)
    sources = docs.sparkSession.createDataFrame([(s, n, float(solved.target[s])) for s, n in solved.source_size.items()], "source string, source_size long, target double")
    taken = chosen(marked, solved).join(F.broadcast(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    return taken.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_uses") * F.col("_size")).alias("taken"), "source", F.col("_uses").alias("uses"))


def mixed(docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the columns of docs."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text, source = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    marked, solved = plan(plain, sources=F.array(F.col(source).cast("string")), size=word_count(text_or_empty(text)), id_col=key, text_col=text, **how)
    often = chosen(marked, solved).where("_uses > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_uses"))))
    return often.select(*plain.columns).toDF(*names)
