import itertools
import re
from collections import Counter

from conftest import odd_rows, prose
from pyspark.sql import functions as F

from brookmill.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def test_targets_by_hand():
    got = mixing.weighted_targets([("b", 100), (None, 10), ("a", 100)])
    # 315 words by weights 3:1:2 -> 157.5, 52.5, 105; the last stops at 20, its 85 go 3:1 to the others: 221.25 > 200, the rest to b
    assert got[None] == 20.0 and got["a"] == 200.0 and abs(got["b"] - 95.0) < 1e-9
    assert mixing.weighted_targets([]) == {} and mixing.weighted_targets([("x", 0)]) == {"x": 0.0}


def test_targets_come_out_and_nothing_is_cut(spark):
    rows = [(k, prose(k, 5 + (k * 37) % 300), "hot" if k % 3 else f"s{k % 4}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    words = {k: size(t) for k, t, _ in rows}
    total = Counter()
    for r in got:
        assert r["size"] == words[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"])
        total[r["source"]] += r["taken"]
    targets = {r["source"]: r["target"] for r in got}
    assert abs(sum(targets.values()) - 1.5 * sum(words.values())) < 1e-6
    for s, t in targets.items():
        assert abs(total[s] - t) <= max(20, 0.02 * t)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


def test_odd_rows_and_the_mix_itself(odd, none):
    got = mixing.mix(odd).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, size(r[1])) for r in odd_rows())
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    times = Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = Counter()
    for r in got:
        if r["uses"]:
            text = [x[1] for x in odd_rows() if x[0] == r["doc_id"]][0]
            want[r["doc_id"], text] += r["uses"]
    assert times == want
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0


def cheapest(capacity, members, quota, uses):
    """Least unmet quota, then least cost of repeats, by trying every routing of small integers."""
    best = None
    choices = [[c for c in itertools.product(range(uses * capacity[p] + 1), repeat=len(members[p])) if sum(c) <= uses * capacity[p]] for p in capacity]
    for combo in itertools.product(*choices):
        got, cost = Counter(), 0
        for p, c in zip(capacity, combo):
            for s, n in zip(members[p], c):
                got[s] += n
            cost += max(0, sum(c) - capacity[p])
        if all(got[s] <= q for s, q in quota.items()):
            key = (sum(quota.values()) - sum(got.values()), cost)
            best = key if best is None or key < best else best
    return best


def test_flow_is_optimal_for_overlapping_sources():
    cases = [
        ({"x": 3, "xy": 2, "y": 1}, {"x": ["x"], "xy": ["x", "y"], "y": ["y"]}, {"x": 4, "y": 5}),
        ({"xy": 2, "yz": 2, "xz": 1}, {"xy": ["x", "y"], "yz": ["y", "z"], "xz": ["x", "z"]}, {"x": 3, "y": 1, "z": 4}),
        ({"x": 2, "xy": 3}, {"x": ["x"], "xy": ["x", "y"]}, {"x": 2, "y": 3}),
    ]
    for capacity, members, quota in cases:
        routed = mixing.route(capacity, members, quota)
        given = Counter()
        for of in routed.values():
            given.update(of)
        assert all(given[s] <= q for s, q in quota.items())
        cost = sum(max(0, sum(of.values()) - capacity[p]) for p, of in routed.items())
        assert (sum(quota.values()) - sum(given.values()), cost) == cheapest(capacity, members, quota, 2)


def test_documents_of_several_sources(spark):
    rows = [(k, "w " * (k % 9 + 1), ["a", "b"] if k % 2 else ["a"]) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    marked, solved = mixing.plan(df, sources=F.col("sources"), size=mixing.word_count(F.col("text")))
    got = mixing.chosen(marked, solved).collect()
    sizes = Counter()
    for _, t, of in rows:
        for s in of:
            sizes[s] += size(t)
    assert solved.source_size == dict(sizes)
    taken = sum(r["_uses"] * r["_size"] for r in got)
    routed = sum(x["tokens"] for p in {(r["_pattern"]): r["routes"] for r in got}.values() for x in p)
    assert abs(taken - routed) <= 20 and max(r["_uses"] for r in got) <= 2
