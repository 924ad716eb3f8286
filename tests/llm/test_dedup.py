import hashlib
import random

import numpy as np
import xxhash
from conftest import odd_rows
from pyspark.sql import functions as F

from brookmill.llm import exact_dedup, graph, simhash
from brookmill.llm.common import durable, spread_join


def test_exact_groups_of_odd_rows(odd):
    want: dict = {}
    for r in odd_rows():
        norm = (r[1] or "").encode().lower()
        want.setdefault(norm, []).append(r[0])
    got = exact_dedup.decide(odd, keep="largest").collect()
    assert len(got) == len(odd_rows())
    by_sha = {hashlib.sha256(k).hexdigest(): v for k, v in want.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)


def test_survivors_are_whole_rows_one_of_each_text(odd, none):
    for keep, pick in (("smallest", min), ("largest", max)):
        got = exact_dedup.survivors(odd, keep=keep)
        assert got.columns == odd.columns
        rows = got.collect()
        texts = [(r["text"] or "").encode().lower() for r in rows]
        assert len(set(texts)) == len(texts) == len({(r[1] or "").encode().lower() for r in odd_rows()})
        for r in rows:
            same = [x[0] for x in odd_rows() if (x[1] or "").encode().lower() == (r["text"] or "").encode().lower() and x[0] is not None]
            assert r["doc_id"] == (pick(same) if same else None)
            assert (r["norm"], r["value"]) == (("clash", "clash") if r["doc_id"] else (None, None))
    assert exact_dedup.survivors(none).count() == exact_dedup.decide(none).count() == 0


def test_hot_text_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(200)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = exact_dedup.survivors(df, keep="largest").collect()
        assert len(got) == 1 + sum(i % 3 == 0 for i, _ in rows)
        assert [r["doc_id"] for r in got if r["text"] == "hot"] == [199]
        sizes = exact_dedup.decide(df, keep="largest").where("group_size > 1").collect()
        assert {r["group_size"] for r in sizes} == {len(sizes)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(ids, fps, budget=3):
    least = list(range(len(fps)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    order = sorted(range(len(fps)), key=lambda k: (ids[k] is None, ids[k] or 0))
    for a in range(len(order)):
        for b in range(a + 1, len(order)):
            if bin(fps[order[a]] ^ fps[order[b]]).count("1") <= budget:
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {(ids[order[k]], fps[order[k]]): ids[order[find(k)]] for k in range(len(order))}


def test_fingerprints_and_classes_of_odd_rows(odd, none):
    rows = odd_rows()
    for width in (3, 5):
        fps = [plain_fingerprint(r[1], width) for r in rows]
        want = plain_components([r[0] for r in rows], fps)
        got = simhash.classes(odd, width=width).collect()
        assert len(got) == len(rows)
        for r in got:
            assert want[r["doc_id"], r["fp"] % 2**64] == r["component_id"]
    assert simhash.classes(none).count() == 0


def test_long_texts_in_chunks(monkeypatch):
    text = odd_rows()[6][1] + "\tEnd  of\x0btext"
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 97)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)
    assert simhash.fingerprint("a" * 500 + " b") == plain_fingerprint("a" * 500 + " b")


def near_values(n, seed):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        v = r.getrandbits(64)
        for _ in range(r.choice((1, 1, 6))):
            out.add(v)
            for _ in range(r.randint(1, 3)):
                v ^= 1 << r.randrange(64)
    return sorted(out)


def test_trie_finds_every_pair_within_the_budget():
    values = np.array(near_values(400, 1), np.uint64)
    for budget in range(4):
        got = {(int(min(i, j)), int(max(i, j))) for a, b in simhash.trie_pairs(values, 0, budget, front=50) for i, j in zip(a, b)}
        want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= budget}
        assert got == want


def test_links_join_the_same_components_also_when_groups_are_split(spark):
    values = near_values(300, 2) + [0, 1, 3, 7, 15, 2**64 - 1, 2**63]
    values = sorted(set(values))
    want = plain_components(list(range(len(values))), values)
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long").repartition(3)
    for hot in (2_000_000, 2):
        roots = {r["node"]: r["root"] for r in graph.connected(simhash.links(nodes, hot=hot)).collect()}
        label = {v: roots.get(s := v - 2**64 if v >= 2**63 else v, s) for v in values}
        groups: dict = {}
        for k, v in enumerate(values):
            groups.setdefault(label[v], set()).add(want[k, v])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7), (2001, 2000), (2000, 2001)]
    got = {r["node"]: r["root"] for r in graph.connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and all(got[k] == 1000 for k in range(1001, 1100)) and got[2001] == 2000
    assert graph.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents_of_a_hot_fingerprint_and_links_of_a_hub_are_not_shuffled(spark):
    rows = [(k, "" if k % 3 == 0 else f"a{k} b{k} c{k} d{k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(docs).collect()}
    assert len(got) == 3000 and all(got[k] == 0 for k in range(0, 3000, 3))
    pairs = spark.createDataFrame([(k, 0 if k % 2 else k) for k in range(4000)], "key long, hub long").repartition(8).select(F.col("hub").alias("key"), F.col("key").alias("value"))
    table = durable(pairs.groupBy("key").agg(F.min("value").alias("m"), F.count("*").alias("n")))
    out = spread_join(durable(pairs), table, "key", 4000)
    assert {(r["key"], r["value"], r["m"]) for r in out.collect()} == {(0 if k % 2 else k, k, 0 if k % 2 else k) for k in range(4000)}
    per_task = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 1000 and "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_near_survivors(odd, none):
    got = simhash.survivors(odd, width=5)
    assert got.columns == odd.columns
    want = {(r["doc_id"], r["component_id"]) for r in simhash.classes(odd, width=5).collect()}
    kept = {i for i, c in want if i == c or i is None}
    assert {r["doc_id"] for r in got.collect()} == kept
    assert simhash.survivors(none).count() == 0


def test_ids_of_a_text_with_many_copies_go_to_many_tasks(spark):
    rows = [(k, "Copied" if k % 3 == 0 else f"own {k}") for k in range(6000)] + [(None, "copied")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    found = exact_dedup.decide(docs, keep="largest").collect()
    copies = [r for r in found if r["group_size"] > 1]
    assert len(found) == 6300 and len(copies) == 2300 and {(r["keep_id"], r["group_size"]) for r in copies} == {(5997, 2300)}
    assert sum(r["kept"] for r in found) == 4001
    members = docs.select("doc_id", "text").mapInArrow(exact_dedup._members, "sha string, ids array<long>, salt int").collect()
    assert len({r["salt"] for r in members if len(r["ids"]) >= exact_dedup.MANY}) > 1
