"""Near-de-duplication against brute-force Jaccard similarity."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import odd_rows

import corpus_pipeline
from brookmill.llm import near


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def plain_classes(texts, least=0.8):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = []
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                links.append((b, a))
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))], links


def edited_corpus(seed=5, bases=60):
    """Texts and copies of them with a growing number of replaced words, so that similarities lie on both sides of 0.8."""
    r, texts = random.Random(seed), []
    for _ in range(bases):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((12, 60, 150, 400)))]
        texts.append(" ".join(words))
        for share in (0.0, 0.01, 0.02, 0.03, 0.05):
            copy = list(words)
            for _ in range(max(1, round(share * len(words)))):
                copy[r.randrange(len(copy))] = f"x{r.randrange(5000)}"
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return texts


def test_stage_equals_brute_force_jaccard(spark):
    texts = edited_corpus()
    want, links = plain_classes(texts)
    assert len(links) > 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.unlike(spark, docs, "").collect()}
    assert got == set(want)


def test_parts_of_large_components_lose_no_link(spark):
    texts = edited_corpus(9, 20) + [" ".join(f"v{i}" for i in range(100) if i != k) for k in range(90)]
    want, _ = plain_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in near.survivors(docs, part_bytes=20_000).collect()}
    assert got == set(want)


@pytest.mark.parametrize("seed", range(3))
def test_classes_of_one_component(seed):
    texts = edited_corpus(seed, 30) + [" ".join(f"v{i}" for i in range(100) if i != k) for k in range(90)]
    sets = [near.shingle_set(t, 5) for t in texts]
    want, _ = plain_classes(texts)
    got = near.classes_of(sets, 0.8)
    assert len(set(zip(got.tolist(), want))) == len(set(got.tolist())) == len(set(want))


#: Two sets, found by a search, whose similarity to themselves without the last hash is 0.8, whose fingerprints then differ in 0 and 2 bits, and that then share no band.
BANDLESS = [
    [0xFFFFFFEFFF7FFFFF, 0xFFFFFBFFDDFBFFFD, 0xFFBFFFFFFFFFFFFF, 0xFFFFFDFFFFFFFFB7, 0x7FEFFFFFFFFFFFFF],
    [0xFDFFFFFFFFFBFFBF, 0xBF3FFF7FFFFFFEFF, 0xBFFDFFBFF9FFFFDF, 0xFFDFF7BFFFFFFFFE, 0xFFBF7FFDFFDFFFFF],
]


def bandless_sets():
    return [np.sort(np.array(h, np.uint64)) for whole in BANDLESS for h in (whole, whole[:4])]


def test_links_of_the_tries_decide_where_no_band_is_shared(spark):
    sets = bandless_sets()
    for a, b in (sets[:2], sets[2:]):
        assert not set(near.band_keys(near.minima(a))) & set(near.band_keys(near.minima(b)))
        assert (near.majority(a) ^ near.majority(b)).bit_count() <= 3
    label = near.classes_of(sets, 0.8)
    assert label[0] == label[1] != label[2] == label[3]
    nodes = spark.createDataFrame([(k, near.majority(s)) for k, s in enumerate(sets)], "node long, fp long")
    roots = {r["node"]: r["root"] for r in near.connected(near._by_trie(nodes)).collect()}
    rows = [(roots.get(k, k), k, s.tobytes()) for k, s in enumerate(sets)]
    for part_bytes in (near.PART_BYTES, 2000):
        moved = near._moved(spark.createDataFrame(rows, "root long, node long, found binary"), 0.8, part_bytes).collect()
        assert {frozenset(r) for r in moved} == {frozenset((0, 1)), frozenset((2, 3))}


def test_tries_over_many_nodes(monkeypatch):
    monkeypatch.setattr(near, "band_keys", lambda least: [int.from_bytes(least.tobytes()[:8], "big")])  # so that bands find next to nothing
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 64, 200, np.uint64)) for _ in range(300)]
    sets += [s[:-2] for s in sets[::2]] + [s[1:] for s in sets[::3]]
    values = np.unique(np.array([near.majority(s) for s in sets], np.int64).view(np.uint64))
    i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values) <= 3, 1))
    got = {p for x, y in near.near_pairs(values, 10) for p in zip(x.tolist(), y.tolist())}
    assert len(values) > 300 and got == set(zip(i.tolist(), j.tolist())) and got
    label, near_to = near.classes_of(sets, 0.8), lambda a, b: (near.majority(a) ^ near.majority(b)).bit_count() <= 3
    copies = [(k, 300 + k // 2) for k in range(0, 300, 2)] + [(k, 450 + k // 3) for k in range(0, 300, 3)]
    close = [(a, b) for a, b in copies if near_to(sets[a], sets[b])]
    assert len(close) > 50 and all(label[a] == label[b] for a, b in close)
    assert len(set(label[:300].tolist())) == 300


def test_rows_are_picked_where_they_lie(spark):
    numbers = [0, 1, 62, 63, 64, 127, 128, 700, (5 << 33) + 63, (5 << 33) + 64, (1 << 62) + 63]
    rows = spark.createDataFrame([(k, f"t{k}") for k in numbers], "row long, text string").repartition(3)
    for wanted in ([], numbers, [0, 63, 700, (5 << 33) + 63], [1, 2, 65, (1 << 62) + 63, (1 << 62) + 63]):
        table = spark.createDataFrame([(k,) for k in wanted], "row long")
        for most in (0, 100):
            got = near._among(rows, table, most)
            assert got.columns == ["row", "text"] and sorted(tuple(r) for r in got.collect()) == [(k, f"t{k}") for k in numbers if k in wanted]
    docs = spark.createDataFrame(list(enumerate(edited_corpus(2, 5))), "doc_id long, text string")
    assert "hashpartitioning" not in near.survivors(docs)._jdf.queryExecution().executedPlan().toString()


def test_odd_rows_and_repeated_ids(spark, odd, none):
    got = near.survivors(odd).collect()
    want, _ = plain_classes([r[1] for r in odd_rows()])
    best: dict = {}
    for r, c in zip(odd_rows(), want):
        best[c] = min(best.get(c, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(best.values())
    assert near.survivors(odd).columns == odd.columns and near.survivors(none).count() == 0
    rows = [(5, "a b c d e f g"), (3, "p q r s t u v"), (5, "p q r s t u v"), (None, "k l m n o p q"), (None, "k l m n o p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"][0] for r in near.survivors(docs).collect()) == ["a", "k", "p"]


def test_sets_are_made_in_slices():
    batch = pa.RecordBatch.from_pydict({"root": list(range(1200)), "node": list(range(1200)), "text": [f"a b c d e {k}" for k in range(1200)]})
    out = list(near._with_sets(5)(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= 512 and [k for b in out for k in b.column(1).to_pylist()] == list(range(1200))


def test_minima_estimate_similarity():
    a, b = np.arange(900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    spread = np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64)
    share = np.mean(near.minima(np.sort(spread[a])) == near.minima(np.sort(spread[b])))
    assert abs(share - 0.8) < 0.15
