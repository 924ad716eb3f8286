import itertools
import zlib

import numpy as np
import pytest
from conftest import odd_rows, prose

from brookmill.llm import quality, toxicity


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    chain = (1.2, 0.4, 0.7, 2.0)
    lengths = [5, 0, 1, 3]
    e = np.exp(r.normal(size=sum(lengths)))
    p, joint, at = toxicity.marginals(e, np.array(lengths), chain, pairs=True)
    want, pairs, start = [], np.zeros(4), 0
    for n in lengths:
        own, total, mass, both = e[start : start + n], 0.0, np.zeros(n), np.zeros(4)
        for tags in itertools.product((0, 1), repeat=n):
            w = np.prod([own[i] for i in range(n) if tags[i]]) * np.prod([chain[2 * a + b] for a, b in zip(tags, tags[1:])])
            total += w
            mass += w * np.array(tags, float)
            for a, b in zip(tags, tags[1:]):
                both[2 * a + b] += w
        want += list(mass / total)
        pairs += both / total
        start += n
    assert np.allclose(p, want) and np.allclose(joint, pairs) and len(at) == 4 + 2


BAD = "vermin filth wretch".split()


def toxic_corpus(n=600):
    rows = []
    for k in range(n):
        text, bad = prose(k, 40), k % 5 == 0
        if bad:
            words = text.split(" ")
            for j in range(3):
                words.insert(7 * j + 3, BAD[(k // 5 + j) % 3] + ",")
            text = " ".join(words)
        rows.append((k, text, int(bad)))
    return rows


def test_toxicity_on_held_out_documents(spark, odd, none):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [(k, t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(got[k]["score"] >= 0.3) == y for k, _, y in held]) > 0.97
    for k, t, y in held:
        spans = [t[s["start"] : s["end"]] for s in got[k]["spans"]]
        assert not y or set(spans) & set(BAD)
    # held-out labels, language and source don't matter
    other = spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, _, y in rows], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, other).collect()}
    assert again == {k: r["score"] for k, r in got.items()}
    assert len(toxicity.score(odd, labels).collect()) == len(odd_rows())
    assert toxicity.score(none, labels).count() == 0
    assert {r["score"] for r in toxicity.score(odd, labels.where("false")).collect()} == {0.0}


def junk(k):
    return "".join(w.upper() + "!! " for w in prose(k, 50).split()) if k % 2 else " | ".join(prose(k, 50).split()) + " |"


@pytest.fixture(scope="module")
def graded(spark):
    rows = [(k, junk(k) if k % 6 == 0 or k % 6 == 3 else prose(k, 20 + k % 60), "en", f"s{k % 3}", k % 6 not in (0, 3)) for k in range(900)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string").repartition(3).persist()
    labels = spark.createDataFrame([(r[0], int(r[4])) for r in rows if r[0] < 300], "doc_id long, quality int")
    return rows, docs, labels


def test_quality_on_held_out_documents(spark, graded, odd, none):
    rows, docs, labels = graded
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert len(got) == len(rows)
    rest = [r for r in rows if r[0] >= 300]
    assert all(got[k]["keep"] for k, _, _, _, good in rest if good)
    assert np.mean([not got[k]["keep"] for k, _, _, _, good in rest if not good]) > 0.9
    kept = quality.survivors(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["keep"]}
    assert quality.score(odd, labels).count() == len(odd_rows())
    out = quality.survivors(odd, labels)
    assert out.columns == odd.columns and 0 < out.count() <= len(odd_rows())
    assert quality.score(none, labels).count() == quality.survivors(none, labels).count() == 0
    assert quality.survivors(odd, labels.where("false")).count() == len(odd_rows())


def test_views_teach_each_other():
    rows = [(junk(k) if k % 3 == 0 else prose(k, 60), "en", "s", int(k % 3 != 0)) for k in range(60)]
    pool = [(junk(k) if k % 3 == 0 else prose(k, 60), "en", "s") for k in range(1000, 1300)]
    model = quality.train(rows, pool)
    assert model.handed and model.handed[0] > 0
    assert quality.train([], []).words is None and quality.train(rows[:1], []).base == float(rows[0][3])
