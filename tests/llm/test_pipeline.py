"""The stages one after another against plain versions of each, on a small corpus."""

import os
import re

import pytest
from conftest import prose
from test_classifiers import junk
from test_near import plain_classes
from test_tokens import BYTE, check_layout, plain

import corpus_pipeline
from brookmill.llm import mixing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(k, junk(k) if k % 8 == 0 else prose(k // 2 * 2 if k % 9 == 1 else k, 30 + k % 80), "en", f"s{k % 3}") for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " tail", "en", "s0") for k in range(1, 40, 4)]
    rows = [(k, t, lang, s, len(t)) for k, t, lang, s in rows] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 8 != 0)) for k in range(0, 300, 2)], "doc_id long, quality int").withColumn("toxic", quality.F.lit(0)).write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, now, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        path = os.path.join(folder, name)
        out.write.parquet(path)
        before, now = now, spark.read.parquet(path)
        seen[name] = (before.collect(), now.collect())
        assert name == "pack" or now.columns == names
    before, after = seen["quality"]
    keep = {r["doc_id"] for r in quality.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("keep").collect()}
    assert {r["doc_id"] for r in after} == keep and {k for k in range(300) if k % 8} <= keep
    before, after = seen["exact_dedup"]
    least: dict = {}
    for r in before:
        norm = (r["text"] or "").encode().lower()
        least[norm] = min(least.get(norm, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())
    before, after = seen["near_dedup"]
    ids, (label, links) = [r["doc_id"] for r in before], plain_classes([r["text"] for r in before])
    least = {c: min(i for i, d in zip(ids, label) if d == c) for c in set(label)}
    assert links and sorted(r["doc_id"] for r in after) == sorted(least.values())
    before, after = seen["mix"]
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) < 0.03 * words(before)
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    _, pieces = seen["pack"]
    want = [(r["doc_id"], plain(BYTE, r["text"]) + [1]) for r in after]
    check_layout(pieces, want)
    assert sum(r["length"] for r in pieces) == sum(len(w) for _, w in want)


def test_run_equals_the_stages(spark, folder):
    def pieces(rows):
        return sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)

    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.mode("overwrite").parquet(os.path.join(folder, f"again-{name}"))
        now = spark.read.parquet(os.path.join(folder, f"again-{name}"))
    whole = lambda rows: sorted((d, sum(n for e, _, n, _, _ in rows if e == d), t) for d, t in {(e, t) for e, _, _, _, t in rows})
    assert whole(pieces(corpus_pipeline.run(spark, folder).collect())) == whole(pieces(now.collect()))


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_counts_words_as_the_plain_version_does(spark):
    texts = ["a b\tc", "", None, " x ", "é\u00a0ü z", "one\ntwo\x0bthree\x0cfour\rfive"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.word_count(mixing.text_or_empty()).alias("n")).collect()
    assert [r["n"] for r in got] == [len(re.findall("[^\\x20\\x09-\\x0D]+", t or "")) for t in texts]
