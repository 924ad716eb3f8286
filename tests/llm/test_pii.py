import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from conftest import odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from brookmill.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15)[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab.@@-+0112345 ()é%_4")), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_known_cases():
    cards = "4111 1111 1111 1111 and 4111-1111-1111-1112 and 5500005555555559"
    assert pii.base_spans(cards) == plain(cards) and [k for k, _, _ in pii.base_spans(cards)].count(2) == 2
    assert pii.base_spans("1" * 5000 + ".1.1.1") == plain("1.1.1.1" * 0)
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")
    for kind, ballot, base in ((0, [1, -1, 0, 1, 1, -1], True), (6, [0, 0, 0, 0, 0, 0], False)):
        assert pii.read_code(pii.pattern_code(kind, ballot, base)) == (kind, ballot, base)


def plain_reliability(kinds, ballots, counts, rounds=40):
    """Expectation-maximisation, one vote at a time."""
    q = [min(0.95, max(0.05, 0.5 + 0.15 * sum(b))) for b in ballots]
    for _ in range(rounds):
        right = {}
        for t in (0, 1):
            for j in range(pii.LABELERS):
                good = voted = 0.0
                for p, b, n in zip(q, ballots, counts):
                    w = n * (p if t else 1 - p)
                    voted += w * (b[j] != 0)
                    good += w * (b[j] == (1 if t else -1))
                right[t, j] = min(0.99, max(0.5, (good + 4) / (voted + 6)))
        prior = {k: min(0.75, max(0.05, (sum(p * n for p, n, x in zip(q, counts, kinds) if x == k) + 2) / (sum(n for n, x in zip(counts, kinds) if x == k) + 4))) for k in range(len(pii.KINDS))}
        q = []
        for b, k in zip(ballots, kinds):
            real, other = prior[k], 1 - prior[k]
            for j, v in enumerate(b):
                real *= {1: right[1, j], -1: 1 - right[1, j], 0: 1.0}[v]
                other *= {1: 1 - right[0, j], -1: right[0, j], 0: 1.0}[v]
            q.append(real / (real + other))
    return right, prior, q


def test_expectation_maximisation_equals_the_plain_one():
    r = np.random.default_rng(3)
    kinds, ballots, counts = r.integers(0, 7, 60), r.integers(-1, 2, (60, pii.LABELERS)), r.integers(1, 200, 60).astype(float)
    model = pii.Reliability(kinds, ballots, counts)
    right, prior, q = plain_reliability(kinds.tolist(), ballots.tolist(), counts.tolist())
    assert np.allclose(model.right, [[right[t, j] for j in range(pii.LABELERS)] for t in (0, 1)])
    assert np.allclose(model.prior, [prior[k] for k in range(7)]) and np.allclose(model.likely(kinds, ballots), q)


def test_reliable_labelers_are_told_from_noise():
    r = np.random.default_rng(1)
    truth = r.random(3000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.5, 0.5])
    ballots = np.where(r.random((3000, 6)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    ballots[r.random((3000, 6)) < 0.3] = 0
    model = pii.Reliability(np.zeros(3000, int), ballots, np.ones(3000))
    assert np.abs(model.right.mean(axis=0) - right).max() < 0.06
    assert np.mean((model.likely(np.zeros(3000, int), ballots) > 0.5) == truth) > 0.93


HEX = "0cab398dc11d1a2a11dc6572c8df8bd228c864f3"


def test_classifier_keeps_cued_secrets_and_rejects_bare_hashes(spark):
    shown = {k: hashlib.sha1(str(k).encode()).hexdigest() for k in range(120)}
    rows = [(k, f'{prose(k, 20)} token = "{shown[k]}" {prose(k, 9)}') for k in range(60)]
    rows += [(k, f"{prose(k, 12)} commit {shown[k]} {prose(k, 5)}") for k in range(60, 64)] + [(k, f"md5 {shown[k][:32]}\n") for k in range(64, 68)]
    rows += [(200, f"{prose(1, 9)} {HEX} {prose(2, 9)}"), (201, f"commit {HEX}\n"), (202, f"checksum {HEX} of the file"), (203, f"{HEX[:32]}  notes.txt"), (204, f'api_key = "{HEX}"'), (205, f"secret: {HEX}")]
    rows += [(300, "joe at example dot com is my mail"), (301, "SSN 078-05-1120 of record"), (302, "part 078-05-1120 in stock")] + [(400 + k, f"write me: joe.{k}@mail{k}.example.com") for k in range(40)]
    found = {r["doc_id"]: r["spans"] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = {k for k, spans in found.items() if any(s["kind"] == 6 for s in spans)}
    assert set(range(60)) <= kept and {204, 205} <= kept
    assert not kept & {*range(60, 68), 200, 201, 202, 203}
    assert [(s["kind"], s["start"], s["end"]) for s in found[204]] == [(6, 11, 51)]


def test_spans_beyond_the_base_ones_over_the_small_table(spark):
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(str(path))
    cued = {r["doc_id"] for r in docs.where(docs["text"].rlike('token = "[0-9a-f]{40}"')).collect()}
    added = {r["doc_id"] for r in pii.detect(docs).collect() if any(not s["base"] for s in r["spans"])}
    assert cued and len(cued & added) >= 0.9 * len(cued)


def test_detection_over_odd_rows(spark, odd, none):
    got = pii.detect(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows())
    assert pii.detect(none).count() == 0
    secret = "0cab398dc11d1a2a11dc6572c8df8bd228c864f3"
    rows = [(k, f"Mail joe.{k}@mail{k}.example.com or call +1 (988) 555-2{k:03d}.\nAPI token = \"{secret}\" end") for k in range(50)] + [(99, None), (100, "é 10.0.0.1 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in pii.detect(df).collect()}
    assert all(found[k] == plain(t or "") for k, t in rows)
    text = {r["doc_id"]: r["w"] for r in pii.detect(df).select("doc_id", pii.written(pii.F.col("spans")).alias("w")).collect()}
    start = rows[7][1].index(secret)
    assert text[7].endswith(f"secret:{start}:{start + 40}") and text[7].startswith("email:5:") and text[99] == "" and text[100] == "ip:2:10"
