"""The unlabelled side of co-training covers every document and each text once."""

from conftest import prose
from test_classifiers import junk

from brookmill.llm import quality


def test_rounds_choose_from_all_distinct_unlabelled_texts(spark, monkeypatch):
    rows = [(k, junk(k) if k % 3 == 0 else prose(k, 40), "en", "s") for k in range(60)]
    rows += [(1000 + k, prose(7777, 40), "en", "s") for k in range(200)]  # one text on most rows
    rows += [(2000 + k, junk(2000 + k) if k % 3 == 0 else prose(2000 + k, 40), "en", "s") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(60)], "doc_id long, quality int")
    seen, plain = [], quality._Stored.surest

    def surest(self, model, low, high, known):
        got = plain(self, model, low, high, known)
        seen.append((self.size, got))
        pool = sorted({(r[1], r[2], r[3]) for r in rows[60:]})
        z = quality._raw_views(model)(*zip(*pool))
        for giver in (0, 1):
            bad = sorted(v for v in z[giver] if v < -1)[:low]
            assert not known[1 - giver] and len(bad) == sum(g == giver and label == 0 for g, _, label, _ in got) or known[1 - giver]
            keys = [k for g, k, _, _ in got if g == giver]
            assert len(keys) == len(set(keys)) and not set(keys) & known[1 - giver]
        return got

    monkeypatch.setattr(quality._Stored, "surest", surest)
    model = quality.fitted(docs, labels, max_pool=20)
    assert model.handed and seen[0][0] == 20 and sum(len(got) for _, got in seen) > 0
    wide = quality._Stored(docs.where("doc_id >= 60").select("text", "lang", "source"), 10_000)
    assert wide.size == 61  # each text counts once
