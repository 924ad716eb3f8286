import hashlib

from pyspark.sql import functions as F

from brookmill.llm import fixity


def pages(spark, n=400):
    rows = [(k, f"http://h{k % 7}/é{k}", "<p>" + "x" * (k * 37 % 900) + "</p>", "clash") for k in range(n)]
    rows += [(None, None, None, None), (5, "http://h5/é5", "twin", "clash"), (5, "http://h5/é5", "twin", "clash")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4)


def record(url, html):
    body = (html or "").encode()
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: " + (url or "").encode() + b"\r\nContent-Type: text/html\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_records_lie_end_to_end(spark):
    got = fixity.archived(pages(spark), per_file=50).collect()
    files: dict = {}
    for r in got:
        files.setdefault(r["file"], []).append(r)
    assert len(got) == 403 and len(files) == 9
    for parts in files.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    want = sorted(hashlib.sha256(record(r["url"], r["html"])).hexdigest() for r in pages(spark).collect())
    assert sorted(r["digest"] for r in got) == want


def test_damage_is_found_and_nothing_else(spark):
    whole = fixity.archived(pages(spark, 3000), per_file=2000).persist()
    bad = whole.where("page_id % 211 != 3").withColumn("digest", F.when(F.col("page_id") % 307 == 1, "other").otherwise(F.col("digest")))
    extra = spark.createDataFrame([(9, 77, 12345678, 10, "new")], whole.schema)
    found = {(r["file"], r["offset"]): r["status"] for r in fixity.mismatches(whole, bad.unionByName(extra)).collect()}
    want = {(77, 12345678): "added"}
    for r in whole.collect():
        k = r["page_id"]
        if k is None or k % 211 == 3:  # the filter drops a null id too
            want[r["file"], r["offset"]] = "missing"
        elif k % 307 == 1:
            want[r["file"], r["offset"]] = "damaged"
    assert found == want
    assert fixity.height_for(whole) >= 1
    verdicts = fixity.audit(whole, bad).groupBy("status").count().collect()
    assert sum(r["count"] for r in verdicts) == whole.count()


def test_equal_and_empty_replicas(spark):
    whole = fixity.archived(pages(spark, 60))
    assert fixity.mismatches(whole, whole).count() == 0
    none = fixity.archived(pages(spark, 60).where("false"))
    assert fixity.mismatches(none, none).count() == 0 and fixity.audit(none, whole).count() == 0
    assert {r["status"] for r in fixity.mismatches(whole, none).collect()} == {"missing"}
    drill = fixity.damaged_copy(pages(spark, 400))
    assert 0 < 403 - drill.count() < 60
