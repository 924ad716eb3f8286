import threading

import pytest
from pyspark.sql import functions as F

from brookmill.operators.latest import forward_only
from brookmill.schemas import _table
from brookmill.store import TableStore

EVENTS = _table("k string, day date, n int")


@pytest.fixture
def rows(spark):
    from datetime import date

    return lambda *r: spark.createDataFrame([(k, date(2026, 1, d), n) for k, d, n in r], EVENTS)


def got(store, version=None):
    return sorted((r["k"], r["day"].day, r["n"]) for r in store.read(version).collect())


def test_append_is_idempotent_and_versions_stay_readable(spark, tmp_path, rows):
    t = TableStore(spark, str(tmp_path / "t")).ensure(EVENTS, ["day"])
    assert t.read().count() == 0 and t.read().columns == EVENTS.names
    assert t.append(rows(("a", 1, 1)), txn=("app", 0)) == 1
    assert t.append(rows(("a", 1, 1)), txn=("app", 0)) is None
    t.append(rows(("b", 2, 2)), txn=("app", 1))
    assert got(t) == [("a", 1, 1), ("b", 2, 2)] and got(t, 1) == [("a", 1, 1)]
    assert [r["op"] for r in t.history().orderBy("version").collect()] == ["create", "append", "append"]


def test_insert_only_merge_and_compaction(spark, tmp_path, rows):
    t = TableStore(spark, str(tmp_path / "t")).ensure(EVENTS, ["day"])
    t.merge_insert_only(rows(("a", 1, 1), ("b", 1, 1)), ["day", "k"], prune="day")
    t.merge_insert_only(rows(("a", 1, 9), ("c", 2, 3)), ["day", "k"], prune="day")
    want = [("a", 1, 1), ("b", 1, 1), ("c", 2, 3)]
    assert got(t) == want
    before, after = t.compact(1, ["k"])
    assert after <= before and got(t) == want
    assert t.vacuum(retain_hours=0) >= 1 and got(t) == want
    with pytest.raises(FileNotFoundError):
        t.snapshot(99)


def test_upsert_replaces_only_touched_buckets(spark, tmp_path):
    schema = _table("id string, rk int, at timestamp, kept string")
    from datetime import datetime

    row = lambda *r: spark.createDataFrame([(i, k, datetime(2026, 1, d), v) for i, k, d, v in r], schema)
    rules = dict(rank="rk", event_time="at", follow=["rk"], latest=["at"], earliest=[], fill=["kept"])
    t = TableStore(spark, str(tmp_path / "t")).ensure(schema, buckets=4)
    t.upsert(row(*[(f"o{i}", 1, 1, None) for i in range(20)]), "id", txn=("a", 0), **rules)
    files = t.snapshot().files
    t.upsert(row(("o3", 2, 2, "x"), ("new", 1, 1, "y")), "id", txn=("a", 1), **rules)
    assert t.upsert(row(("o3", 9, 9, "z")), "id", txn=("a", 1), **rules) is None
    assert len(files & t.snapshot().files) >= 2
    by = {r["id"]: r for r in t.read().collect()}
    assert len(by) == 21 and (by["o3"]["rk"], by["o3"]["kept"]) == (2, "x")
    t.upsert(row(("o3", 1, 5, "later")), "id", **rules)
    r = t.read().where("id = 'o3'").first()
    assert (r["rk"], r["at"].day, r["kept"]) == (2, 5, "x")


def test_concurrent_appends_all_land(spark, tmp_path, rows):
    t = TableStore(spark, str(tmp_path / "t")).ensure(EVENTS)
    frames = [rows((f"k{i}", 1, i)) for i in range(4)]
    threads = [threading.Thread(target=TableStore(spark, t.root).append, args=(f,), kwargs={"txn": (f"w{i}", 0)}) for i, f in enumerate(frames)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(got(t)) == 4


def test_long_logs_are_summarised(spark, tmp_path, rows):
    t = TableStore(spark, str(tmp_path / "t")).ensure(EVENTS)
    snap = t.snapshot()
    for i in range(1, 23):
        t._commit(snap, "append", [f"data/f{i}"], [], txn=("a", i))
        snap = t.snapshot()
    assert len(snap.files) == 22 and snap.txns == {"a": 22} and "files" in t._entry(20)


def test_forward_only_ignores_null_sides(spark):
    a = spark.createDataFrame([("x", 1, 5)], "id string, rk int, at int")
    b = spark.createDataFrame([("x", 1, 4), ("y", 2, 1)], "id string, rk int, at int")
    out = forward_only(a, b, "id", rank="rk", event_time="at", follow=["rk"], latest=["at"], earliest=[], fill=[]).orderBy("id").collect()
    assert [tuple(r) for r in out] == [("x", 1, 5), ("y", 2, 1)]


def test_z_order_clusters_by_both_columns(spark, tmp_path):
    schema = _table("zone string, order_id string, n int")
    rows = [(f"z{i % 16:02d}", f"o{i * 7919 % 4096:04d}", i) for i in range(4096)]
    t = TableStore(spark, str(tmp_path / "t")).ensure(schema)
    t.append(spark.createDataFrame(rows, schema).repartition(8))
    t.compact(16, ["zone", "order_id"])
    assert sorted(map(tuple, t.read().collect())) == sorted(rows)
    spans = t.read().groupBy(F.input_file_name()).agg(F.countDistinct("zone"), F.count("*")).collect()
    assert len(spans) > 4 and max(r[1] for r in spans) < 16


def test_compaction_by_size_splits_a_large_partition(spark, tmp_path):
    schema = _table("day int, k string")
    rows = [(0 if i % 3 else i % 5, f"k{i * 7919}") for i in range(6000)]
    t = TableStore(spark, str(tmp_path / "t")).ensure(schema, ["day"])
    for part in range(3):
        t.append(spark.createDataFrame(rows[part::3], schema).repartition(4))
    before, after = t.compact(target_bytes=16 << 10)
    assert 5 < after < before and sorted(map(tuple, t.read().collect())) == sorted(rows)
    largest = t.read().where("day = 0").groupBy(F.input_file_name()).count().collect()
    assert len(largest) > 1
    assert t.compact() == (after, 5)
