import hashlib
import random

from conftest import odd_rows, prose
from pyspark.sql import functions as F

from brookmill.llm import fingerprints as fp


def test_edited_texts_of_odd_rows(odd, none):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = fp.edited(odd).collect()
    assert len(got) == len(rows)
    want = []
    for k, r in enumerate(rows):
        text, following = r[1] or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        want.append((r[0], len(text), hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest()))
    assert sorted(map(str, [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got])) == sorted(map(str, want))
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert {len(r["fingerprint"]) for r in got} == {8 * 8 + 16 * 21 + 8}
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[1] == by[3] and by[4] == by[5] and len({by[k] for k in (1, 2, 4, 6, 7, 8)}) == 6
    assert fp.edited(none).count() == 0


def lanes(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return fp.fingerprinted(df, F.col("text"), "lanes").orderBy("id")


def test_order_is_free_and_deletion_and_insertion_are_exact(spark):
    parts = [f"line {k} with words\n" for k in range(40)]
    mixed = parts[:]
    random.Random(1).shuffle(mixed)
    rows = [r["lanes"] for r in lanes(spark, "".join(parts), "".join(mixed), "".join(parts[:30]), "".join(parts[30:])).collect()]
    assert rows[0] == rows[1] != rows[2]
    df = spark.createDataFrame([tuple(rows)], "a array<long>, b array<long>, c array<long>, d array<long>")
    out = df.select(fp.add(F.col("c"), F.col("d")).alias("sum"), fp.subtract(F.col("a"), F.col("d")).alias("rest"), fp.likeness(F.col("a"), F.col("b")).alias("one")).first()
    assert out["sum"] == rows[0] and out["rest"] == rows[2] and out["one"] == 1.0
    grouped = fp.combine(lanes(spark, "".join(parts[:30]), "".join(parts[30:])).withColumn("g", F.lit(1)), "g").first()
    assert grouped["lanes"] == rows[0]


def test_pieces_lose_nothing_and_likeness_follows_overlap(spark):
    text = prose(9, 900)
    df = spark.createDataFrame([(text,)], "t string")
    assert "".join(df.select(fp.paragraphs(F.col("t"))).first()[0]) == text
    parts = [f"{k} some words here.\n" for k in range(200)]
    other = [f"{k} different words there.\n" for k in range(200)]
    rows = [r["lanes"] for r in lanes(spark, *["".join(parts[:n] + other[n:]) for n in (200, 150, 100, 0)]).collect()]
    near = [spark.createDataFrame([(rows[0], r)], "a array<long>, b array<long>").select(fp.likeness(F.col("a"), F.col("b"))).first()[0] for r in rows]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3] and abs(near[1] - 0.75) < 0.15 and near[3] < 0.35


def test_successors_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        ids = random.Random(3).sample(range(10**12), 500)
        df = spark.createDataFrame([(i, str(i)) for i in ids], "k long, t string").repartition(6)
        got = {r["k"]: r["n"] for r in fp.with_next(df, "k", "t", {"t": "n"}).collect()}
        order = sorted(ids)
        assert got == {a: str(b) for a, b in zip(order, order[1:] + order[:1])}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_successors_where_one_id_holds_a_third(spark):
    rows = [(k, f"t{k}") for k in range(400)] + [(57, f"again {j}") for j in range(200)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(4)
    cuts = fp._cuts(df.select(F.col("k").alias("_key"), F.xxhash64("t").alias("_tie")), 20)
    assert sum(k == 57 for k, _ in cuts) >= 5 and cuts[0] == (0, fp.LEAST)
    order = [r["t"] for r in df.orderBy("k", F.xxhash64("t")).collect()]
    got = {r["t"]: r["n"] for r in fp.with_next(df, "k", "t", {"t": "n"}).collect()}
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_a_paragraph_repeated_past_sixteen_bits(spark):
    rows = [r["lanes"] for r in lanes(spark, "\n" * 65_536, "\n" * 49_152).collect()]
    df = spark.createDataFrame([tuple(rows)], "a array<long>, b array<long>")
    near = df.select(fp.likeness(F.col("a"), F.col("b"))).first()[0]
    assert abs(near - (1 - 16_384**2 / (65_536**2 + 49_152**2))) < 0.01
