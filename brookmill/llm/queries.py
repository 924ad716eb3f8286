"""Registered queries of the corpus operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmill.llm import exact_dedup, fingerprints, fixity, mixing, packing, pii, quality, simhash, token_store, toxicity
from brookmill.llm.common import documents, durable, new_folder


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write(documents(spark, sf_dir), new_folder(spark, "tokens"), vocabulary("word_bpe_49k.json"))
    return token_store.read(spark, store, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "position")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_ids=False)
    return packed.drop("ids")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(documents(spark, sf_dir), keep="largest")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{pii.KINDS[k]}") for k in range(pii.BASE)],
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return fixity.audit(durable(fixity.archived(pages)), durable(fixity.damaged_copy(pages)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("offending"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op7_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM n JOIN g USING (norm)""",
    "op9_warc_fixity": """
        WITH r AS (SELECT page_id, coalesce(CAST(floor(page_id / 1000) AS BIGINT), -1) AS file, substr(sha256(coalesce(url, '')), 1, 2) AS mark,
                          'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
                          || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
                          || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
                   FROM pages),
             h AS (SELECT page_id, file, mark, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest FROM r)
        SELECT page_id, file,
               CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
               length, digest, CASE WHEN mark <= '07' THEN 'damaged' WHEN mark <= '0f' THEN 'missing' ELSE 'intact' END AS status
        FROM h""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_quality, op3_fingerprints, op4_simhash, op5_token_store, op6_packing, op7_exact_dedup, op8_pii, op9_warc_fixity, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return SQL
