"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.llm import _common as c
from reportmill.llm import licenses, mixing, nearest, neardup, packing, sstable, substrings, syncmers, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place; it is installed on every machine alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    toxic = F.col("p_toxic") >= toxicity.THRESHOLD if chain.tells("toxic") else F.lit(False)
    return toxicity.score_toxicity(docs, chain).withColumn("toxic", toxic)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(table, table.where("vec_id % 50 = 0"))


def op4_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = _table(spark, sf_dir, "pages"), c.scratch(spark, "captures")
    index = warc.write_index(warc.write_archives(pages, folder), folder)
    return warc.lookup(index, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.transform("placed", lambda x: x["shard"]).alias("shards"), F.transform("placed", lambda x: x["shuffle_key"]).alias("shuffle_keys"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    shards = sstable.write_shards(docs, tokenizer_path("byte_bpe_50k.json"), c.scratch(spark, "token-shards"))
    return sstable.lookup_digests(shards, docs)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_runs(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_toxicity": op2_toxicity,
    "op3_nearest": op3_nearest,
    "op4_captures": op4_captures,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_mixing": op6_mixing,
    "op7_syncmers": op7_syncmers,
    "op8_token_shards": op8_token_shards,
    "op9_passages": op9_passages,
    "op10_packing": op10_packing,
}

SQL: dict[str, str] = {
    "op4_captures": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
             d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
             f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id IS NOT NULL AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
        FROM f
    """,
}
