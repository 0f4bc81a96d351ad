"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, langid, mixing, neighbours, ngram_lm, quality, sharding, simhash, toxicity, warc
from millrace.llm.common import Shared, id_mod, table


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_mod("doc_id", 5) == 1
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"), held_out).withColumn("held_out", held_out)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared.create(spark, "warc")
    names = warc.write(table(spark, sf_dir, "pages"), shared)
    return warc.read(spark, shared, names).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS h,
         min(page_id) OVER (PARTITION BY payload) AS least
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM d
"""


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), every=50)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.tokenizer_path())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    store = sharding.shard_arrivals(table(spark, sf_dir, "documents"), arrival)
    return store.read().withColumn("text_sha256", F.sha2(F.col("text"), 256)).select("doc_id", "lang", "source", "n_chars", "text_sha256")


OP4_SQL = """
SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).withColumn("held_out", id_mod("doc_id", 5) == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("held_out", id_mod("doc_id", 3) == 1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_lm": op1_lm, "op2_simhash": op2_simhash, "op3_quality": op3_quality, "op4_sharding": op4_sharding, "op5_mixing": op5_mixing, "op6_langid": op6_langid, "op7_toxicity": op7_toxicity, "op8_warc": op8_warc, "op9_neighbours": op9_neighbours, "op10_bpe": op10_bpe}


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": OP4_SQL, "op8_warc": OP8_SQL}
