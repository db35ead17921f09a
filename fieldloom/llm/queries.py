"""The registered queries opN_<name> of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from secrets import token_bytes

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import audit, collocation, decontaminate, jaccard, language_id, neardup, packing, pii, quality, secrets, topk, toxicity, warc
from fieldloom.llm.common import held_out, learnable, table
from fieldloom.llm.oracles import ORACLE_SQL


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@cache
def _fresh_key() -> bytes:
    return token_bytes(32)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is that of the session's setting spark.fieldloom.pseudonym.key (hexadecimal), or else a fresh one for this driver."""
    named = spark.conf.get("spark.fieldloom.pseudonym.key", "")
    found = pii.replace(table(spark, sf_dir, "documents"), bytes.fromhex(named) if named else _fresh_key())
    return found.select("doc_id", "text", F.size("findings").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["kind"]))), ",").alias("kinds"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_findings(spark)))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out, known = held_out("doc_id", 3, 1), learnable("doc_id", 3, 1)
    model = quality.fit(docs.where(known), labels.where(known))
    return quality.predict(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out, known = held_out("doc_id", 4, 2), learnable("doc_id", 4, 2)
    model = toxicity.fit(docs.where(known), labels.where(known))
    return toxicity.predict(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, known = held_out("doc_id", 5, 0), learnable("doc_id", 5, 0)
    model = language_id.fit(docs.where(known))
    return language_id.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_topk": op3_topk,
    "op4_decontaminate": op4_decontaminate,
    "op5_secrets": op5_secrets,
    "op6_jaccard": op6_jaccard,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_collocations": op11_collocations,
    "op12_near_vectors": op12_near_vectors,
    "op13_filter_audit": op13_filter_audit,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
