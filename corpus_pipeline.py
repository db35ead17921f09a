"""A training corpus from `documents`: language, near-duplicates, benchmark passages, secrets, packed sequences.

Each stage takes what its predecessor kept, as a table with the columns of documents, and returns the like; the last one
returns packed pieces. Between stages the rows are written as Parquet in the shared folder and read again.

Edge cases: rows without text or without a letter go in the first stage. Decisions are made by row, by id and text, so that null
and repeated ids are judged like any others. Of linked documents the one of the smallest id stays, one without an id only where
none has one; of rows that repeat id and text, one. Texts may be of any length. An empty table gives empty results. Further
columns of documents, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, jaccard, language_id, packing, secrets
from fieldloom.llm.common import learnable, sent_if_few, staged, table

#: Near-duplicates share this many per cent of their runs of so many words; the query op6_jaccard has its own values.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _row_key(docs: DataFrame) -> F.Column:
    """A row's key, without nulls at the top: in the order of the ids, rows without one last."""
    return F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    """_row and text: what an operator sees, whatever else the rows hold."""
    return docs.select(_row_key(docs).alias("_row"), "text")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without those of `rows` (_row), which are sent to the texts where they are few."""
    held = docs.select(_row_key(docs).alias("_row"), F.struct(*docs.columns).alias("_doc"))
    return held.join(sent_if_few(staged(rows.select("_row").distinct(), "dropped")), "_row", "left_anti").select("_doc.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned as in the language query."""
    told = language_id.predict(_keyed(docs), language_id.fit(docs.where(learnable("doc_id", 5, 0))), key="_row")
    return _without(docs, told.where(F.col("lang_pred") == language_id.UND))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join, the document of the smallest id."""
    groups = staged(jaccard.join(_keyed(docs), "_row", percent=NEAR_PERCENT, n=NEAR_WORDS), "groups")
    kept = _without(docs, groups.where(F.col("component_id") != F.col("_row")))
    # of rows that are equal in id and text, all are first or none: only those need to be told apart
    again = staged(groups.where(F.col("component_id") == F.col("_row")).groupBy("_row").count().where("count > 1").select("_row"), "repeated")
    if again.isEmpty():  # the usual case, in which all texts are read once
        return kept
    again = sent_if_few(again)
    held = kept.select(_row_key(kept).alias("_row"), F.struct(*docs.columns).alias("_doc"))
    one = held.join(again, "_row", "left_semi").groupBy("_row").agg(F.first("_doc").alias("_doc"))
    return held.join(again, "_row", "left_anti").unionByName(one).select("_doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontaminate.decontaminate(_keyed(docs), table(spark, sf_dir, "benchmark"), key="_row")
    return _without(docs, found.where(F.col("n_hit") > 0))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs, secrets.fit(secrets.labelled_findings(spark))).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
