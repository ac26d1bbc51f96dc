"""Corpus pipeline: quality rules, near-dedup, decontamination, PII and packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame; all but the last return the columns of ``documents``.
Null and repeated doc_ids, null or empty texts and empty tables are allowed; a
row without a doc_id cannot be named by a verdict of the near-dedup or
decontamination stage and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmflow.llm import decontam, minhash, packing, pii, quality_rules
from ohmflow.llm.queries import PII_KEY
from ohmflow.llm.store import stored
from ohmflow.sources.tables import table

NEAR_PERCENT = 80


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    bad = bad.select("doc_id").where("doc_id is not null").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id.
    Rows that repeat both doc_id and text are one document."""
    found = stored(minhash.near_duplicates(docs, percent=NEAR_PERCENT), "near")
    rest = _without(docs, found.where("not kept"))
    repeated = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    if repeated.isEmpty():
        return rest
    return (rest.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
            .unionByName(rest.where("doc_id is null")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    hits = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, hits.where("n_hit > 0"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced in the text and n_chars renewed."""
    out = pii.pseudonymise(docs, PII_KEY, counts=False)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(kind)))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("pii", pseudonyms), ("packing", pack)]

#: hashed likelihood ratios and best-fit packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
