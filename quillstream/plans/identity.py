"""Queries over content identity: fingerprints and keep-first dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.sources.tables import table


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each distinct text, with its first document and the number of documents that hold it."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return (
        docs.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
        .groupBy("sha256")
        .agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n_docs"))
    )


def op4_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document, by ``doc_id``, of each text; documents without a text share none and stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "id", "source", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    first = F.min(F.struct("doc_id", "id", "source")).alias("first")
    kept = docs.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(first).select("first.*")
    return kept.unionByName(docs.where(F.col("sha256").isNull()).drop("sha256"))


QUERIES = {"op3_fingerprints": op3_fingerprints, "op4_keep_first": op4_keep_first}
SQL = {
    "op3_fingerprints": """
SELECT sha256(text) AS sha256, min(doc_id) AS first_doc_id, count(*) AS n_docs
FROM documents WHERE text IS NOT NULL GROUP BY text""",
    "op4_keep_first": """
SELECT doc_id, id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents)
WHERE r = 1 OR text IS NULL""",
}
