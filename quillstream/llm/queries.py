"""Registered queries of the preparation problems, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm.batches import repeats
from quillstream.llm.boilerplate import boilerplate_lines, main_bodies
from quillstream.llm.mixing import mix_documents, shares
from quillstream.llm.packing import pack_all, waste
from quillstream.llm.pieces import long_items, pieces
from quillstream.llm.residue import clean_documents, found, residue_sentences
from quillstream.llm.sentences import sentence_ends, sentences
from quillstream.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and audio chunks above their limits, and whether a cut off any boundary is unavoidable."""
    return long_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "audio_chunks"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of those documents and audio chunks."""
    return pieces(table(spark, sf_dir, "documents"), table(spark, sf_dir, "audio_chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are or hold template residue, filler, error messages or notices that scripts are needed."""
    return found(table(spark, sf_dir, "documents"))


def p2_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences by which they do, with their kinds."""
    return residue_sentences(table(spark, sf_dir, "documents"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents free of them, whole."""
    return clean_documents(table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-blank lines of each page that do not belong to its main body."""
    return boilerplate_lines(table(spark, sf_dir, "article_pages"))


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of each page."""
    return main_bodies(table(spark, sf_dir, "article_pages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The announcements that bring nothing new, each with the earliest accepted one it repeats."""
    return repeats(table(spark, sf_dir, "arxiv_announcements"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each piece of one above the capacity, for the three container sizes."""
    return pack_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "size_limits"))


def p6_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, their lower bound and the space left unused, for the three container sizes."""
    return waste(table(spark, sf_dir, "documents"), table(spark, sf_dir, "size_limits"))


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn."""
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each source: aimed at, and reached."""
    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each sentence of each document."""
    return sentence_ends(table(spark, sf_dir, "documents"))


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences themselves with their places."""
    return sentences(table(spark, sf_dir, "documents"))


_LONG = r"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY fetched_at DESC) AS r FROM audio_chunks WHERE chunk_id IS NOT NULL)
  WHERE r = 1
)
SELECT 'document' AS item_kind, doc_id AS item_id,
  CASE WHEN list_max([length(x) FOR x IN regexp_split_to_array(text, '[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?…。！？।؟]')]) > 4000 THEN 'yes' ELSE 'no' END AS must_break
FROM documents WHERE length(text) > 4000
UNION ALL
SELECT 'audio_chunk', chunk_id,
  CASE WHEN coalesce(len(segments), 0) = 0 OR len([s FOR s IN segments IF round(s.end_s - s.start_s, 3) > 300]) > 0 THEN 'yes' ELSE 'no' END
FROM latest WHERE round(end_s - start_s, 3) > 300"""

QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_residues": p2_residues, "p2_clean": p2_clean, "p3_found": p3_found, "p3_bodies": p3_bodies, "p4_found": p4_found, "p6_packed": p6_packed, "p6_waste": p6_waste, "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p8_found": p8_found, "p8_sentences": p8_sentences}
SQL = {"p1_found": _LONG}
