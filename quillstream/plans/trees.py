"""Queries over the item trees (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.hierarchy import hierarchy
from quillstream.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of each id; -1 on a cycle, -2 below one."""
    return hierarchy(table(spark, sf_dir, "hn_items").select("id", "kids", "fetched_at"))


def p5_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of descendants of each node in a tree, one less than its size; ``p5_counts`` has every id."""
    labels = hierarchy(table(spark, sf_dir, "hn_items").select("id", "kids", "fetched_at"), detail=True)
    return labels.where(F.col("depth") >= 0).select("id", "root_id", (F.col("size") - 1).alias("n_descendants"))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path of each node in compact form: the chains from the root down, each with the last place used.

    The members of a chain are the rows with its ``head``, by ``pos``; ``expand_paths`` writes the ids out.
    """
    labels = hierarchy(table(spark, sf_dir, "hn_items").select("id", "kids", "fetched_at"), detail=True)
    return labels.select("id", "root_id", "depth", "head", "pos", "segments")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of each node in compact form: those of its root with ``pre`` in ``(pre, pre + size)``.

    ``expand_descendants`` writes the pairs out.
    """
    labels = hierarchy(table(spark, sf_dir, "hn_items").select("id", "kids", "fetched_at"), detail=True)
    return labels.select("id", "root_id", "depth", "pre", "size")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of descendants of every id: below a cycle its own subtree, on a cycle all else with that root."""
    labels = hierarchy(table(spark, sf_dir, "hn_items").select("id", "kids", "fetched_at"), detail=True)
    return labels.select("id", "root_id", "depth", (F.col("size") - 1).alias("n_descendants"))


_LINKS = """
WITH RECURSIVE newest AS (
  SELECT id, kids FROM (SELECT id, kids, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, kids DESC) AS r FROM hn_items WHERE id IS NOT NULL)
  WHERE r = 1
), listed AS (SELECT unnest(kids) AS id, id AS parent FROM newest),
links AS (SELECT n.id, min(l.parent) AS parent FROM newest n LEFT JOIN listed l ON l.id = n.id GROUP BY n.id),
down AS (
  SELECT id, id AS root_id, 0::BIGINT AS depth FROM links WHERE parent IS NULL
  UNION ALL SELECT l.id, d.root_id, d.depth + 1 FROM down d JOIN links l ON l.parent = d.id
)"""

_FOUND = (
    _LINKS
    + """,
caught AS (SELECT l.id, l.parent FROM links l WHERE l.id NOT IN (SELECT id FROM down)),
reach AS (
  SELECT id, parent AS anc FROM caught
  UNION SELECT r.id, c.parent FROM reach r JOIN caught c ON c.id = r.anc
),
ring AS (SELECT id FROM reach WHERE id = anc),
ring_root AS (SELECT r.id, min(r.anc) AS root_id FROM reach r WHERE r.anc IN (SELECT id FROM ring) GROUP BY r.id)
SELECT id, root_id, depth FROM down
UNION ALL
SELECT id, root_id, CASE WHEN id IN (SELECT id FROM ring) THEN -1 ELSE -2 END::BIGINT AS depth FROM ring_root"""
)

_SUBTREES = (
    _LINKS
    + """,
up AS (
  SELECT d.id, l.parent AS anc FROM down d JOIN links l ON l.id = d.id WHERE l.parent IS NOT NULL
  UNION ALL SELECT u.id, l.parent FROM up u JOIN links l ON l.id = u.anc WHERE l.parent IS NOT NULL
)
SELECT d.id, d.root_id, coalesce(c.n, 0)::BIGINT AS n_descendants
FROM down d LEFT JOIN (SELECT anc, count(*) AS n FROM up GROUP BY anc) c ON c.anc = d.id"""
)

_COUNTS = (
    _FOUND.partition("\nSELECT id, root_id, depth FROM down")[0]
    + """,
found AS (
  SELECT id, root_id, depth FROM down
  UNION ALL
  SELECT id, root_id, CASE WHEN id IN (SELECT id FROM ring) THEN -1 ELSE -2 END::BIGINT AS depth FROM ring_root
),
up AS (
  SELECT d.id, l.parent AS anc FROM down d JOIN links l ON l.id = d.id WHERE l.parent IS NOT NULL
  UNION ALL SELECT u.id, l.parent FROM up u JOIN links l ON l.id = u.anc WHERE l.parent IS NOT NULL
),
above AS (SELECT id, anc FROM up UNION ALL SELECT id, anc FROM reach WHERE id <> anc)
SELECT f.id, f.root_id, f.depth, coalesce(c.n, 0)::BIGINT AS n_descendants
FROM found f LEFT JOIN (SELECT anc, count(*) AS n FROM above GROUP BY anc) c ON c.anc = f.id"""
)

QUERIES = {"p5_found": p5_found, "p5_subtrees": p5_subtrees, "p5_paths": p5_paths, "p5_descendants": p5_descendants, "p5_counts": p5_counts}
SQL = {"p5_found": _FOUND, "p5_subtrees": _SUBTREES, "p5_counts": _COUNTS}
