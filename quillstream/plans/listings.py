"""Queries over listings, versions, discussion trees and recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.sources.tables import table

#: Items of a listing, rows scanned for it, and the bounds of a discussion (these are the features themselves).
LIMIT, SCAN = 10, 3
TOP_LEVEL, DEPTH, COMMENTS = 30, 2, 100
CHUNK_S, OVERLAP_S = 300.0, 2.0
#: Languages of a transcript, best first.
LANGUAGES = ("en", "de", "fr", "es")
GAP_S = 5.0

_PAPER = r"(?i)(\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v(\d+))?"


def latest_items(items: DataFrame) -> DataFrame:
    """The newest fetch of each id."""
    columns = [c for c in items.columns if c != "id"]
    newest = items.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("fetched_at", "time_s")).alias("row"))
    return newest.select("id", *[F.col(f"row.{c}").alias(c) for c in columns])


def take_first(rows: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their ``position``, and ``truncated`` where the group has more.

    Ranks are cut off at ``limit + 1`` before and after the shuffle (group limit), so no group is gathered whole.
    """
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("position") <= limit + 1)
    more = F.max(F.col("position") > limit).over(Window.partitionBy(group))
    return ranked.withColumn("truncated", more).where(F.col("position") <= limit)


def op5_latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each paper, and the latest announcement of that."""
    rows = table(spark, sf_dir, "arxiv_announcements")
    version = F.coalesce(F.nullif(F.regexp_extract("id", _PAPER, 2), F.lit("")), F.nullif(F.regexp_extract("version", r"(\d+)", 1), F.lit("")), F.lit("1")).cast("int")
    rows = rows.select(F.lower(F.regexp_extract("id", _PAPER, 1)).alias("paper"), version.alias("version"), "ann_id").where("paper <> ''")
    return rows.groupBy("paper").agg(F.max(F.struct("version", "ann_id")).alias("m"), F.count_distinct("version").alias("versions")).select("paper", "m.version", "m.ann_id", "versions")


def op6_newest_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest papers of each feed, latest first, revisions skipped, at most ``LIMIT``, and whether there are more."""
    rows = table(spark, sf_dir, "arxiv_announcements").where("announce_type IN ('new', 'cross')").select("feed", "ann_id", "received_at")
    return take_first(rows, "feed", [F.desc("received_at"), F.desc("ann_id")], LIMIT).select("feed", "position", "ann_id", "truncated")


def op7_newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents of each source, undated ones last in their order, and whether there are more."""
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "doc_id", T.iso_time(F.col("published_at")).alias("published"))
    return take_first(rows, "source", [F.desc_nulls_last("published"), F.asc("doc_id")], LIMIT).select("source", "position", "doc_id", "published", "truncated")


def op8_ranked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listable posts of each type by score: at most ``SCAN`` x ``LIMIT`` are looked at, at most ``LIMIT`` listed."""
    items = latest_items(table(spark, sf_dir, "hn_items").select("id", "item_type", "title", "score", "deleted", "dead", "time_s", "fetched_at"))
    posts = items.where("item_type IN ('story', 'job', 'poll')")
    looked = take_first(posts, "item_type", [F.desc_nulls_last("score"), F.asc("id")], SCAN * LIMIT).drop("truncated")
    usable = ~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False)) & F.col("title").isNotNull()
    return take_first(looked.where(usable).drop("position"), "item_type", [F.desc_nulls_last("score"), F.asc("id")], LIMIT).select("item_type", "position", "id", "score", "truncated")


def op9_discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments shown of each post: bounded at the top level, in depth and in all; unusable ones use up the bound.

    One join for each of the ``DEPTH`` levels; the bounds keep every post's part small.
    """
    items = latest_items(table(spark, sf_dir, "hn_items").select("id", "item_type", "kids", "by_user", "deleted", "dead", "time_s", "fetched_at"))
    usable = F.col("id").isNotNull() & ~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False))
    posts = items.where("item_type IN ('story', 'job', 'poll')").where(usable)
    level = posts.select(F.col("id").alias("post"), F.posexplode(F.slice("kids", 1, TOP_LEVEL)).alias("at", "kid"), F.array().cast("array<int>").alias("path"), F.lit(COMMENTS).alias("left"))
    out = None
    for depth in range(1, DEPTH + 1):
        level = level.withColumn("path", F.concat("path", F.array("at")))
        order = Window.partitionBy("post").orderBy("path")
        wanted = level.withColumn("n", F.row_number().over(order)).where("n <= left")
        wanted = wanted.withColumn("left", F.col("left") - F.count("*").over(Window.partitionBy("post")))
        shown = wanted.join(items.where(usable & (F.col("item_type") == "comment")).select(F.col("id").alias("kid"), "by_user", "kids"), "kid")
        rows = shown.select("post", F.lit(depth).alias("depth"), "kid", F.coalesce("by_user", F.lit("unknown")).alias("author"), F.array_join(F.transform("path", lambda p: F.lpad(p.cast("string"), 5, "0")), ".").alias("place"))
        out = rows if out is None else out.unionByName(rows)
        level = shown.select("post", F.posexplode("kids").alias("at", "kid"), "path", "left").select("post", "at", "kid", "path", "left")
    return out


def op10_best_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each collection in the best language: the exact code, else a variant of it, in the order of ``LANGUAGES``."""
    rows = table(spark, sf_dir, "documents").where("collection_id IS NOT NULL AND lang IS NOT NULL").select("collection_id", "doc_id", "lang")
    tier = F.lit(None).cast("int")
    for i, code in reversed(list(enumerate(LANGUAGES))):
        tier = F.when(F.col("lang") == code, F.lit(2 * i)).when(F.lower("lang").startswith(code), F.lit(2 * i + 1)).otherwise(tier)
    picked = rows.withColumn("tier", F.coalesce(tier, F.lit(99))).groupBy("collection_id").agg(F.min(F.struct("tier", "doc_id", "lang")).alias("m"))
    return picked.select("collection_id", "m.doc_id", "m.lang", "m.tier")


def _latest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "audio_chunks").where("chunk_id IS NOT NULL")
    newest = chunks.groupBy("chunk_id").agg(F.max_by(F.struct("media_id", "chunk_no", "start_s", "end_s", "segments", "text"), "fetched_at").alias("c"))
    return newest.select("chunk_id", "c.*")


def op11_chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlapping ranges that each recording is cut into for transcription, the last one ending with it."""
    media = table(spark, sf_dir, "audio_chunks").groupBy("media_id").agg(F.max("end_s").alias("duration")).where("duration > 0")
    step = CHUNK_S - OVERLAP_S
    last = F.greatest(F.ceil((F.col("duration") - CHUNK_S) / step), F.lit(0)).cast("int")
    ranges = media.select("media_id", "duration", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    start = F.col("chunk_no") * step
    return ranges.select("media_id", "chunk_no", F.round(start, 3).alias("start_s"), F.round(F.least(start + CHUNK_S, "duration"), 3).alias("end_s"))


def op12_merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each recording on its own clock, without what the next chunk covers again."""
    chunks = _latest_chunks(spark, sf_dir)
    following = F.lead("start_s").over(Window.partitionBy("media_id").orderBy("chunk_no", "chunk_id"))
    said = chunks.withColumn("next_s", following).select("media_id", "chunk_no", "start_s", "next_s", F.posexplode("segments").alias("position", "s"))
    start = F.round(F.col("s.start_s") + F.col("start_s"), 3)
    end = F.round(F.least(F.col("s.end_s") + F.col("start_s"), F.coalesce("next_s", F.lit(float("inf")))), 3)
    return said.select("media_id", "chunk_no", "position", start.alias("from_s"), end.alias("to_s"), F.col("s.text").alias("text"), "next_s").where(
        "(next_s IS NULL OR from_s < next_s) AND to_s > from_s"
    ).drop("next_s")


def op13_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines that at least half of a site's pages (three at least) share, digits aside."""
    pages = table(spark, sf_dir, "article_pages").where("text IS NOT NULL AND site IS NOT NULL")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ends = pages.select("site", "page_id", F.array_distinct(F.array(F.get(lines, 0), F.get(lines, F.size(lines) - 1))).alias("ends"))
    keys = ends.select("site", "page_id", F.explode("ends").alias("line")).where("line IS NOT NULL").select("site", "page_id", F.lower(F.regexp_replace("line", r"[0-9]+", "#")).alias("key"))
    counts = keys.distinct().groupBy("site", "key").agg(F.count("*").alias("n"))
    sizes = pages.groupBy("site").agg(F.count_distinct("page_id").alias("pages")).where("pages >= 3")
    return counts.join(sizes, "site").where("n * 2 >= pages").select("site", "key", "n", "pages")


def op14_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of segments with pauses below ``GAP_S``: one paragraph each, within a chunk."""
    said = _latest_chunks(spark, sf_dir).select("chunk_id", F.posexplode("segments").alias("at", "s")).select("chunk_id", "at", F.col("s.start_s").alias("a"), F.col("s.end_s").alias("b"))
    order = Window.partitionBy("chunk_id").orderBy("a", "b", "at")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.round(F.col("a") - before, 3) >= GAP_S), 1).otherwise(0)
    numbered = said.withColumn("new", new).withColumn("paragraph", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("chunk_id", "paragraph").agg(F.count("*").alias("segments"), F.round(F.min("a"), 3).alias("start_s"), F.round(F.max("b"), 3).alias("end_s"))


def op24_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by kind, from type and title, with the time of the newest as UTC text."""
    items = latest_items(table(spark, sf_dir, "hn_items").select("id", "item_type", "title", "time_s", "fetched_at")).where("item_type IN ('story', 'job', 'poll')")
    head = F.lower(F.ltrim(F.coalesce("title", F.lit(""))))
    kind = F.when(F.col("item_type").isin("job", "poll"), F.col("item_type")).when(head.startswith("ask hn:"), "ask").when(head.startswith("show hn:"), "show").otherwise("story")
    newest = F.date_format(F.timestamp_seconds(F.max("time_s")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return items.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), newest.alias("newest"))


QUERIES = {
    f.__name__: f
    for f in (op5_latest_versions, op6_newest_papers, op7_newest_documents, op8_ranked_scan, op9_discussions, op10_best_language, op11_chunk_ranges, op12_merged_segments, op13_running_lines, op14_paragraphs, op24_kinds)
}

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, time_s DESC) AS r_ FROM hn_items WHERE id IS NOT NULL) WHERE r_ = 1"
_CHUNKS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY fetched_at DESC) AS r_ FROM audio_chunks WHERE chunk_id IS NOT NULL) WHERE r_ = 1"
_USABLE = "NOT coalesce(deleted, false) AND NOT coalesce(dead, false)"

SQL = {
    "op5_latest_versions": r"""
WITH v AS (SELECT lower(regexp_extract(id, '(?i)([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[a-z]{2})?/[0-9]{7})', 1)) AS paper,
  coalesce(nullif(regexp_extract(id, '(?i)(?:[0-9]{4}\.[0-9]{4,5}|/[0-9]{7})v([0-9]+)', 1), ''), nullif(regexp_extract(version, '([0-9]+)', 1), ''), '1')::INT AS version, ann_id FROM arxiv_announcements)
SELECT paper, version, ann_id, versions FROM (
  SELECT *, count(DISTINCT version) OVER (PARTITION BY paper) AS versions, row_number() OVER (PARTITION BY paper ORDER BY version DESC, ann_id DESC) AS r FROM v WHERE paper <> '') WHERE r = 1""",
    "op6_newest_papers": f"""
SELECT feed, r::INT AS position, ann_id, n > {LIMIT} AS truncated FROM (
  SELECT feed, ann_id, row_number() OVER (PARTITION BY feed ORDER BY received_at DESC, ann_id DESC) AS r, count(*) OVER (PARTITION BY feed) AS n
  FROM arxiv_announcements WHERE announce_type IN ('new', 'cross')) WHERE r <= {LIMIT}""",
    "op7_newest_documents": f"""
WITH d AS (SELECT source, doc_id, coalesce(try_strptime(published_at, '%Y-%m-%dT%H:%M:%S.%gZ'), try_strptime(published_at, '%Y-%m-%d'), try_strptime(published_at, '%Y-%m'), try_strptime(published_at, '%Y'),
  try_strptime(published_at, '%d %b %Y')) AS published FROM documents WHERE source IS NOT NULL)
SELECT source, r::INT AS position, doc_id, published, n > {LIMIT} AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM d) WHERE r <= {LIMIT}""",
    "op8_ranked_scan": f"""
WITH posts AS (SELECT *, row_number() OVER (PARTITION BY item_type ORDER BY score DESC NULLS LAST, id) AS s FROM ({_LATEST}) WHERE item_type IN ('story', 'job', 'poll'))
SELECT item_type, r::INT AS position, id, score, n > {LIMIT} AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY item_type ORDER BY s) AS r, count(*) OVER (PARTITION BY item_type) AS n FROM posts WHERE s <= {SCAN * LIMIT} AND {_USABLE} AND title IS NOT NULL) WHERE r <= {LIMIT}""",
    "op9_discussions": f"""
WITH items AS ({_LATEST}),
one AS (SELECT post, kid, pos, row_number() OVER (PARTITION BY post ORDER BY pos) AS n FROM (
  SELECT id AS post, unnest(kids[1:{TOP_LEVEL}]) AS kid, generate_subscripts(kids[1:{TOP_LEVEL}], 1) - 1 AS pos FROM items WHERE item_type IN ('story', 'job', 'poll') AND {_USABLE})),
seen AS (SELECT o.*, i.by_user, i.kids FROM one o JOIN items i ON i.id = o.kid WHERE i.item_type = 'comment' AND {_USABLE}),
used AS (SELECT post, count(*) AS used FROM one GROUP BY post),
two AS (SELECT post, kid, pos, at2, row_number() OVER (PARTITION BY post ORDER BY pos, at2) AS n FROM (
  SELECT post, pos, unnest(kids) AS kid, generate_subscripts(kids, 1) - 1 AS at2 FROM seen))
SELECT post, 1 AS depth, kid, coalesce(by_user, 'unknown') AS author, printf('%05d', pos) AS place FROM seen
UNION ALL
SELECT t.post, 2, t.kid, coalesce(i.by_user, 'unknown'), printf('%05d.%05d', t.pos, t.at2) FROM two t JOIN used u ON u.post = t.post JOIN items i ON i.id = t.kid
WHERE t.n <= {COMMENTS} - u.used AND i.item_type = 'comment' AND {_USABLE}""",
    "op10_best_language": """
WITH t AS (SELECT collection_id, doc_id, lang, CASE WHEN lang = 'en' THEN 0 WHEN lower(lang) LIKE 'en%' THEN 1 WHEN lang = 'de' THEN 2 WHEN lower(lang) LIKE 'de%' THEN 3
  WHEN lang = 'fr' THEN 4 WHEN lower(lang) LIKE 'fr%' THEN 5 WHEN lang = 'es' THEN 6 WHEN lower(lang) LIKE 'es%' THEN 7 ELSE 99 END AS tier
  FROM documents WHERE collection_id IS NOT NULL AND lang IS NOT NULL)
SELECT collection_id, doc_id, lang, tier FROM (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY tier, doc_id) AS r FROM t) WHERE r = 1""",
    "op11_chunk_ranges": f"""
WITH RECURSIVE m AS (SELECT media_id, max(end_s) AS duration FROM audio_chunks GROUP BY media_id HAVING max(end_s) > 0),
c AS (SELECT media_id, duration, 0 AS chunk_no FROM m UNION ALL SELECT media_id, duration, chunk_no + 1 FROM c WHERE chunk_no * {CHUNK_S - OVERLAP_S} + {CHUNK_S} < duration)
SELECT media_id, chunk_no, round((chunk_no * {CHUNK_S - OVERLAP_S})::DOUBLE, 3) AS start_s, round(least(chunk_no * {CHUNK_S - OVERLAP_S} + {CHUNK_S}, duration)::DOUBLE, 3) AS end_s FROM c""",
    "op12_merged_segments": f"""
WITH c AS (SELECT media_id, chunk_no, start_s, segments, lead(start_s) OVER (PARTITION BY media_id ORDER BY chunk_no, chunk_id) AS next_s FROM ({_CHUNKS})),
s AS (SELECT media_id, chunk_no, start_s, next_s, generate_subscripts(segments, 1) - 1 AS pos, unnest(segments) AS seg FROM c),
t AS (SELECT media_id, chunk_no, pos::INT AS position, next_s, round(seg.start_s + start_s, 3) AS from_s, round(CASE WHEN next_s < seg.end_s + start_s THEN next_s ELSE seg.end_s + start_s END, 3) AS to_s, seg.text AS text FROM s)
SELECT media_id, chunk_no, position, from_s, to_s, text FROM t WHERE (next_s IS NULL OR from_s < next_s) AND to_s > from_s""",
    "op13_running_lines": """
WITH p AS (SELECT site, page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM article_pages WHERE text IS NOT NULL AND site IS NOT NULL),
k AS (SELECT DISTINCT site, page_id, lower(regexp_replace(unnest([l[1], l[-1]]), '[0-9]+', '#', 'g')) AS key FROM p),
z AS (SELECT site, count(DISTINCT page_id) AS pages FROM p GROUP BY site HAVING count(DISTINCT page_id) >= 3)
SELECT k.site, key, count(*) AS n, pages FROM k JOIN z ON z.site = k.site WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) * 2 >= pages""",
    "op14_paragraphs": f"""
WITH s AS (SELECT chunk_id, pos, s.start_s AS a, s.end_s AS b FROM (SELECT chunk_id, generate_subscripts(segments, 1) AS pos, unnest(segments) AS s FROM ({_CHUNKS}))),
n AS (SELECT *, CASE WHEN coalesce(round(a - max(b) OVER (PARTITION BY chunk_id ORDER BY a, b, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3) < {GAP_S}, false) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY chunk_id ORDER BY a, b, pos ROWS UNBOUNDED PRECEDING) AS paragraph FROM n)
SELECT chunk_id, paragraph::BIGINT AS paragraph, count(*) AS segments, round(min(a), 3) AS start_s, round(max(b), 3) AS end_s FROM g GROUP BY ALL""",
    "op24_kinds": f"""
SELECT CASE WHEN item_type IN ('job', 'poll') THEN item_type WHEN starts_with(lower(ltrim(coalesce(title, ''))), 'ask hn:') THEN 'ask'
  WHEN starts_with(lower(ltrim(coalesce(title, ''))), 'show hn:') THEN 'show' ELSE 'story' END AS kind, count(*) AS n, strftime(make_timestamp(max(time_s) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS newest
FROM ({_LATEST}) WHERE item_type IN ('story', 'job', 'poll') GROUP BY 1""",
}
