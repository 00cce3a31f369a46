"""Queries over texts, addresses and records: normalization, redaction, classification, envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions.sums import running_sum
from quillstream.sources.tables import table

#: The least characters of a readable body, the byte allowance of a site and the instruction of a prompt.
MIN_READABLE, BYTE_BUDGET, INSTRUCTION = 500, 50_000, "Summarize the document in three sentences."


def op1_discussion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized text of each fetched post, with its length and fingerprint."""
    items = table(spark, sf_dir, "hn_items").where("text IS NOT NULL").select("id", "fetched_at", T.discussion_text(F.col("text")).alias("text"))
    return items.select("id", "fetched_at", "text", F.char_length("text").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")).distinct()


def op2_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts as one line of text."""
    return table(spark, sf_dir, "arxiv_announcements").select("ann_id", T.one_line(F.col("abstract")).alias("text"))


def op15_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first recogniser that takes each address, in order of priority."""
    urls = (
        table(spark, sf_dir, "article_pages").select("url").union(table(spark, sf_dir, "documents").select("canonical_url")).union(table(spark, sf_dir, "hn_items").select("url"))
    ).where("url IS NOT NULL")
    host = F.lower(F.regexp_extract("url", r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1))
    route = (
        F.when(~F.col("url").rlike(r"^https?://"), "unsupported")
        .when(F.col("url").rlike(r"^https?://[^/?#]*@"), "credentials")
        .when(host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.)"), "blocked")
        .when((host == "arxiv.example") & path.rlike(r"^/(abs|pdf|html)/"), "arxiv")
        .when((host == "pubmed.example") & path.rlike(r"^/abs/\d+"), "pubmed")
        .when((host == "biorxiv.example") & path.rlike(r"^/abs/10\."), "biorxiv")
        .when(path.rlike(r"\.(mp3|m4a|ogg|wav)$"), "audio")
        .when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(rss|atom|xml)$|/feed/?$"), "feed")
        .otherwise("article")
    )
    return urls.select("url", host.alias("host"), route.alias("route")).groupBy("url", "host", "route").agg(F.count("*").alias("n"))


def op16_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page is an article: declared so, or undeclared with a readable body."""
    kind = T.media_type(F.col("content_type"))
    length = F.coalesce(F.char_length(F.trim("text")), F.lit(0))
    html = kind.isin("text/html", "application/xhtml+xml")
    article = html & (F.col("signal").isin("og-article", "json-ld-article") & (length > 0) | ~F.coalesce(F.col("signal").isin("og-article", "json-ld-article", "og-non-article"), F.lit(False)) & (length >= MIN_READABLE))
    return table(spark, sf_dir, "article_pages").select("page_id", kind.alias("media_type"), F.coalesce(html, F.lit(False)).alias("is_html"), F.coalesce(article, F.lit(False)).alias("article"))


def op17_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with addresses and secret-like values redacted."""
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("text"), T.redact_urls(F.col("canonical_url")).alias("canonical_url"))


def op18_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each site within its allowance of bytes: from the first page that would exceed it, none is taken any more."""
    pages = table(spark, sf_dir, "article_pages").select("page_id", "site", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))
    spent = running_sum(pages, "site", "page_id", F.col("bytes"), "spent")
    return spent.select("page_id", "site", "bytes", F.when(F.col("spent") <= BYTE_BUDGET, BYTE_BUDGET - F.col("spent")).otherwise(F.lit(0)).alias("remaining"), (F.col("spent") <= BYTE_BUDGET).alias("taken"))


def op19_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt for each document: instruction and trimmed text."""
    trimmed = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace(F.concat_ws("\n\n", F.lit(INSTRUCTION), trimmed), r"\s+$", "").alias("prompt"))


def op20_fallback_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers made of names, for rows that have none."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.fallback_id(F.col("c_name"), F.lit(""), F.col("c_mktsegment")).alias("id"))


def op21_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each announced version: the first document with its address, or an error of its own, never a lost row."""
    docs = table(spark, sf_dir, "documents").where("source = 'arxiv'").groupBy(F.regexp_extract("canonical_url", r"/abs/([^/?#]+)$", 1).alias("paper")).agg(F.min("doc_id").alias("doc_id"))
    plain = F.regexp_extract("id", r"(\d{4}\.\d{4,5}|[a-z-]+(?:\.[A-Z]{2})?/\d{7})", 1)
    rows = table(spark, sf_dir, "arxiv_announcements").select("ann_id", plain.alias("paper")).join(docs, "paper", "left")
    error = F.when(F.col("paper") == "", "INVALID_INPUT").when(F.col("doc_id").isNull(), "NOT_FOUND")
    return rows.select("ann_id", F.when(error.isNull(), "ok").otherwise("error").alias("status"), "doc_id", error.alias("error"))


def op22_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed metadata of each document: allowed keys that have a value."""
    allowed = ("author", "media_type", "published_at", "title")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in allowed])
    kept = F.filter(pairs, lambda p: p["value"].isNotNull())
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(kept, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "|").alias("metadata"))


def op23_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each event type: failed if any error, else passed, with counts."""
    events = table(spark, sf_dir, "events")
    by = events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") < 0).alias("below"), F.count_if(F.col("value") >= 100).alias("high"), F.count_distinct("user_id").alias("users")
    )
    return by.withColumn("status", F.when(F.col("event_type") == "error", "failed").when(F.col("below") > 0, "incomplete").otherwise("passed"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_discussion_text, op2_one_line, op15_routes, op16_classified, op17_redacted, op18_within_budget, op19_prompts, op20_fallback_ids, op21_envelopes, op22_metadata, op23_roll_up,
    )
}

_DECODED = r"""replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '&#x2F;', '/'), '&#x27;', ''''), '&#39;', ''''), '&#47;', '/'), '&#34;', '"'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"""

_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

SQL = {
    "op1_discussion_text": r"""
WITH linked AS (
  SELECT id, fetched_at, regexp_replace(
    CASE WHEN text LIKE '%...</a>%' OR regexp_matches(text, '>\s*</a>') THEN regexp_replace(text, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(?:\s*|[^<]*\.\.\.)</a>', '\1', 'g') ELSE text END,
    '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>([^<]*)</a>', '\2 (\1)', 'g') AS t
  FROM hn_items WHERE text IS NOT NULL
), plain AS (SELECT id, fetched_at, """
    + _DECODED.format("regexp_replace(regexp_replace(t, '(?i)<p>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')")
    + r""" AS t FROM linked),
made AS (
  SELECT DISTINCT id, fetched_at, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '\n{2,}'), lambda p: trim(regexp_replace(p, '[ \t]+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS text
  FROM plain
)
SELECT id, fetched_at, text, length(text)::INT AS n_chars, sha256(text) AS sha256 FROM made""",
    "op2_one_line": "SELECT ann_id, trim(regexp_replace(regexp_replace(regexp_replace("
    + _DECODED.format("abstract")
    + r""", '(?i)</(?:p|div|section|article|li|ul|ol|h[1-6]|tr|table|blockquote|pre)[^>]*>|<br\s*/?>', ' ', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM arxiv_announcements""",
    "op15_routes": r"""
WITH urls AS (SELECT url FROM article_pages UNION ALL SELECT canonical_url FROM documents UNION ALL SELECT url FROM hn_items),
parts AS (
  SELECT url, lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), ':', 1)) AS host,
    lower(CASE WHEN contains(split_part(url, '://', 2), '/') THEN split_part(split_part(substr(split_part(url, '://', 2), strpos(split_part(url, '://', 2), '/')), '?', 1), '#', 1) ELSE '' END) AS path
  FROM urls WHERE url IS NOT NULL
)
SELECT url, host, CASE WHEN NOT starts_with(url, 'http') THEN 'unsupported'
  WHEN host = 'arxiv.example' AND (starts_with(path, '/abs/') OR starts_with(path, '/pdf/') OR starts_with(path, '/html/')) THEN 'arxiv'
  WHEN host = 'pubmed.example' AND regexp_matches(path, '^/abs/[0-9]+') THEN 'pubmed'
  WHEN host = 'biorxiv.example' AND starts_with(path, '/abs/10.') THEN 'biorxiv'
  WHEN regexp_matches(path, '\.(mp3|m4a|ogg|wav)$') THEN 'audio' WHEN ends_with(path, '.pdf') THEN 'pdf'
  WHEN regexp_matches(path, '\.(rss|atom|xml)$|/feed/?$') THEN 'feed' ELSE 'article' END AS route, count(*) AS n
FROM parts GROUP BY ALL""",
    "op16_classified": f"""
SELECT page_id, media_type, media_type IS NOT DISTINCT FROM 'text/html' AS is_html, coalesce(media_type = 'text/html' AND CASE signal
  WHEN 'og-article' THEN n > 0 WHEN 'json-ld-article' THEN n > 0 WHEN 'og-non-article' THEN false ELSE n >= {MIN_READABLE} END, false) AS article
FROM (SELECT page_id, signal, coalesce(length(trim(text)), 0) AS n, lower(trim(split_part(content_type, ';', 1))) AS media_type FROM article_pages)""",
    "op17_redacted": r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(https?://)[^\s"''<>/@?#]*@', '\1', 'g'), '(https?://[^\s"''<>?#]*)[?#][^\s"''<>]*', '\1', 'g'),
  '(?i)\bBearer\s+[^\s"'']+', 'Bearer [REDACTED]', 'g'), '\bsk-[A-Za-z0-9_-]+\b', '[REDACTED]', 'g'), '(?i)\b(api[_-]?key|token|secret|password)\s*([:=])\s*([^\s,"''}\]]+)', '\1\2[REDACTED]', 'g') AS text,
  regexp_replace(regexp_replace(canonical_url, '(https?://)[^/@?#]*@', '\1'), '[?#].*$', '') AS canonical_url FROM documents""",
    "op18_within_budget": f"""
SELECT page_id, site, bytes, CASE WHEN spent <= {BYTE_BUDGET} THEN {BYTE_BUDGET} - spent ELSE 0 END::BIGINT AS remaining, spent <= {BYTE_BUDGET} AS taken
FROM (SELECT page_id, site, bytes, sum(bytes) OVER (PARTITION BY site ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS spent
      FROM (SELECT page_id, site, coalesce(strlen(text), 0)::BIGINT AS bytes FROM article_pages))""",
    "op19_prompts": f"SELECT doc_id, rtrim('{INSTRUCTION}' || chr(10) || chr(10) || regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS prompt FROM documents WHERE text IS NOT NULL",
    "op20_fallback_ids": """
SELECT c_custkey, 'entry-' || printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name || chr(0) || c_mktsegment, ''), lambda c: ascii(c)::BIGINT)),
  lambda h, c: (xor(h, c)::HUGEINT * 16777619 % 4294967296)::BIGINT)) AS id FROM customer""",
    "op21_envelopes": r"""
WITH docs AS (SELECT split_part(canonical_url, '/abs/', 2) AS paper, min(doc_id) AS doc_id FROM documents WHERE source = 'arxiv' AND canonical_url IS NOT NULL GROUP BY 1),
rows AS (SELECT ann_id, regexp_extract(id, '([0-9]{4}\.[0-9]{4,5}|[a-z-]+(\.[A-Z]{2})?/[0-9]{7})', 1) AS paper FROM arxiv_announcements)
SELECT ann_id, CASE WHEN r.paper <> '' AND doc_id IS NOT NULL THEN 'ok' ELSE 'error' END AS status, doc_id,
  CASE WHEN r.paper = '' THEN 'INVALID_INPUT' WHEN doc_id IS NULL THEN 'NOT_FOUND' END AS error FROM rows r LEFT JOIN docs d ON d.paper = r.paper""",
    "op22_metadata": """
SELECT doc_id, concat_ws('|', 'author=' || author, 'media_type=' || media_type, 'published_at=' || published_at, 'title=' || title) AS metadata FROM documents""",
    "op23_roll_up": """
SELECT event_type, count(*) AS n, count(*) FILTER (value < 0) AS below, count(*) FILTER (value >= 100) AS high, count(DISTINCT user_id) AS users,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN count(*) FILTER (value < 0) > 0 THEN 'incomplete' ELSE 'passed' END AS status FROM events GROUP BY event_type""",
}
