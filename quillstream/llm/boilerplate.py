"""Main bodies of web pages by host suffix arrays (problem 3).

The token streams of a host's pages are concatenated and their suffixes sorted by prefix doubling.
Windows of the array shared by many distinct articles, and whole lines shared by many, cover the
boilerplate of the host; counts are merged over the blocks of large hosts and over all hosts, so
that lines of rare sites are known from others. What stays uncovered between the headline and the
last paragraph is the main body.

A host is cut into blocks of about ``BLOCK_PAGES`` pages by a hash of the url, so that no task gets a
whole large host; shares are taken over all blocks of the host. Fetches of one url count as one
article, and a line seen with one article only (a repost on other sites) covers nothing.

Defined results: null or blank texts have no lines; repeated rows are judged alike; a null url counts as
a page of its own, null sites form one host; a page alone in the table keeps all that has no shape of
boilerplate; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.staging import Staging

BLOCK_PAGES = 400
#: A repeated window covers from this many tokens on.
MIN_WINDOW = 16
#: Of the distinct articles of a host (or of the hosts that show a line at all), the share that makes a line boilerplate.
HOST_SHARE, ALL_SHARE, SENTENCE_SHARE = 0.3, 0.3, 0.12
#: A prefix leads to teasers if so many distinct lines go on from it, nearly none of them a sentence.
PREFIX_LINES, PREFIX_DISTINCT, PREFIX_OPEN = 10, 0.3, 0.95

_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]|_")
_BULLETS = "-•*–‣▪·"
_TERMINAL = re.compile(r"[.!?…。！？؟।][\"”»“』」）)]*$")
_BULLET = re.compile(r"^[-•*–‣▪·]\s")
_COUNTED = re.compile(r"(?:\s{2,}|　|\()\d+\s*[^\W\d]{0,8}(?: [^\W\d]{0,8})?\)?\.?$")
_CRUMBS = re.compile(r"(?:^|\s)(?:>|/|»|›|→|::|\|)\s")
_SECTIONS = re.compile(r"\s*[·|>/»›→]\s*|\s{2,}|\u3000")
_HOST = re.compile(r"^(?:www\.)?([a-z-]+)")

TERMINAL, BULLET, TITLE, CRUMBS, COUNTED, LONG = 1, 2, 4, 8, 16, 32

_SCHEMA = (
    "kind int, page_id bigint, line_no int, line bigint, prefix bigint, feats int, covered boolean, n bigint, pages bigint, first_key bigint, last_key bigint"
)


def _hashes(parts: list[str]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    return pd.util.hash_array(np.array(parts, dtype=object)).astype(np.int64) if parts else np.empty(0, np.int64)


def suffix_ranks(tokens: np.ndarray, longest: int = MIN_WINDOW) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... tokens (prefix doubling); the last one orders the suffix array."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while k < longest and n > 1 and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        if k < n:
            after[:-k] = rank[k:] + 1
        pair = rank * (n + 2) + after
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        k *= 2
    return levels


def _distinct_articles(group: np.ndarray, article: np.ndarray) -> np.ndarray:
    """For each position, the number of distinct articles that hold its group."""
    if not len(group):
        return np.empty(0, np.int64)
    width = int(article.max()) + 1
    pairs = np.unique(group.astype(np.int64) * width + article)
    counts = np.bincount(pairs // width, minlength=int(group.max()) + 1)
    return counts[group]


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    """The lines of one block of a host, what the suffix array covers of them, and the counts to merge with other blocks."""
    stream, stream_of, starts, lengths, page_of, line_rows = [], [], [], [], [], []
    articles: dict[str, int] = {}
    lines_text, prefixes, sections = [], [], []
    site = frame["site"].iloc[0] if len(frame) else None
    found = _HOST.match(site) if isinstance(site, str) else None
    brand = found[1].replace("-", "") if found else ""
    brands = re.compile(r"\b(?:%s)\b" % r"\s?".join(map(re.escape, brand)), re.I) if len(brand) > 3 else None
    read: dict[str, tuple] = {}

    def reading(line: str) -> tuple:
        """What does not depend on the page: tokens, features, prefix and menu sections; kept, as most lines of a host return."""
        named = brands.sub("§", line) if brands else line
        tokens = _TOKEN.findall(_NUMBER.sub("#", named)) or [line]
        last = line[-12:]
        terminal = _TERMINAL.search(last) is not None
        feats = (
            (TERMINAL if terminal else 0)
            | (BULLET if line[0] in _BULLETS and _BULLET.match(line) else 0)
            | (CRUMBS if not terminal and _CRUMBS.search(line) else 0)
            | (COUNTED if (last[-1].isalnum() or last[-1] in ").") and _COUNTED.search(line[-40:]) else 0)
            | (LONG if len(tokens) >= 6 or len(line.encode()) >= 30 else 0)
        )
        parts = _SECTIONS.split(named) if not terminal else ()
        menu = ["\x1f".join(_TOKEN.findall(part)) for part in parts[:-1]] if len(parts) >= 3 else ()
        alone = tokens[0] == "#" and tokens[1:2] and tokens[1].isalpha() and tokens[1][:1].isupper()
        prefix = "\x1f".join(tokens[: 1 if alone else 2]) if len(tokens) > 2 else ""
        return tokens, feats, prefix, menu, "\x1f".join(tokens)

    for page_id, url, title, text in zip(frame["page_id"], frame["url"], frame["title"], frame["text"]):
        article = articles.setdefault(url if isinstance(url, str) else f"page {page_id}", len(articles))
        rows = [(no, line) for no, row in enumerate(text.split("\n"), 1) if (line := row.strip())]
        for _, line in rows:
            if line not in read:
                read[line] = reading(line)
        # the last part of a line of crumbs names the page as its title does
        named_so = {_CRUMBS.split(line)[-1].strip() for _, line in rows if read[line][1] & CRUMBS}
        if isinstance(title, str):
            named_so.add(title.strip())
        for no, line in rows:
            tokens, feats, prefix, menu, whole = read[line]
            starts.append(len(stream))
            lengths.append(len(tokens) + 1)
            page_of.append(article)
            line_rows.append((page_id, no, feats | TITLE if line in named_so else feats))
            sections.extend(menu)
            stream += tokens
            stream.append("\n")
            lines_text.append(whole)
            prefixes.append(prefix)
        # a separator of its own ends each page, so that no repeat runs over it
        stream.append(f"\n{len(lengths)}")
        stream_of.append(len(stream))
    if not lengths:
        return _row_type(pd.DataFrame({"kind": []}))
    start, length, of = np.array(starts), np.array(lengths), np.array(page_of)
    tokens = pd.factorize(np.array(stream, dtype=object))[0].astype(np.int64)
    edges = np.zeros(len(tokens), bool)
    edges[np.array(stream_of) - 1] = True
    page_articles = np.array([articles[u if isinstance(u, str) else f"page {i}"] for i, u in zip(frame["page_id"], frame["url"])])
    token_article = np.repeat(page_articles, np.diff(np.concatenate([[0], stream_of])))
    n_articles = len(articles)
    levels = suffix_ranks(tokens)
    # whole lines: two overlapping windows of a power of two name the substring
    level = np.minimum(np.log2(length).astype(int), len(levels) - 1)
    pair = np.zeros(len(start), np.int64)
    for j in range(len(levels)):
        at = level == j
        second = np.maximum(start[at] + length[at] - 2**j, start[at])
        pair[at] = levels[j][start[at]] * len(tokens) + levels[j][second]
    line_text = _hashes(lines_text)
    # lines longer than two windows differ in their middle, too
    whole = np.unique(pair * 1_000_003 ^ line_text, return_inverse=True)[1]
    n_whole = _distinct_articles(whole, of)
    # windows of MIN_WINDOW tokens or more, shared by many articles
    covered = np.zeros(len(start), bool)
    j = int(np.log2(MIN_WINDOW))
    least = max(3, int(np.ceil(HOST_SHARE * n_articles)))
    if j < len(levels) and n_articles >= least:
        position = np.flatnonzero(~edges)
        shared = _distinct_articles(levels[j][position], token_article[position]) >= least
        edge = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(edge, position[shared], 1)
        np.add.at(edge, np.minimum(position[shared] + MIN_WINDOW, len(tokens)), -1)
        inner = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        covered = (inner[start + length - 1] - inner[start]) >= 0.8 * (length - 1)
    # an article is known, whatever its url, by its longest line that no other article of the host has
    longest = pd.DataFrame({"article": of, "own": n_whole == 1, "size": [len(t) for t in lines_text], "line": line_text})
    longest = longest.sort_values(["article", "own", "size", "line"]).drop_duplicates("article", keep="last")
    key_of = longest.set_index("article")["line"].reindex(range(n_articles), fill_value=0).to_numpy()
    prefix = _hashes(prefixes)
    prefix[np.array([not p for p in prefixes])] = 0
    page_ids, numbers, feats = (np.array(c) for c in zip(*line_rows))
    rows = pd.DataFrame({"kind": 0, "page_id": page_ids, "line_no": numbers, "line": line_text, "prefix": prefix, "feats": feats, "covered": covered, "n": n_whole, "pages": n_articles})
    # counts of this block: articles by line, and lines by prefix
    seen = pd.DataFrame({"line": line_text, "article": of, "key": key_of[of]}).drop_duplicates(["line", "article"])
    lines = seen.groupby("line").agg(n=("article", "size"), first_key=("key", "min"), last_key=("key", "max")).reset_index()
    lines = lines.assign(kind=1, pages=n_articles)
    opened = pd.DataFrame({"prefix": prefix, "line": line_text, "open": (feats & (TERMINAL | BULLET)) == 0})
    opened = opened[opened["prefix"] != 0]
    by_prefix = opened.groupby("prefix").agg(n=("open", "sum"), pages=("open", "size"), first_key=("line", "nunique")).reset_index()
    by_prefix = by_prefix[by_prefix["n"] > 0].assign(kind=2)
    whole_block = pd.DataFrame({"kind": [3], "pages": [n_articles]})
    by_section = pd.DataFrame({"line": _hashes(sections)}).groupby("line").size().reset_index(name="n").assign(kind=4)
    return pd.concat([_row_type(part) for part in (rows, lines, by_prefix, whole_block, by_section)], ignore_index=True)


def _row_type(part: pd.DataFrame) -> pd.DataFrame:
    """All columns of the block's rows; what a kind of row lacks is 0."""
    columns = {}
    for name, kind in (c.split() for c in _SCHEMA.split(", ")):
        dtype = {"int": np.int32, "bigint": np.int64, "boolean": bool}[kind]
        columns[name] = part[name].to_numpy().astype(dtype) if name in part else np.zeros(len(part), dtype)
    return pd.DataFrame(columns)


def _by_host_blocks(pages: DataFrame) -> DataFrame:
    """Pages with the block of their host; only hosts above ``BLOCK_PAGES`` pages have more than one."""
    large = pages.groupBy(F.col("site").alias("large_site")).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_PAGES)
    # the join is broadcast only below the session's size limit
    blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / BLOCK_PAGES)
    joined = pages.join(large, pages["site"].eqNullSafe(large["large_site"]), "left")
    return joined.withColumn("block", F.pmod(F.xxhash64(F.coalesce("url", F.col("page_id").cast("string"))), blocks)).select(
        "page_id", "url", "site", "title", "text", "block"
    )


def line_labels(pages: DataFrame) -> DataFrame:
    """``page_id, line_no, in_body`` for each non-blank line."""
    st = Staging(pages.sparkSession, "pages")
    read = pages.where(F.col("page_id").isNotNull() & (F.length("text") > 0)).select("page_id", "url", "site", "title", "text")

    def block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _block(frame).assign(site=key[0])

    parts = st.cut(_by_host_blocks(read).groupBy("site", "block").applyInPandas(block, f"{_SCHEMA}, site string"), "lines")
    counts = parts.where("kind = 1")
    # articles of each host by line, then the same over the hosts that show the line
    host_pages = parts.where("kind = 3").groupBy("site").agg(F.sum("pages").alias("pages"))
    by_host = (
        counts.groupBy("site", "line")
        .agg(F.sum("n").alias("n"), F.min("first_key").alias("lo"), F.max("last_key").alias("hi"))
        .withColumnRenamed("site", "of_site")
        .join(host_pages, F.col("of_site").eqNullSafe(F.col("site")))
        .drop("of_site")
    )
    overall = by_host.groupBy("line").agg(
        F.sum("n").alias("all_n"), F.sum("pages").alias("all_pages"), F.count("*").alias("hosts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum(F.when((F.col("n") >= 3) & (F.col("n") >= HOST_SHARE * F.col("pages")), 1).otherwise(0)).alias("sure_hosts"),
    ).where("all_n >= 2 AND lo <> hi")
    prefixes = parts.where("kind = 2").groupBy("prefix").agg(F.sum("n").alias("open"), F.sum("pages").alias("lines"), F.sum("first_key").alias("distinct"))
    teasers = prefixes.where((F.col("open") >= PREFIX_LINES) & (F.col("open") >= PREFIX_OPEN * F.col("lines")) & (F.col("distinct") >= PREFIX_DISTINCT * F.col("open")))
    # names of sections: what stands between the separators of menu lines
    menu = parts.where("kind = 4").groupBy("line").agg(F.sum("n").alias("n"), F.count_distinct("site").alias("in_hosts")).where("n >= 5 AND in_hosts >= 2")
    lines = (
        parts.where("kind = 0")
        .select("site", "page_id", "line_no", "line", "prefix", "feats", "covered")
        .join(by_host.where("n >= 2 AND lo <> hi").select("site", "line", F.col("n").alias("host_n"), "pages"), ["site", "line"], "left")
        .join(overall.select("line", "all_n", "all_pages", "hosts", "sure_hosts"), "line", "left")
        .join(teasers.select("prefix", F.lit(True).alias("teaser")), "prefix", "left")
        .join(menu.select("line", F.lit(True).alias("section")), "line", "left")
    )
    has = lambda bit: F.col("feats").bitwiseAND(bit) != 0
    share, all_share = F.col("host_n") / F.col("pages"), F.col("all_n") / F.col("all_pages")
    repeated = F.coalesce(
        (F.col("host_n") >= 3) & (share >= HOST_SHARE) | (F.col("pages") < 6) & (share >= 0.5) & (F.col("hosts") >= 2), F.lit(False)
    ) | F.coalesce((F.col("hosts") >= 3) & (F.col("all_n") >= 4) & (all_share >= F.when(has(TERMINAL) & ~has(BULLET), SENTENCE_SHARE).otherwise(ALL_SHARE)), F.lit(False))
    common = F.coalesce(F.col("hosts") >= 3, F.lit(False))
    shaped = has(COUNTED) | F.coalesce("section", F.lit(False)) & ~has(TITLE) | F.coalesce("teaser", F.lit(False)) & ~has(BULLET)
    boiler = repeated | (F.col("covered") & ~has(TITLE)) | shaped
    strong = ~boiler & has(TERMINAL) & has(LONG)
    # not decided by repetition: an unbroken line that may be the headline
    heading = ~boiler & ~has(TERMINAL) & ~has(BULLET) & ~has(CRUMBS) & ~common
    marked = lines.select("page_id", "line_no", "feats", boiler.alias("boiler"), strong.alias("strong"), heading.alias("heading"))
    # rows of one page_id may be several identical fetches; line numbers keep them apart well enough to be judged alike
    page = Window.partitionBy("page_id")
    at = lambda c: F.when(c, F.col("line_no"))
    step = marked.withColumn("first_strong", F.min(at(F.col("strong"))).over(page)).withColumn("last_strong", F.max(at(F.col("strong"))).over(page))
    before = F.col("line_no") < F.coalesce("first_strong", F.lit(2**31 - 1))
    # the last line like the title before the first paragraph that follows such a line
    step = step.withColumn("named", F.min(at(has(TITLE))).over(page))
    step = step.withColumn("opening", F.min(at(F.col("strong") & (F.col("line_no") > F.col("named")))).over(page))
    named = has(TITLE) & (F.col("line_no") < F.coalesce("opening", F.lit(2**31 - 1)))
    head = step.withColumn("titled", F.max(at(named)).over(page)).withColumn("headed", F.max(at(F.col("heading") & before)).over(page))
    head = head.withColumn("first", F.coalesce("titled", "headed", "first_strong"))
    # list items and the like that directly follow the last paragraph
    after = F.min(at(F.col("boiler") & (F.col("line_no") > F.coalesce("last_strong", "first")))).over(page)
    head = head.withColumn("stop", after)
    tail = (F.col("line_no") > F.coalesce("last_strong", "first")) & (F.coalesce("stop", F.lit(2**31 - 1)) > F.col("line_no")) & (has(BULLET) | has(LONG)) & ~has(CRUMBS)
    inside = (F.col("line_no") >= F.col("first")) & (F.col("line_no") <= F.coalesce("last_strong", "first")) | tail
    is_head = F.col("line_no") == F.col("first")
    return head.select("page_id", "line_no", F.coalesce(is_head | inside & ~F.col("boiler"), F.lit(False)).alias("in_body"))


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """``page_id, line_no`` of the non-blank lines outside the main body."""
    return line_labels(pages).where(~F.col("in_body")).select("page_id", F.col("line_no").cast("int").alias("line_no"))


def main_bodies(pages: DataFrame) -> DataFrame:
    """``page_id, body``: the lines of the main body, in order."""
    kept = line_labels(pages).where("in_body").groupBy("page_id").agg(F.array_sort(F.collect_list("line_no")).alias("kept"))
    lines = pages.select("page_id", F.split("text", "\n").alias("lines")).join(kept, "page_id")
    return lines.select("page_id", F.array_join(F.transform("kept", lambda n: F.element_at("lines", n)), "\n").alias("body"))
