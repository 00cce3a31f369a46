"""Cutting long documents and recordings into overlapping pieces at natural boundaries (problem 1).

Positions count code points of a document, or milliseconds of a chunk. Every boundary is joined to its
farthest legal successor: the piece that follows a cut starts at the earliest boundary within the
overlap before it and ends at the farthest one within the limit. The successor tables are then squared,
and with each squaring the known cuts double, so that all greedy cuts of an item come out in as many
array steps as the logarithm of their number. Where two boundaries lie further apart than the limit,
places for cuts off every boundary are put between them; the overlap shrinks rather than force such a cut.

Defined results: null texts and ranges have no pieces; items within the limit are left alone; a chunk's
latest row counts; an item without any boundary is cut into full pieces; segments without times are
left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP_CHARS = 4000, 200
MAX_MS, OVERLAP_MS = 300_000, 2_000

#: Unicode's White_Space and the marks that end a sentence, as parts of a character class.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = ".!?…。！？।؟"

_CLOSERS = "\"'”’»›)\\]）」』】"
#: Kinds of boundary, best first; each match ends at one.
_BOUNDARIES = (
    re.compile(rf"\n[{SPACE}]*\n[{SPACE}]*"),
    re.compile(rf"[{MARKS}]+[{_CLOSERS}]*[{SPACE}]+|[。！？।؟…]+[{_CLOSERS}]*"),
    re.compile(rf"\n[{SPACE}]*"),
    re.compile(rf"[{SPACE}]+"),
    re.compile(rf"[{SPACE}{MARKS}]"),
    re.compile(rf"(?<=.)(?=[{SPACE}{MARKS}])", re.S),
)

SCHEMA = "item_kind string, item_id bigint, piece_no int, start double, end double, cut_at_boundary boolean, text string"


def long_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents above the limit."""
    return documents.where(F.char_length("text") > MAX_CHARS).select("doc_id", "text")


def _seconds(end, start):
    return F.round(end - start, 3)


def long_chunks(chunks: DataFrame, *payload: str) -> DataFrame:
    """``chunk_id, unbroken`` and ``payload`` of the chunks above the limit, the latest row of each chunk."""
    too_long = F.exists("segments", lambda s: F.coalesce(_seconds(s["end_s"], s["start_s"]) > MAX_MS / 1000, F.lit(False)))
    unbroken = F.coalesce(F.size("segments") < 1, F.lit(True)) | F.coalesce(too_long, F.lit(False))
    row = F.struct("fetched_at", (_seconds(F.col("end_s"), F.col("start_s")) > MAX_MS / 1000).alias("long"), unbroken.alias("unbroken"), *payload)
    latest = chunks.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max(row).alias("p"))
    return latest.where("p.long").select("chunk_id", "p.unbroken", *[F.col(f"p.{c}") for c in payload])


def long_items(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``item_kind, item_id, must_break`` of each item above its limit: whether its pieces had to be cut off every boundary."""
    off = F.max((~F.col("cut_at_boundary")).cast("int"))
    found = pieces(documents, chunks, with_text=False).groupBy("item_kind", "item_id").agg(off.alias("off"))
    return found.select("item_kind", "item_id", F.when(F.col("off") == 1, "yes").otherwise("no").alias("must_break"))


def successors(places: np.ndarray, rank: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place a piece may end at: where the next piece starts, and the index of the place it ends at.

    ``places`` ascend from 0 to the item's length, at most ``limit`` apart; ``rank`` is 2 for good boundaries,
    1 for others, 0 for places off every boundary.
    """
    n = len(places)
    index = np.arange(n)
    following = np.append(places[1:], places[-1])
    low = np.maximum(np.maximum(places - overlap, following - limit), 0)
    start = places.copy()
    for least in (1, 2):
        # the earliest boundary from ``low`` on, if it lies before the cut; good ones win
        those = np.flatnonzero(rank >= least)
        if len(those):
            at = np.searchsorted(places[those], low)
            first = those[np.minimum(at, len(those) - 1)]
            fits = (at < len(those)) & (places[first] < places) & (places[first] >= low)
            start = np.where(fits, places[first], start)
    start = np.where(rank == 0, low, start)
    start[0] = 0
    end = np.minimum(np.searchsorted(places, start + limit, side="right") - 1, n - 1)
    best = end.copy()
    for least in (1, 2):
        # the last boundary within the limit; a good one only if it lies in the further half
        last = np.maximum.accumulate(np.where(rank >= least, index, -1))[end]
        fits = (last > index) & ((least == 1) | (places[np.maximum(last, 0)] - start > limit // 2))
        best = np.where(fits, last, best)
    best = np.where(places[-1] - start <= limit, n - 1, best)
    return start, best


def greedy_cuts(places: np.ndarray, rank: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """``(start, end, at a boundary)`` of each piece, by squaring the successor table from the first place."""
    start, jump = successors(places, rank, limit, overlap)
    known = np.zeros(1, np.int64)
    while True:
        more = np.unique(np.append(known, jump[known]))
        jump = jump[jump]
        if len(more) == len(known):
            break
        known = more
    return [(int(start[a]), int(places[b]), bool(rank[b])) for a, b in zip(known, known[1:])]


def _filled(places: list[int], rank: list[int], limit: int, overlap: int, quiet: set[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """Places no more than ``limit`` apart: those added are off every boundary, unless what follows them is quiet."""
    out, ranks = [places[0]], [rank[0]]
    for a, b, r in zip(places, places[1:], rank[1:]):
        if b - a > limit:
            added = list(range(a + limit, b, limit - overlap))
            out += added
            ranks += [1 if a in quiet else 0] * len(added)
        out.append(b)
        ranks.append(r)
    return np.array(out, np.int64), np.array(ranks, np.int8)


def cut_text(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int, bool]]:
    """``(start, end, at a boundary)`` of each piece of ``text``."""
    n = len(text)
    good = {m.end() for kind in _BOUNDARIES[:2] for m in kind.finditer(text)} & set(range(1, n))
    natural = {m.end() for kind in _BOUNDARIES[2:] for m in kind.finditer(text)} | good | {0, n}
    places = sorted(natural)
    return greedy_cuts(*_filled(places, [2 if p in good or p in (0, n) else 1 for p in places], limit, overlap), limit, overlap)


def cut_times(length: int, segments: list[tuple[int, int]], limit: int = MAX_MS, overlap: int = OVERLAP_MS) -> list[tuple[int, int, bool]]:
    """``(start, end, at a boundary)`` of each piece of a recording of which ``segments`` are spoken."""
    spoken = sorted((max(a, 0), min(b, length)) for a, b in segments if min(b, length) > max(a, 0)) or [(0, length)]
    # places within a segment that is too long are off every boundary, those within others are poor ones
    places = sorted({x for s in spoken for x in s} | {0, length})
    at = np.array(places)
    depth, long_depth = np.zeros(len(places) + 1, int), np.zeros(len(places) + 1, int)
    following = np.zeros(len(places) + 1, int)
    for a, b in spoken:
        i, j = np.searchsorted(at, (a, b))
        for d, on in ((depth, True), (long_depth, b - a > limit)):
            if on and j > i + 1:
                d[i + 1] += 1
                d[j] -= 1
        following[i] += 1
        following[j] -= 1
    inside, inside_long, spoken_after = np.cumsum(depth)[:-1], np.cumsum(long_depth)[:-1], np.cumsum(following)[:-1]
    rank = [0 if x else 1 if y else 2 for x, y in zip(inside_long, inside)]
    quiet = {p for p, k in zip(places, spoken_after) if not k}
    return greedy_cuts(*_filled(places, rank, limit, overlap, quiet), limit, overlap)


def _spoken(text: str, a: int, b: int, start: int, end: int) -> str:
    """The part of a segment's text said between ``start`` and ``end``, whole words, in proportion to time."""
    if start <= a and b <= end:
        return text
    n, words = len(text), [m.span() for m in re.finditer(r"\S+", text)]
    low, high = n * (start - a) / (b - a), n * (end - a) / (b - a)
    return " ".join(text[i:j] for i, j in words if j > low and i < high)


def _cut_documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [
            ("document", doc_id, k, float(a), float(b), natural, text[a:b])
            for doc_id, text in zip(frame["doc_id"], frame["text"])
            for k, (a, b, natural) in enumerate(cut_text(text))
        ]
        yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_no", "start", "end", "cut_at_boundary", "text"])


def _cut_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ms = lambda s: round(s * 1000)
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            length = ms(row.end_s - row.start_s)
            given = [s for s in (row.segments if row.segments is not None else []) if s is not None and s["start_s"] is not None and s["end_s"] is not None]
            said = sorted(((ms(s["start_s"]), ms(s["end_s"]), s["text"] or "") for s in given), key=lambda s: s[:2])
            pieces = cut_times(length, [s[:2] for s in said])
            said = said or [(0, length, row.text or "")]
            for k, (a, b, natural) in enumerate(pieces):
                # what is said at the very edge or beyond it belongs to the nearest piece
                first, last = k == 0, k == len(pieces) - 1
                parts = [
                    _spoken(t, x, y, min(a, x) if first else a, max(b, y) if last else b)
                    for x, y, t in said
                    if (x < b or last) and (y > a or first) or x == y and a <= x <= b
                ]
                text = " ".join(p for p in parts if p)
                rows.append(("audio_chunk", row.chunk_id, k, row.start_s + a / 1000, row.start_s + b / 1000, natural, text))
        yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_no", "start", "end", "cut_at_boundary", "text"])


def pieces(documents: DataFrame, chunks: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of each item above its limit; ``start`` and ``end`` in code points or seconds."""
    docs = long_documents(documents).mapInPandas(_cut_documents, SCHEMA)
    recordings = long_chunks(chunks, "start_s", "end_s", "segments", "text").drop("unbroken")
    out = docs.unionByName(recordings.mapInPandas(_cut_chunks, SCHEMA))
    return out if with_text else out.drop("text")
