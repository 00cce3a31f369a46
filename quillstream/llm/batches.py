"""Deduplicating batches against all history by an incremental inverted index (problem 4).

A text is the set of its word triples (repeats numbered), ordered from rare to frequent by a table of counts frozen
with the first batch. Two texts above the threshold must share more than ``g`` of their rarest triples (prefix filter);
dealt into ``g`` groups, two of these fall into one. So the tokens of the index are the pairs of rare triples of a group,
which hardly two texts have by chance. It is partitioned by token: a part takes the batches in their order, each
probes the postings of those before and its own for partners of a fitting length and then appends its new texts, so
each text is sent to the index once, and nothing of the history is sent again for a later batch. Partners are dropped
whose signatures of 256 bits bound the overlap below the threshold; it is verified on the texts of the others alone.

Equal texts form one class with one set of postings; of a class only its two earliest rows of different paper ids
are compared, which is all that a later row can need. So a group of copies, however large, costs one entry. Acceptance
goes by arrival: rows wait for the earlier ones they may repeat, and rounds go on until none waits.

Defined results: ids that cannot be read are compared as they stand, null ids match nothing; a version
given nowhere is 1; a row without any word triple repeats others by id and version only; rows with a null
``ann_id`` or batch are left out; equal rows of one ``ann_id`` are one row.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.staging import Staging

#: Two texts agree if they share so much of the longer one's word triples; one word in ten changes three triples in ten.
AGREE = 0.6
#: The triples are counted in so many cells; with the marks of the texts to verify, all that is sent to every worker.
CELLS, MARKS, CHUNK = 1 << 20, 1 << 26, 1 << 13
#: Rows to a part of the index, parts at least, texts taken apart at once, and partners looked at in one step.
ROWS, PARTS, TEXTS, STEP = 25_000, 16, 2000, 2_000_000

#: Sizes of a pair's longer text from which on there are so many groups; with 0 single triples are the tokens. More than
#: ``groups`` triples are shared at each size: 0.6 of 6, 27, 256 and so on.
BANDS = ((1, 0), (6, 3), (27, 16), *((256 * 4**k, 64 * 4**k) for k in range(8)))
SIGNS = ("s0", "s1", "s2", "s3")

_ID = r"([a-z-]+(?:\.[a-z]{2})?/\d{7}|\d{4}\.\d{4,5})(?:v(\d+))?"
_TAG = re.compile(r"<[^<>]{1,200}>")
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?|\\.")
_WORD = re.compile(r"[^\W_]+")


def words_of(title: str | None, abstract: str | None) -> list[str]:
    """The words of both texts without entities, markup, accents, case and layout."""
    text = html.unescape(html.unescape(f"{title or ''} {abstract or ''}"))
    text = unicodedata.normalize("NFKD", _COMMAND.sub(" ", _TAG.sub(" ", text))).lower()
    return _WORD.findall("".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each number of 64 bits as another one that looks random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _triples(titles: Iterable, abstracts: Iterable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word triples of each text, repeats numbered, each once; the place of its text; and the name of each text."""
    words, lengths = [], []
    for title, abstract in zip(titles, abstracts):
        own = words_of(title, abstract)
        words += own
        lengths.append(len(own))
    count = np.array(lengths, np.int64)
    if len(words) < 3:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.zeros(len(count), np.int64)
    code, known = pd.factorize(np.array(words, dtype=object))
    h = pd.util.hash_array(known.astype(object), categorize=False)[code]
    of = np.repeat(np.arange(len(count)), count)
    a, b, c = h[:-2], h[1:-1], h[2:]
    h, of = _mixed(_mixed(_mixed(a) + b) + c), of[:-2]
    whole = of == np.repeat(np.arange(len(count)), count)[2:]
    h, of = h[whole], of[whole]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.arange(len(h))
    h = _mixed(h + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64))
    names = np.zeros(len(count), np.uint64)
    np.add.at(names, of, _mixed(h + np.uint64(1)))
    gram = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    pairs = np.unique((of.astype(np.uint64) << np.uint64(32)) | gram)
    return (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), (pairs >> np.uint64(32)).astype(np.int64), names.view(np.int64)


def paper_id(column: Column) -> Column:
    """The paper's id however written: without scheme, prefix, suffix, version and case."""
    plain = F.lower(F.trim(column))
    found = F.regexp_extract(plain, _ID, 1)
    return F.when(found != "", found).otherwise(F.when(plain != "", plain))


def paper_version(id_column: Column, version: Column) -> Column:
    """The version written in the id, else the one given, else 1."""
    inside, given = F.regexp_extract(F.lower(id_column), _ID, 2), F.regexp_extract(version, r"(\d+)", 1)
    return F.coalesce(F.try_to_number(F.when(inside != "", inside), F.lit("999999999")), F.try_to_number(F.when(given != "", given), F.lit("999999999")), F.lit(1)).cast("int")


def _pack(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next ones: of small values, what the shuffle's compression takes away."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _signs(gram: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """256 bits for each of ``n`` texts; each triple turns one over, so two texts' bits differ in no more places than their triples."""
    bit = (_mixed(gram.astype(np.uint64) + np.uint64(7)) & np.uint64(255)).astype(np.int64)
    odd = (np.bincount(of * 256 + bit, minlength=n * 256) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, 256), axis=1).view(np.int64)


def _tokens(gram: np.ndarray, of: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the index with their texts, and the sizes of the ``n`` texts."""
    size = np.bincount(of, minlength=n)
    order = np.lexsort((gram, rank, of))
    gram, of = gram[order], of[order]
    place = np.arange(len(gram)) - (np.cumsum(size) - size)[of]
    least, longest = np.ceil(size * AGREE), np.floor(size / AGREE + 1e-9)
    tokens, texts = [], []
    for (begin, groups), (end, _) in zip(BANDS, (*BANDS[1:], (1 << 62, 0))):
        rare = ((longest >= begin) & (size < end))[of] & (place < (size - least + groups + 1)[of])
        g, t = gram[rare].astype(np.uint64), of[rare]
        if not groups:
            tokens.append(_mixed(g))
            texts.append(t)
            continue
        group = _mixed(g + np.uint64(3)) % np.uint64(groups)
        order = np.lexsort((g, group, t))
        g, t, group = g[order], t[order], group[order]
        for d in range(1, len(g)):
            both = (t[d:] == t[:-d]) & (group[d:] == group[:-d])
            if not both.any():
                break
            tokens.append(_mixed((g[:-d][both] << np.uint64(32) | g[d:][both]) + np.uint64(groups)))
            texts.append(t[d:][both])
    return (np.concatenate(tokens) & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.concatenate(texts), size


def _pieces(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for k in range(0, len(frame), TEXTS):
            yield frame.iloc[k : k + TEXTS]


def prepare(read: DataFrame, st: Staging, first_batch: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """``ann_id, batch_no, pid, key, tid``: each row once, ``tid`` names its text; ``tid, size, s0..s3`` of the texts; and the first batch's counts of triples by cell."""

    def normal(frames):
        counts = np.zeros(CELLS, np.int64)
        for frame in _pieces(frames):
            gram, of, names = _triples(frame["title"], frame["abstract"])
            of_first = (frame["batch_no"] == first_batch).to_numpy()
            counts += np.bincount(gram[of_first[of]] % CELLS, minlength=CELLS)
            size = np.bincount(of, minlength=len(frame))
            tid = pd.Series(names, frame.index, "Int64").where(size > 0)
            signs = dict(zip(SIGNS, _signs(gram, of, len(frame)).T))
            yield frame[["ann_id", "batch_no", "pid", "key"]].assign(tid=tid, size=size, **signs, chunk=pd.NA, cells=None)
        for k in range(0, CELLS if counts.any() else 0, CHUNK):
            yield pd.DataFrame({c: [None] for c in columns[:-2]} | {"chunk": [k // CHUNK], "cells": [_pack(counts[k : k + CHUNK])]})

    schema = "ann_id bigint, batch_no int, pid string, key string, tid bigint, size int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, chunk int, cells binary"
    columns = [c.split()[0] for c in schema.split(", ")]
    made = st.cut(read.mapInPandas(normal, schema), "made")
    signs = made.where("tid IS NOT NULL").groupBy("tid").agg(F.min("size").alias("size"), *[F.min(c).alias(c) for c in SIGNS])
    once = made.where("chunk IS NULL").groupBy("ann_id").agg(F.min(F.struct("batch_no", "pid", "key", "tid")).alias("row"))
    rows = st.cut(once.select("ann_id", "row.*"), "rows")
    counts = np.zeros(CELLS, np.int64)
    for k, cells in _summed(made.select("chunk", "cells"), lambda parts: sum(_unpack(x, np.int64) for x in parts)):
        counts[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(cells, np.int64)
    return rows, signs, counts


def _summed(chunks: DataFrame, together: Callable[[Iterable[bytes]], np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Each chunk of a table that the tasks have made, put together from all of them."""

    def one(frame):
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "cells": [together(frame["cells"]).tobytes()]})

    summed = chunks.where("chunk IS NOT NULL").groupBy("chunk").applyInPandas(one, "chunk int, cells binary")
    return ((r.chunk, r.cells) for r in summed.toLocalIterator())


class Postings:
    """A part of the index: tokens and texts in sorted runs; small runs are merged into the one before as batches come."""

    def __init__(self, sizes: np.ndarray):
        self.sizes, self.runs = sizes, []
        self.least = np.ceil(sizes * AGREE)
        self.known = np.zeros(len(sizes), bool)

    def batch(self, token: np.ndarray, text: np.ndarray) -> Iterator[np.ndarray]:
        """Add the postings of the texts that are new; pairs (smaller text << 32 | larger) that share a token, among them and with those before."""
        new = ~self.known[text]
        own = np.unique((token[new].astype(np.uint64) << np.uint64(32)) | text[new].astype(np.uint64))
        self.known[text] = True
        for run in [*self.runs, own]:
            yield from self._shared(own, run)
        self.runs.append(own)
        while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
            self.runs[-2:] = [np.sort(np.concatenate(self.runs[-2:]), kind="stable")]

    def _shared(self, own: np.ndarray, run: np.ndarray) -> Iterator[np.ndarray]:
        low = np.uint64(0xFFFFFFFF)
        token = own & ~low
        begin, end = np.searchsorted(run, token), np.searchsorted(run, token | low, "right")
        if run is own:
            begin = np.arange(1, len(own) + 1)  # the others come up from their side
        some = np.flatnonzero(end > begin)
        ends = np.cumsum(end[some] - begin[some])
        at = 0
        while at < len(some):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + STEP, "right")))
            part = some[at:to]
            n = end[part] - begin[part]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = (own[np.repeat(part, n)] & low).astype(np.int64), (run[np.repeat(begin[part], n) + within] & low).astype(np.int64)
            fits = (self.sizes[a] >= self.least[b]) & (self.sizes[b] >= self.least[a]) & (a != b)
            a, b = a[fits], b[fits]
            yield np.unique((np.minimum(a, b).astype(np.uint64) << np.uint64(32)) | np.maximum(a, b).astype(np.uint64))
            at = to


def candidates(read: DataFrame, counts: np.ndarray, parts: int) -> DataFrame:
    """``a, b``: the texts that share a token with another of a fitting length, each pair once."""
    shared = read.sparkSession.sparkContext.broadcast(counts)

    def posted(frames):
        for frame in frames:
            made = {}
            for piece in _pieces([frame]):
                gram, of, names = _triples(piece["title"], piece["abstract"])
                token, of, size = _tokens(gram, of, shared.value[gram % CELLS], len(piece))
                batch = piece["batch_no"].to_numpy()
                for n in np.unique(batch):
                    mine = batch[of] == n
                    made.setdefault(int(n), []).append((token[mine], names[of[mine]], size[of[mine]]))
            out = []
            for n, pieces in made.items():
                token, name, size = (np.concatenate(x) for x in zip(*pieces))
                order = np.lexsort((token, token % parts))
                token, name, size = token[order], name[order], size[order]
                ends = np.searchsorted(token % parts, np.arange(parts + 1))
                for k in range(parts):
                    g, t, s = (x[ends[k] : ends[k + 1]] for x in (token, name, size))
                    if len(g):
                        text, first, index = np.unique(t, return_index=True, return_inverse=True)
                        out.append((k, n, _pack(np.diff(g // parts, prepend=np.uint32(0)).astype(np.uint32)), _pack(index.astype(np.uint32)), text.tobytes(), _pack(s[first].astype(np.uint32))))
            yield pd.DataFrame(out, columns=["part", "batch_no", "tokens", "places", "texts", "sizes"])

    def probed(key, frame):
        k = np.uint64(key[0])
        frame = frame.sort_values("batch_no")
        texts = [np.frombuffer(x, np.int64) for x in frame["texts"]]
        names, first = np.unique(np.concatenate(texts), return_index=True)
        index = Postings(np.concatenate([_unpack(x, np.uint32) for x in frame["sizes"]]).astype(np.int64)[first])
        found, held = [], 0
        for _, own in frame.assign(names=texts).groupby("batch_no"):
            token = np.concatenate([np.cumsum(_unpack(x, np.uint32).astype(np.uint64)) for x in own["tokens"]]) * np.uint64(parts) + k
            text = np.concatenate([np.searchsorted(names, t)[_unpack(p, np.uint32)] for t, p in zip(own["names"], own["places"])])
            for pairs in index.batch(token, text):
                found.append(pairs)
                held += len(pairs)
                if held > STEP:
                    found = [np.unique(np.concatenate(found))]
                    held = 0
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
        return pd.DataFrame({"a": names[(pairs >> np.uint64(32)).astype(np.int64)], "b": names[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]})

    blobs = read.select("batch_no", "title", "abstract").mapInPandas(posted, "part int, batch_no int, tokens binary, places binary, texts binary, sizes binary")
    return blobs.groupBy("part").applyInPandas(probed, "a bigint, b bigint").distinct()


def _marks(ids: DataFrame) -> np.ndarray:
    """A bit for each of ``MARKS`` remainders, set if one of ``ids`` may have it; no id is missed."""
    def marked(frames):
        bits = np.zeros(MARKS // 8, np.uint8)
        for frame in frames:
            at = _mark_of(frame.iloc[:, 0].to_numpy(np.int64))
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for k in range(0, len(bits), 4 * CHUNK):
            if (piece := bits[k : k + 4 * CHUNK]).any():
                yield pd.DataFrame({"chunk": [k // (4 * CHUNK)], "cells": [piece.tobytes()]})

    bits = np.zeros(MARKS // 8, np.uint8)
    for k, cells in _summed(ids.mapInPandas(marked, "chunk int, cells binary"), lambda parts: np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in parts])):
        bits[k * 4 * CHUNK : (k + 1) * 4 * CHUNK] = np.frombuffer(cells, np.uint8)
    return bits


def _mark_of(ids: np.ndarray) -> np.ndarray:
    return (_mixed(ids.view(np.uint64)) % np.uint64(MARKS)).astype(np.int64)


def verified(read: DataFrame, pairs: DataFrame, st: Staging) -> DataFrame:
    """``tid, with``, both ways: those of the pairs ``a, b`` (with rows ``a_row, b_row`` that have these texts) that agree."""
    ids = pairs.select(F.col("a_row").alias("ann_id")).unionByName(pairs.select(F.col("b_row").alias("ann_id"))).distinct()
    shared = read.sparkSession.sparkContext.broadcast(_marks(ids))

    def records(frames):
        for frame in frames:
            at = _mark_of(frame["ann_id"].to_numpy(np.int64))
            hit = frame[(shared.value[at >> 3] >> (at & 7)) & 1 == 1]
            for piece in _pieces([hit]):
                gram, of, names = _triples(piece["title"], piece["abstract"])
                ends = np.searchsorted(of, np.arange(len(piece) + 1))
                grams = [gram[i:j].view(np.int32) for i, j in zip(ends[:-1], ends[1:])]
                yield pd.DataFrame({"tid": names, "grams": pd.Series(grams, dtype=object)})

    texts = read.select("ann_id", "title", "abstract").mapInPandas(records, "tid bigint, grams array<int>")
    agree = F.size(F.array_intersect("grams", "w_grams")) >= F.ceil(F.greatest(F.size("grams"), F.size("w_grams")) * AGREE)
    texts = st.cut(texts.where(F.size("grams") > 0), "records")
    both = pairs.select(F.col("a").alias("tid"), F.col("b").alias("with")).join(texts, "tid").join(texts.select(F.col("tid").alias("with"), F.col("grams").alias("w_grams")), "with")
    found = st.cut(both.where(agree).select("tid", "with").distinct(), "agreeing")
    st.drop(texts)
    return found.unionByName(found.select(F.col("with").alias("tid"), F.col("tid").alias("with")))


def _two_earliest(rows: DataFrame, *by: str) -> DataFrame:
    """Of each group ``by``: the earliest row, and the earliest of another paper id than that.

    Ranks are cut off before the shuffle, too (group limit), so that a hot group is never gathered.
    """
    first = rows.where(F.col(by[0]).isNotNull()).groupBy(*by, "pid").agg(F.min("ann_id").alias("ann_id"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("ann_id"))
    return first.withColumn("rank", rank).where("rank <= 2").drop("rank")


def _resolve(st: Staging, rows: DataFrame, links: DataFrame, first_batch: int) -> DataFrame:
    """``ann_id, batch_no, pid, key, tid, m, is`` of each row: 1 accepted, -1 a repeat; ``m`` is the earliest accepted row that it repeats.

    The first batch is accepted whole; its rows' ``m`` is what a later row with their id and version repeats.
    """
    both = st.cut(links.unionByName(rows.where("tid IS NOT NULL").select("tid", F.col("tid").alias("with")).distinct()), "reach")
    first = F.col("batch_no") == first_batch
    state = rows.select("ann_id", "batch_no", "pid", "key", "tid", F.lit(None).cast("bigint").alias("m"), first.cast("int").alias("is"))
    state, was = st.cut(state, "state"), None
    while True:
        # the texts of accepted and waiting rows that agree with a row's own
        near = state.select(F.col("ann_id").alias("of"), F.col("pid").alias("own"), "tid").join(both, "tid").drop("tid")
        near = near.join(_two_earliest(state.where(F.col("is") >= 0), "tid", "is").withColumnRenamed("tid", "with"), "with")
        near = near.where(~F.col("pid").eqNullSafe(F.col("own")) & (F.col("ann_id") < F.col("of"))).groupBy("of")
        near = near.agg(F.min(F.when(F.col("is") == 1, F.col("ann_id"))).alias("a"), F.min(F.when(F.col("is") == 0, F.col("ann_id"))).alias("w")).withColumnRenamed("of", "ann_id")
        # earlier rows of the same id and version: accepted, waiting, or repeating something already
        before = Window.partitionBy("key").orderBy("ann_id").rowsBetween(Window.unboundedPreceding, -1)
        earlier = lambda c: F.when(F.col("key").isNotNull(), F.min(c).over(before))
        with_key = state.where("key IS NOT NULL").select(
            "*", earlier(F.when(F.col("is") == 1, F.col("ann_id"))).alias("ka"), earlier(F.when(F.col("is") == 0, F.col("ann_id"))).alias("kw"), earlier(F.col("m")).alias("kr"),
        )
        seen = with_key.unionByName(state.where("key IS NULL"), allowMissingColumns=True).join(near, "ann_id", "left")
        found = F.least("m", "a", "ka", "kr")
        waits = F.col("w").isNotNull() | F.col("kw").isNotNull()
        status = F.when(F.col("is") != 0, F.col("is")).when(found.isNotNull(), F.lit(-1)).when(waits, F.lit(0)).otherwise(F.lit(1))
        after = st.cut(seen.select("ann_id", "batch_no", "pid", "key", "tid", found.alias("m"), status.alias("is")), "state")
        moved = after.agg(F.sum((F.col("is") == 0).cast("long")).alias("open"), F.sum(F.coalesce("m", F.lit(0)).cast("decimal(38,0)")).alias("m"), F.count("m").alias("n")).first()
        st.drop(state)
        state = after
        if moved == was:
            return state
        was = moved


def repeats(announcements: DataFrame, first_batch: int = 0) -> DataFrame:
    """``ann_id_1, ann_id_2``: each row of a later batch that repeats an accepted one, and the earliest such."""
    st = Staging(announcements.sparkSession, "batches", drop_shuffles=True)
    pid = paper_id(F.col("id"))
    read = announcements.where(F.col("ann_id").isNotNull() & F.col("batch_no").isNotNull())
    read = read.select("ann_id", "batch_no", pid.alias("pid"), F.when(pid.isNotNull(), F.concat_ws("v", pid, paper_version(F.col("id"), F.col("version")))).alias("key"), "title", "abstract")
    rows, signs, counts = prepare(read, st, first_batch)
    # only the texts of later rows, and of the first batch's rows that have the id and version of one, are looked up
    late = F.col("batch_no") != first_batch
    keys = rows.where(late & F.col("key").isNotNull()).select("key", F.lit(True).alias("asked")).distinct()
    texts = rows.where("tid IS NOT NULL").join(keys, "key", "left").groupBy("tid").agg(F.min("ann_id").alias("row"), F.max(late | F.coalesce("asked", F.lit(False))).alias("asked"), F.count("*").alias("n"))
    texts = st.cut(texts.join(signs, "tid"), "texts")
    pairs = candidates(read, counts, max(PARTS, rows.count() // ROWS))
    for c in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("tid").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("row", "asked", "size", *SIGNS)]), c)
    differ = sum(F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in SIGNS)
    enough = F.col("a_size") + F.col("b_size") - differ >= 2 * F.ceil(F.greatest("a_size", "b_size") * AGREE)
    pairs = st.cut(pairs.where(F.expr("a_asked OR b_asked") & enough).select("a", "b", "a_row", "b_row"), "pairs")
    links = verified(read, pairs, st)
    # all others are accepted, and nothing repeats them
    alike = links.select("tid").unionByName(texts.where("n > 1").select("tid")).distinct().withColumn("alike", F.lit(True))
    several = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("several")).where("several > 1")
    of_some = st.cut(rows.join(alike, "tid", "left").join(several, "key", "left").where("alike OR several > 1").select("ann_id", "batch_no", "pid", "key", "tid"), "of-some")
    st.drop(rows, texts, pairs)
    state = _resolve(st, of_some, links, first_batch)
    return state.where(late & (F.col("is") == -1)).select(F.col("m").alias("ann_id_1"), F.col("ann_id").alias("ann_id_2"))
