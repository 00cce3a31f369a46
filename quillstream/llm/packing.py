"""Filling containers of fixed capacity by a configuration linear program (problem 6).

Sizes are tokens of a public tokenizer. What the program sees is the histogram of sizes, at most
``capacity`` numbers however many items there are. Its columns are configurations (multisets of sizes
that fit a container). Multiplicative weights price the sizes, a knapsack dynamic program finds the
most valuable configuration at these prices, and the average of the configurations found is a near
optimal fractional packing, whose prices give a lower bound on the number of containers. Whole parts
are kept, the few items left are packed best fit decreasing, by sizes.

The plan says for each run of equal containers how many items of each size it holds. Items get their
place by their rank among those of their size, counted in two levels (blocks of a hash, then within),
so that no size is one window.

Defined results: an item above the capacity is split into full pieces and a rest, the only items to be
split; sizes of 0 and null texts are placed in no container; an empty table gives none; repeated rows
are items of their own if their ids differ, and one item if the whole id repeats.
"""

from __future__ import annotations

import base64
import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.staging import Staging

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Cuts texts before byte pairs are merged; the customary pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Rounds of multiplicative weights at most, and the step of a weight.
ROUNDS, BOUND_ROUNDS, STEP = 400, 60, 0.15
RANK_BLOCK = 1 << 10


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, *keep: str) -> DataFrame:
    """``doc_id``, the columns ``keep`` and ``tokens`` of each document; a null text has none. The file must be on every worker."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for frame in frames:
            out = frame.drop(columns="text")
            out["tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in frame["text"]]
            yield out

    read = documents.where(F.col("doc_id").isNotNull()).select("doc_id", *keep, "text")
    fields = ", ".join(f"{c} {read.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return read.mapInPandas(counted, f"{fields}, tokens bigint")


def best_configuration(sizes: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of the greatest value: a bounded knapsack by dynamic programming over the capacity.

    The copies of a size are taken in powers of two, each a single choice.
    """
    value = np.zeros(capacity + 1)
    choices: list[tuple[int, int, np.ndarray]] = []
    for size, price, limit in zip(sizes.tolist(), prices.tolist(), most.tolist()):
        left, copies = min(limit, capacity // size), 1
        while left > 0:
            take = min(copies, left)
            width, gain = take * size, take * price
            better = value[: capacity + 1 - width] + gain
            taken = better > value[width:] + 1e-15
            if taken.any():
                value[width:] = np.where(taken, better, value[width:])
                choices.append((size, take, taken))
            left, copies = left - take, copies * 2
    at, out = int(np.argmax(value)), Counter()
    for size, take, taken in reversed(choices):
        width = size * take
        if at >= width and taken[at - width]:
            out[size] += take
            at -= width
    return dict(out)


def _coarse(histogram: dict[int, int], capacity: int, classes: int = 160) -> list[tuple[int, int, list[int]]]:
    """Size classes for pricing: ``(largest size, items, sizes)``, so that a class always fits where its largest size does."""
    sizes = sorted(histogram)
    if len(sizes) <= classes:
        return [(s, histogram[s], [s]) for s in sizes]
    per = sum(histogram[s] * s for s in sizes) / classes
    out, run, load = [], [], 0.0
    for s in sizes:
        run.append(s)
        load += histogram[s] * s
        if load >= per:
            out.append((run[-1], sum(histogram[x] for x in run), run))
            run, load = [], 0.0
    if run:
        out.append((run[-1], sum(histogram[x] for x in run), run))
    return out


def fractional_packing(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations with their multiplicities, and a lower bound on the containers, by multiplicative weights.

    The weights grow for sizes that the configurations found so far serve too little. For any prices,
    (items x prices) / (best configuration's value) bounds the optimum from below.
    """
    sizes = np.array(sorted(histogram))
    need = np.array([histogram[s] for s in sizes.tolist()], float)
    least = float((sizes * need).sum()) / capacity
    index = {s: i for i, s in enumerate(sizes.tolist())}
    weights, served = sizes / capacity, np.zeros(len(sizes))
    found: Counter = Counter()
    bound = least
    for _ in range(rounds):
        config = best_configuration(sizes, weights, need.astype(int), capacity)
        got = np.zeros(len(sizes))
        for s, k in config.items():
            got[index[s]] = k
        value = float((got * weights).sum())
        bound = max(bound, float((need * weights).sum()) / max(value, 1e-12) * (1 - 1e-9))
        found[tuple(sorted(config.items()))] += 1
        served += got / need
        share = served / max(served.mean(), 1e-12)
        weights = sizes / capacity * np.exp(-STEP * (share - 1).clip(-8, 8) * 8)
        if share.min() > 0.98:
            break
    # so often that no size is served beyond its items
    use = np.zeros(len(sizes))
    for config, times in found.items():
        for s, k in config:
            use[index[s]] += k * times
    scale = float((need[use > 0] / use[use > 0]).min()) if (use > 0).any() else 0.0
    return [(dict(c), n * scale) for c, n in found.items()], bound


def best_fit(items: Counter, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Containers for ``items`` (size: number) by best fit decreasing; equal containers are made at once."""
    left = Counter({s: n for s, n in items.items() if n > 0})
    out: list[tuple[dict[int, int], int]] = []
    sizes = sorted(left)
    while sizes:
        room, config = capacity, Counter()
        i = len(sizes) - 1
        while i >= 0:
            s = sizes[i]
            take = min(left[s], room // s)
            if take:
                config[s] += take
                room -= take * s
            i = bisect.bisect_right(sizes, min(room, s - 1)) - 1
        times = min(left[s] // k for s, k in config.items())
        for s, k in config.items():
            left[s] -= k * times
            if not left[s]:
                sizes.remove(s)
        out.append((dict(config), times))
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], float]:
    """``(configuration, containers)`` that take every item of ``histogram``, and the lower bound of the program."""
    histogram = {int(s): int(n) for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    if not histogram:
        return [], 0.0
    left, out = Counter(histogram), []
    classes = _coarse(histogram, capacity)
    largest = {top: sizes for top, _, sizes in classes}
    configurations, bound = fractional_packing({top: n for top, n, _ in classes}, capacity)
    if len(classes) < len(histogram):
        # classes were priced by their largest size; the bound is that of the program with their smallest
        smallest: Counter = Counter()
        for _, n, sizes in classes:
            smallest[sizes[0]] += n
        bound = max(sum(s * n for s, n in histogram.items()) / capacity, fractional_packing(smallest, capacity, BOUND_ROUNDS)[1])
    for config, times in configurations:
        times = int(times)
        # each turn ends the configuration or uses up a size, so the turns don't grow with the items
        while times > 0:
            chosen = Counter()
            for top, k in config.items():
                for s in reversed(largest[top]):
                    take = min(k, left[s])
                    chosen[s] += take
                    k -= take
                    if not k:
                        break
            chosen = +chosen
            if not chosen:
                break
            _fill(chosen, left, capacity - sum(s * n for s, n in chosen.items()))
            count = min(times, *(left[s] // n for s, n in chosen.items()))
            left.subtract({s: n * count for s, n in chosen.items()})
            out.append((dict(chosen), count))
            times -= count
    out += best_fit(left, capacity)
    return out, bound


def _fill(chosen: Counter, left: Counter, room: int) -> None:
    """Add what still fits into a container, the largest first."""
    free = sorted(s for s, n in left.items() if n > chosen[s] and s <= room)
    while free and room >= free[0]:
        i = bisect.bisect_right(free, room) - 1
        if i < 0:
            return
        s = free[i]
        chosen[s] += 1
        room -= s
        if left[s] <= chosen[s]:
            free.pop(i)


def _ranked(pieces: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its size, by two-level counts."""
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(RANK_BLOCK)))
    counts = blocked.groupBy("size", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("size", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("size", "block").orderBy("doc_id", "piece_no")
    return blocked.join(counts, ["size", "block"]).select("doc_id", "piece_no", "size", (F.col("base") + F.row_number().over(within) - 1).alias("rank"))


def pieces_of(tokens: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece_no, start, size``: each item whole, or full pieces and a rest if it exceeds the capacity."""
    items = tokens.where(F.col("tokens") > 0).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    cut = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int"))))
    start = F.col("piece_no").cast("bigint") * capacity
    return cut.select("doc_id", "piece_no", start.alias("start"), F.least(F.lit(capacity), F.col("tokens") - start).cast("int").alias("size"))


def pack(tokens: DataFrame, capacity: int, st: Staging | None = None) -> tuple[DataFrame, float]:
    """``doc_id, piece_no, start, size, container`` of each piece, and the lower bound on the containers.

    ``tokens`` holds ``doc_id, tokens``. Only the histogram (at most ``capacity`` rows) and the plan leave the cluster.
    """
    st = st or Staging(tokens.sparkSession, "packing")
    pieces = st.cut(pieces_of(tokens, capacity), f"pieces-{capacity}")
    histogram = {r.size: r.n for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}
    planned, bound = plan(histogram, capacity)
    rows, first_container, first_rank = [], 0, Counter()
    for config, count in planned:
        for size, k in config.items():
            rows.append((size, first_rank[size], first_rank[size] + k * count, k, first_container))
            first_rank[size] += k * count
        first_container += count
    # runs of one size, to be found by the rank: as arrays sorted by their first rank, one row a size
    runs = pd.DataFrame(rows, columns=["size", "first", "last", "each", "container"])
    by_size = {s: (g["first"].to_numpy(), g["each"].to_numpy(), g["container"].to_numpy()) for s, g in runs.groupby("size")}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.zeros(len(frame), np.int64)
            for size, rows_of in frame.groupby("size").indices.items():
                first, each, container = by_size[size]
                rank = frame["rank"].to_numpy()[rows_of]
                i = np.searchsorted(first, rank, side="right") - 1
                out[rows_of] = container[i] + (rank - first[i]) // each[i]
            yield frame.assign(container=out).drop(columns="rank")

    placed = _ranked(pieces).mapInPandas(place, "doc_id bigint, piece_no int, size int, container bigint")
    return placed.select("doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start"), "size", "container"), bound


def pack_all(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``limit_id, container, doc_id, piece_no, start, size`` for each of the container sizes ``pack_`` of ``limits``."""
    st = Staging(documents.sparkSession, "packing")
    tokens = st.cut(count_tokens(documents, tokenizer), "tokens")
    out = None
    for row in limits.where(F.col("limit_id").startswith("pack_") & (F.col("max_size") >= 1)).orderBy("limit_id").collect():
        placed = pack(tokens, int(row.max_size), st)[0]
        part = placed.select(F.lit(row.limit_id).alias("limit_id"), "container", "doc_id", "piece_no", "start", "size")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], "limit_id string, container bigint, doc_id bigint, piece_no int, start bigint, size int")


def waste(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """For each container size: containers used, the program's lower bound, tokens and the share left unused."""
    st = Staging(documents.sparkSession, "packing")
    tokens = st.cut(count_tokens(documents, tokenizer), "tokens")
    out = None
    for row in limits.where(F.col("limit_id").startswith("pack_") & (F.col("max_size") >= 1)).orderBy("limit_id").collect():
        capacity = int(row.max_size)
        placed, bound = pack(tokens, capacity, st)
        used = placed.groupBy("container").agg(F.sum("size").alias("filled"), F.count("*").alias("n"))
        report = used.agg(
            F.count("*").alias("containers"), F.sum("filled").alias("tokens"), F.coalesce(F.max("filled"), F.lit(0)).alias("fullest"), F.sum("n").alias("pieces")
        ).select(F.lit(row.limit_id).alias("limit_id"), F.lit(capacity).alias("capacity"), "containers", F.lit(bound).alias("lower_bound"), "pieces", "tokens", "fullest")
        report = report.withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * capacity))
        out = report if out is None else out.unionByName(report)
    return out
