"""Mixing sources to target weights by hash-threshold histograms (problem 7).

Each document has a fixed hash. Tokens are summed by source and bucket of the hash's leading bits; the
bucket in which a source's budget ends is the only one that is summed again by the next bits, until the
budget lies between two neighbouring documents. A document is drawn once more than its source's whole
repeats if its hash lies below the threshold. Nothing is sorted, and what reaches the driver are
sources x buckets sums. A larger budget only ever adds documents, as thresholds of one hash are nested.

Defined results: the total is the largest at which every source that has documents reaches its share
within its repeats, unless ``total`` is given; then a source that is too small gives all it has, as often
as it may, and the report shows what is missing. Sources without documents or without a target give
nothing; documents of no tokens and null sources or texts are not drawn; targets of a null or negative
share or repeats count as 0; a source's target may not be given twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.packing import TOKENIZER, count_tokens
from quillstream.staging import Staging

#: Bits of the hash that a histogram resolves, and all bits used.
STEP_BITS, ALL_BITS = 10, 60


def _hash(seed: int):
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - ALL_BITS)


def thresholds(tokens: DataFrame, budgets: dict[str, float]) -> dict[str, int]:
    """The hash below which the tokens of each source come nearest to its budget.

    ``tokens`` holds ``source, tokens, hash``. Each round sums only the rows of the buckets where budgets end.
    """
    done, low, spent, bits = {}, dict.fromkeys(budgets, 0), dict.fromkeys(budgets, 0), 0
    open_sources = set(budgets)
    while open_sources:
        bits += STEP_BITS
        prefix = F.shiftright("hash", ALL_BITS - bits)
        at = None
        for source in sorted(open_sources):
            same = F.col("source") == source
            if bits > STEP_BITS:
                same = same & (F.shiftright("hash", ALL_BITS - bits + STEP_BITS) == low[source] >> (ALL_BITS - bits + STEP_BITS))
            at = same if at is None else at | same
        sums = tokens.where(at).groupBy("source", prefix.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
        for source in sorted(open_sources):
            for row in sorted((r for r in sums if r.source == source), key=lambda r: r.bucket):
                if spent[source] + row.tokens <= budgets[source]:
                    spent[source] += row.tokens
                    continue
                low[source] = row.bucket << (ALL_BITS - bits)
                if row.n == 1 or bits >= ALL_BITS:
                    # the last document is drawn if that comes nearer to the budget
                    nearer = budgets[source] - spent[source] > row.tokens / 2
                    done[source] = low[source] + (1 << (ALL_BITS - bits)) if nearer else low[source]
                    open_sources.discard(source)
                break
            else:
                done[source] = 1 << ALL_BITS if bits == STEP_BITS else low[source] + (1 << (ALL_BITS - bits + STEP_BITS))
                open_sources.discard(source)
    return done


def _plan(tokens: DataFrame, targets: DataFrame, total: float | None) -> tuple[dict[str, tuple[float, int, int]], dict[str, int], float]:
    """Targets, tokens of each source, and the total."""
    wanted = {r.source: (max(float(r.target_share or 0), 0.0), max(int(r.max_repeats or 0), 0)) for r in targets.where(F.col("source").isNotNull()).collect()}
    known = tokens.where(F.col("source").isin(list(wanted))) if wanted else tokens.limit(0)
    have = {r.source: r.tokens for r in known.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    reach = [repeats * have[s] / share for s, (share, repeats) in wanted.items() if share > 0 and have.get(s)]
    return wanted, have, total if total is not None else min(reach, default=0.0)


def mix(tokens: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> tuple[DataFrame, float]:
    """``doc_id, source, tokens, copies`` of each document drawn, and the total aimed at. ``tokens`` holds ``doc_id, source, tokens``."""
    st = Staging(tokens.sparkSession, "mixing")
    rows = tokens.where("source IS NOT NULL AND tokens > 0").select("doc_id", "source", "tokens", _hash(seed).alias("hash"))
    rows = st.cut(rows, "hashed")
    wanted, have, total = _plan(rows, targets, total)
    whole, budgets = {}, {}
    for source, (share, repeats) in wanted.items():
        held = have.get(source, 0)
        if not held:
            continue
        times = min(share * total / held, float(repeats))
        whole[source] = min(int(times + 1e-9), repeats)
        if whole[source] < repeats and (times - whole[source]) * held > 0:
            budgets[source] = (times - whole[source]) * held
    ends = thresholds(rows, budgets) if budgets else {}
    copies = F.lit(0)
    for source, times in whole.items():
        copies = F.when(F.col("source") == source, F.lit(times) + (F.col("hash") < ends.get(source, 0)).cast("int")).otherwise(copies)
    return rows.select("doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0"), total


def _tokens(documents: DataFrame, tokenizer: str) -> DataFrame:
    return count_tokens(documents, tokenizer, "source")


def mix_documents(documents: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens, copies``: how often each document is drawn."""
    return mix(_tokens(documents, tokenizer), targets, total)[0]


def shares(documents: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """For each source its target, what was drawn, the share reached and the tokens missing to its target."""
    drawn, aimed = mix(_tokens(documents, tokenizer), targets, total)
    by = drawn.groupBy(F.col("source").alias("of")).agg(
        F.count("*").alias("documents"), F.sum("copies").alias("draws"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens")
    )
    # one row, of one number
    all_tokens = by.agg(F.sum("tokens").alias("all_tokens")).first().all_tokens or 0
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").join(by, F.col("source") == F.col("of"), "left")
    return joined.select(
        "source", "target_share", "max_repeats", zero("documents"), zero("draws"), zero("most_copies"), zero("tokens"),
        (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(all_tokens, 1)))).alias("actual_share"),
        F.greatest(F.lit(0.0), F.col("target_share") * F.lit(float(aimed)) - F.coalesce("tokens", F.lit(0))).alias("missing_tokens"),
    )
