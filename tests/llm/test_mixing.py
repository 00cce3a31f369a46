"""Mixing: thresholds against sorting, shares reached, caps on repeats, and defined results."""

import random

from quillstream.llm.mixing import mix, shares, thresholds

TOKENS = "doc_id bigint, source string, tokens bigint, copies string"


def test_thresholds_against_sorting(spark):
    rng = random.Random(1)
    rows = [(s, rng.randint(1, 50), rng.randrange(1 << 60)) for s in "ab" for _ in range(400)] + [("a", 10_000, 1 << 40)] + [("b", 3, 77)] * 5
    frame = spark.createDataFrame(rows, "source string, tokens bigint, hash bigint")
    for share in (0.0001, 0.3, 0.9999, 1.5):
        budgets = {s: share * sum(n for x, n, _ in rows if x == s) for s in "ab"}
        ends = thresholds(frame, budgets)
        for s in "ab":
            mine = sorted((h, n) for x, n, h in rows if x == s)
            drawn = sum(n for h, n in mine if h < ends[s])
            cuts, total = [0], 0
            for i, (h, n) in enumerate(mine):
                total += n
                if i + 1 == len(mine) or mine[i + 1][0] != h:
                    cuts.append(total)
            assert drawn in cuts and abs(drawn - budgets[s]) <= min(abs(c - budgets[s]) for c in cuts) + 1e-6


def test_shares_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, "big", rng.randint(1, 20), "x") for i in range(4_000)] + [(10_000 + i, "small", rng.randint(1, 20), "x") for i in range(60)]
    rows += [(20_000, "other", 5, "x"), (20_001, None, 5, "x"), (20_002, "big", 0, "x"), (20_003, "big", None, "x")]
    tokens = spark.createDataFrame(rows, TOKENS)
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    drawn, total = mix(tokens, targets)
    out = drawn.collect()
    of = lambda s: sum(r.tokens * r.copies for r in out if r.source == s)
    assert abs(of("big") - 0.6 * total) <= 20 and abs(of("small") - 0.3 * total) <= 20
    assert {r.source for r in out} == {"big", "small"} and max(r.copies for r in out if r.source == "small") == 3
    assert all(r.copies <= 2 for r in out if r.source == "big")
    more = {r.doc_id: r.copies for r in mix(tokens, targets, total=1.5 * total)[0].collect()}
    assert all(more[r.doc_id] >= r.copies for r in out)
    assert mix(tokens.limit(0), targets)[0].count() == 0 and mix(tokens, targets.limit(0))[0].count() == 0


def test_report(spark):
    docs = spark.createDataFrame([(i, "some words here", "a" if i % 2 else "b") for i in range(40)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 1), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in shares(docs, targets).collect()}
    assert report["none"].tokens == 0 and report["none"].actual_share == 0 and report["none"].missing_tokens > 0
    assert abs(report["a"].actual_share + report["b"].actual_share - 1) < 1e-9 and report["a"].draws == 20 and report["b"].draws == 16
