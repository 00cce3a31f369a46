"""Packing: bounds, every item placed once, only oversized items split, few sizes and many, and defined results."""

import random
from collections import Counter

import numpy as np

from quillstream.llm.packing import best_configuration, count_tokens, pack, plan


def test_best_configuration_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        capacity, sizes = rng.randint(5, 30), sorted(rng.sample(range(1, 15), 3))
        prices, most = [rng.random() for _ in sizes], [rng.randint(1, 5) for _ in sizes]
        found = best_configuration(np.array(sizes), np.array(prices), np.array(most), capacity)
        worth = lambda ks: sum(k * p for k, p in zip(ks, prices))
        every = [(a, b, c) for a in range(most[0] + 1) for b in range(most[1] + 1) for c in range(most[2] + 1) if a * sizes[0] + b * sizes[1] + c * sizes[2] <= capacity]
        ks = [found.get(s, 0) for s in sizes]
        assert sum(k * s for k, s in zip(ks, sizes)) <= capacity and all(k <= m for k, m in zip(ks, most))
        assert abs(worth(ks) - max(map(worth, every))) < 1e-9


def test_plan_takes_every_item_near_the_bound():
    rng = random.Random(2)
    for histogram, capacity in (
        ({7: 300, 3: 300}, 10), ({6: 1_000}, 10), (dict(Counter(rng.randint(1, 500) for _ in range(20_000))), 1_000),
        ({s: n * 10**7 for s, n in Counter(min(400, int(rng.lognormvariate(4, 1)) + 1) for _ in range(9_000)).items()}, 512), ({5: 1}, 5), ({}, 5),
    ):
        planned, bound = plan(histogram, capacity)
        taken = Counter()
        for config, n in planned:
            assert sum(s * k for s, k in config.items()) <= capacity
            taken.update({s: k * n for s, k in config.items()})
        used = sum(n for _, n in planned)
        assert taken == Counter(histogram) and bound <= used + 1e-6 <= bound * 1.02 + 2
        assert len(planned) < 20_000


def test_packed_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([40] * 3 + [rng.randint(1, 90)]), "x") for i in range(3_000)] + [(5_000, 1_234, "x"), (5_001, 0, "x"), (7, 1, "x"), (None, 5, "x")]
    tokens = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, container string").where("doc_id IS NOT NULL")
    placed, bound = pack(tokens, 100)
    out = placed.collect()
    sizes, filled, parts = {}, Counter(), Counter()
    for i, n, _ in rows:
        if i is not None:
            sizes[i] = max(n, sizes.get(i, 0))
    got = Counter()
    for r in out:
        filled[r.container] += r.size
        got[r.doc_id] += r.size
        parts[r.doc_id] += 1
    assert got == Counter({i: n for i, n in sizes.items() if n}) and max(filled.values()) <= 100
    assert {i for i, k in parts.items() if k > 1} == {5_000} and parts[5_000] == 13
    assert sorted(filled) == list(range(len(filled))) and len(filled) <= bound * 1.04 + 2
    assert pack(tokens.limit(0), 100)[0].count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "two words", 3), (2, None, 3), (3, "", 3), (None, "x", 3), (4, "<|endoftext|>", 3)], "doc_id bigint, text string, tokens int")
    counts = {r.doc_id: r.tokens for r in count_tokens(docs).collect()}
    assert counts[1] == 2 and counts[2] == counts[3] == 0 and counts[4] > 1 and None not in counts
