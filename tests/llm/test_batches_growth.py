"""Repeats over many batches: the history isn't shuffled again for each, and no pair above the threshold escapes the index."""

import random

import numpy as np
import pytest

from quillstream.llm.batches import AGREE, Postings, _signs, _tokens, repeats

SCHEMA = "ann_id bigint, batch_no int, id string, version string, title string, abstract string"


def cost(spark, rows):
    """Jobs run and MB shuffled."""
    sc = spark.sparkContext._jsc.sc()

    def now():
        executors = sc.statusStore().executorList(True)
        return sc.dagScheduler().numTotalJobs(), sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size())) / 1e6

    before = now()
    found = sorted((r.ann_id_2, r.ann_id_1) for r in repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    return found, *(b - a for a, b in zip(before, now()))


@pytest.fixture(scope="module")
def costs(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(70)) for _ in range(1200)]
    again = [texts[rng.randrange(k)] if k > 600 and k % 9 == 0 else texts[k] for k in range(1200)]
    rows = [(k + 1, 0 if k < 600 else (k - 600) // 75 + 1, f"2001.{k:05d}", None, "T", again[k]) for k in range(1200)]
    return cost(spark, [(a, min(b, 1), *r) for a, b, *r in rows]), cost(spark, rows)


def test_history_is_not_shuffled_again_for_each_batch(costs):
    (found_one, _, shuffled_one), (found_eight, _, shuffled_eight) = costs
    assert found_one == found_eight and len(found_eight) > 50
    # 1,200 texts of 71 triples; 2.6 and 3.1 MB when each batch's texts and the postings before it were shuffled
    assert shuffled_eight < 1.1 * shuffled_one < 1.6


def test_jobs_do_not_grow_with_batches(costs):
    (_, jobs_one, _), (_, jobs_eight, _) = costs
    assert jobs_eight < 1.3 * jobs_one < 300


@pytest.mark.parametrize("size", [1, 2, 3, 5, 6, 9, 10, 26, 27, 44, 45, 72, 153, 154, 255, 256, 300, 1500])
def test_pairs_at_the_threshold_share_a_token(size):
    rng = np.random.default_rng(size)
    for other in {size, max(1, int(np.ceil(size * AGREE))), max(1, int(size * 0.8))}:
        both = int(np.ceil(size * AGREE))
        for _ in range(20):
            grams = rng.choice(1 << 31, size + other, replace=False).astype(np.uint32)
            a, b = grams[:size], np.concatenate([grams[:both], grams[size : size + other - both]])
            gram, of = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            token, text, sizes = _tokens(gram, of, gram % 7, 2)
            assert [len(a), len(b)] == sizes.tolist()
            assert np.intersect1d(token[text == 0], token[text == 1]).size
            signs = _signs(gram, of, 2).view(np.uint64)
            differ = sum(int(x).bit_count() for x in signs[0] ^ signs[1])
            assert differ <= len(a) + len(b) - 2 * both


def test_postings_by_batches_find_what_one_batch_finds():
    rng = np.random.default_rng(3)
    token, text = rng.integers(0, 400, 3000).astype(np.uint64), rng.integers(0, 300, 3000)
    sizes, pairs = np.full(300, 10), []
    for batches in (1, 7):
        index, found = Postings(sizes), set()
        for k in range(batches):
            own = text * batches // 300 == k
            for some in index.batch(token[own], text[own]):
                found.update(some.tolist())
        pairs.append(found)
    want = {min(a, b) << 32 | max(a, b) for t in range(400) for a in text[token == t].tolist() for b in text[token == t].tolist() if a != b}
    assert pairs == [want, want]
