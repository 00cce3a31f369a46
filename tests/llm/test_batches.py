"""Repeats over batches: against a sequential run by hand, ids however written, copies of copies, and defined results."""

import random

from pyspark.sql import functions as F

from quillstream.llm.batches import paper_id, paper_version, repeats, words_of

SCHEMA = "ann_id bigint, batch_no int, id string, version string, title string, abstract string, tid string"
VOCABULARY = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ado", "eri", "ilu", "ona", "umi", "esto", "avar", "olin")]


def work(rng, n=60):
    return [rng.choice(VOCABULARY) + rng.choice(["", "s", "ed", "er"]) for _ in range(n)]


def edited(rng, words, k=4):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = "changed"
    return out


def test_ids_and_versions(spark):
    given = [("arXiv:1702.00243v1", None), (" 1702.00243 ", "V2"), ("https://preprints.example/pdf/hep-ph/9903005v1.pdf", None), ("ARXIV: math.AG/9801002", "3"), ("oai:x.example:1805.00928", None), ("Odd One", "v2"), (None, None), ("", "")]
    rows = spark.createDataFrame(given, "id string, version string").select(paper_id(F.col("id")).alias("p"), paper_version(F.col("id"), F.col("version")).alias("v")).collect()
    assert [tuple(r) for r in rows] == [("1702.00243", 1), ("1702.00243", 2), ("hep-ph/9903005", 1), ("math.ag/9801002", 3), ("1805.00928", 1), ("odd one", 2), (None, 1), (None, 1)]
    assert words_of("A &amp; <b>B</b>  é", "\\emph{x_1}\n$y$") == ["a", "b", "e", "x", "1", "y"]


def test_batches_in_order(spark):
    rng = random.Random(5)
    one, two, three, four = (work(rng) for _ in range(4))
    join = " ".join
    rows = [
        (1, 0, "1001.00001", "v1", "T", join(one), "x"),
        (2, 0, "1001.00002v1", None, "T", join(two), "x"),
        (3, 0, "1001.00003", None, "T", join(edited(rng, one)), "x"),  # a copy within the history is accepted with it
        (10, 1, "arXiv:1001.00001v1", None, "T", join(one), "x"),  # the same version
        (11, 1, "1001.00001", "2", "T", join(one), "x"),  # another version, but also the work of row 3
        (12, 1, "1001.00009", "v1", "t", join(edited(rng, two)).upper(), "x"),  # a copy-edited repost
        (13, 1, "1001.00009", "v1", "other", join(work(rng)), "x"),  # the same id and version as that copy
        (14, 1, "1001.00003", "v1", "T", join(work(rng)), "x"),  # as a copy within the history: repeats what that copies
        (15, 1, "1001.00020", "v1", "T", join(three), "x"),
        (16, 1, "1001.00021", "v1", "T", join(edited(rng, three)), "x"),  # repeats a row of its own batch
        (17, 1, "1001.00022", "v1", "T", join(three[:20] + work(rng, 40)), "x"),  # shares a sentence
        (20, 2, "1001.00023", "v1", "T", join(three), "x"),
        (21, 2, "1001.00009", "v2", "T", join(two), "x"),
        (22, 2, "1001.00024", "v1", None, None, "x"), (23, 2, None, None, "", "", "x"), (24, 2, "1001.00024", "v1", None, "", "x"), (25, 2, None, None, None, None, "x"),
        (26, 2, "1001.00030", "v1", "T", join(four), "x"), (26, 2, "1001.00030", "v1", "T", join(four), "x"),
        (None, 2, "1001.00001", "v1", "T", join(one), "x"), (27, None, "1001.00001", "v1", "T", join(one), "x"),
        *[(100 + i, 2, f"1001.01{i:03d}", "v1", "T", join(four), "x") for i in range(30)],  # a third of all rows are one text
    ]
    found = sorted((r.ann_id_2, r.ann_id_1) for r in repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [(10, 1), (11, 3), (12, 2), (13, 2), (14, 1), (16, 15), (20, 15), (21, 2), (24, 22), *[(100 + i, 26) for i in range(30)]]


def test_empty_table(spark):
    assert repeats(spark.createDataFrame([], SCHEMA)).collect() == []
