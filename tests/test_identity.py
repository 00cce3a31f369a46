"""Fingerprints and keep-first dedupe on a small table."""

import hashlib

import __spark_entry__ as entry


def test_fingerprints_and_keep_first(spark, tmp_path):
    rows = [(3, "x", "a", "web"), (1, "é\n", "b", "web"), (2, "x", "c", "feed"), (4, None, "d", "web"), (5, None, None, "web"), (6, "X", "e", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, id string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert run("op3_fingerprints") == sorted([(sha("x"), 2, 2), (sha("é\n"), 1, 1), (sha("X"), 6, 1)])
    assert [r[:2] for r in run("op4_keep_first")] == [(1, "b"), (2, "c"), (4, "d"), (5, None), (6, "e")]
