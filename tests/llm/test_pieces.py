"""Pieces of long items: within the limit, whole, overlapping, and off a boundary only where none exists."""

import random
import re

import __spark_entry__ as entry
from quillstream.llm.pieces import MARKS, SPACE, cut_text, cut_times, pieces


def test_queries_are_registered():
    assert {"p1_found", "p1_pieces"} <= set(entry.queries())
    assert "p1_found" in entry.oracle_sql()


def whole(cuts, length, limit, overlap):
    assert cuts[0][0] == 0 and cuts[-1][1] == length
    assert all(0 < b - a <= limit for a, b, _ in cuts)
    for (a, b, _), (c, d, _) in zip(cuts, cuts[1:]):
        assert a < c <= b < d and b - c <= overlap


def test_text_is_cut_at_boundaries_wherever_one_exists():
    rng = random.Random(1)
    for _ in range(300):
        words = ["x" * rng.randint(1, rng.choice([5, 30, 40])) + rng.choice(["", ".", "。", "?\n\n"]) for _ in range(rng.randint(1, 60))]
        text = rng.choice([" ", "  ", "　"]).join(words)
        cuts = cut_text(text, limit=40, overlap=8)
        whole(cuts, len(text), 40, 8)
        for _, b, natural in cuts[:-1]:
            assert natural == bool(re.search(f"[{SPACE}{MARKS}]", text[b - 1 : b + 1]))
        must = max(map(len, re.split(f"[{SPACE}{MARKS}]", text))) > 40
        assert must or all(natural for *_, natural in cuts)


def test_unbroken_run_is_cut_with_overlap():
    cuts = cut_text("x" * 100, limit=40, overlap=8)
    whole(cuts, 100, 40, 8)
    assert [natural for *_, natural in cuts] == [False, False, True]


def test_times_are_cut_outside_segments():
    rng = random.Random(2)
    for _ in range(300):
        at, segments = 0, []
        for _ in range(rng.randint(1, 30)):
            at += rng.choice([0, 0, 5, 60])
            segments.append((at, at := at + rng.randint(1, 50)))
        length = at + rng.randint(0, 5)
        cuts = cut_times(length, rng.sample(segments, len(segments)), limit=50, overlap=4)
        whole(cuts, length, 50, 4)
        assert all(natural for *_, natural in cuts)
        assert not any(a < b < c for _, b, _ in cuts for a, c in segments)
        assert not any(a < s < c for s, _, _ in cuts for a, c in segments)


def test_recording_without_segments_is_cut_whole():
    cuts = cut_times(700_000, [])
    whole(cuts, 700_000, 300_000, 2_000)
    assert len(cuts) == 3


def test_pieces_hold_every_word(spark):
    text = " ".join(f"word{i}." for i in range(2_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    said = [(i * 10.0, i * 10.0 + 9, f"s{i}") for i in range(100)]
    long_one = [(0.0, 700.0, " ".join(f"w{i}" for i in range(700)))]
    chunks = spark.createDataFrame(
        [
            (1, 5.0, 1005.0, "t", list(reversed(said)), 1),
            (1, 5.0, 1005.0, "t", said, 2),
            (2, 0.0, 700.0, " ".join(f"w{i}" for i in range(700)), None, 1),
            (3, 0.0, 700.0, "t", long_one, 1),
            (4, 0.0, 300.0001, "t", None, 1),
        ],
        "chunk_id bigint, start_s double, end_s double, text string, segments array<struct<start_s:double,end_s:double,text:string>>, fetched_at int",
    )
    out = pieces(docs, chunks).collect()
    of = lambda kind, i: sorted((r for r in out if (r.item_kind, r.item_id) == (kind, i)), key=lambda r: r.piece_no)
    rows = of("document", 1)
    assert all(r.text == text[int(r.start) : int(r.end)] and r.cut_at_boundary for r in rows)
    assert {w for r in rows for w in r.text.split()} == set(text.split())
    assert not of("document", 2) and not of("audio_chunk", 4)
    assert {w for r in of("audio_chunk", 1) for w in r.text.split()} == {t for *_, t in said}
    for i in (2, 3):
        assert {w for r in of("audio_chunk", i) for w in r.text.split()} == {f"w{i}" for i in range(700)}
        assert all(r.end - r.start <= 300.0005 for r in of("audio_chunk", i))
