"""Main bodies: suffix ranks against brute force, a small web of sites, and defined results."""

import random

import numpy as np

from quillstream.llm.boilerplate import boilerplate_lines, main_bodies, suffix_ranks

WORDS = "river engine garden letter window market copper violin harbour lantern meadow basket planet ticket".split()


def test_suffix_ranks_order_all_suffixes():
    rng = np.random.default_rng(1)
    for n, k in ((1, 2), (7, 1), (200, 2), (300, 5)):
        tokens = rng.integers(0, k, n)
        rank = suffix_ranks(tokens, longest=512)[-1]
        want = sorted(range(n), key=lambda i: tuple(tokens[i:]))
        assert [int(i) for i in np.argsort(rank, kind="stable")] == want


def pages_of(rng, site, n, first):
    out = []
    for i in range(n):
        name = "".join(rng.choice("abdeiklmorst") for _ in range(9)).capitalize()
        title = f"How {name} met the {rng.choice(WORDS)}"
        body = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(12, 25))).capitalize() + "." for _ in range(3)]
        lines = ["Home | World | Books | About", "", title, "Share this", body[0], f"Read also: {rng.choice(WORDS)} and {rng.choice(WORDS)} {i}", body[1], body[2]]
        lines += [f"{rng.randint(2, 900)} comments", f"{site.title()} takes no liability for the content of other pages.", "© 2024 All rights reserved."]
        out.append((first + i, f"https://www.{site}.example/{first + i}", f"www.{site}.example", title if i % 3 else None, "\n".join(lines)))
    return out


def test_bodies_on_frequent_and_rare_sites(spark):
    rng = random.Random(3)
    rows = pages_of(rng, "bigpost", 60, 0) + pages_of(rng, "midnews", 12, 100) + pages_of(rng, "oldkurier", 12, 200) + pages_of(rng, "rarenet", 1, 300)
    rows.append(rows[5])  # fetched again
    rows.append((400, "https://www.copyist.example/x", "www.copyist.example", rows[7][3], rows[7][4].replace("Bigpost", "Copyist")))  # a repost
    frame = spark.createDataFrame([(*r, 7) for r in rows], "page_id bigint, url string, site string, title string, text string, line_no int")
    found = {(r.page_id, r.line_no) for r in boilerplate_lines(frame).collect()}
    assert found == {(r[0], n) for r in rows for n in (1, 4, 6, 9, 10, 11)}
    bodies = {r.page_id: r.body for r in main_bodies(frame.where("page_id <> 5")).collect()}
    assert bodies[300].split("\n")[0].startswith("How ") and len(bodies[300].split("\n")) == 4


def test_defined_results(spark):
    schema = "page_id bigint, url string, site string, title string, text string"
    rows = [(1, None, None, None, None), (2, None, "s", None, ""), (3, None, None, None, "\n \n"), (4, "u", "s", None, "Only a line of text here, which ends well."), (5, "v", "s", "T", "x" * 100_000)]
    frame = spark.createDataFrame(rows, schema)
    assert boilerplate_lines(frame).where("page_id < 5").collect() == []
    assert boilerplate_lines(frame.limit(0)).count() == 0
