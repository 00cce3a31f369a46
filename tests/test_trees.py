"""Tree labels and their expansion against brute force."""

import random

import __spark_entry__ as entry
from pyspark.sql import functions as F
from quillstream.operators.hierarchy import expand_descendants, expand_paths, label_trees


def forest(seed: int, n: int) -> dict[int, int | None]:
    """Bushy and deep parts; every parent is the smaller id."""
    rng = random.Random(seed)
    return {i: None if i % 37 == 0 else rng.choice([i - 1, rng.randrange(i)]) for i in range(n)}


def path_of(parents: dict[int, int | None], i: int) -> list[int]:
    path = [i]
    while parents.get(path[0]) is not None:
        path.insert(0, parents[path[0]])
    return path


def frame(spark, parents):
    return spark.createDataFrame(list(parents.items()), "id bigint, parent bigint")


def test_paths_and_descendants_expand_to_brute_force(spark):
    parents = forest(1, 150)
    labels = label_trees(frame(spark, parents), detail=True)
    want = {i: path_of(parents, i) for i in parents}
    assert {r.id: list(r.path) for r in expand_paths(labels).collect()} == want
    pairs = [tuple(r) for r in expand_descendants(labels).select("ancestor", "descendant").collect()]
    assert sorted(pairs) == sorted((a, i) for i, path in want.items() for a in path[:-1])


def test_expansions_go_by_blocks(spark):
    parents = {i: i - 1 if i else None for i in range(40)} | {100: 5, 101: 100, 50: 51, 51: 50, 52: 51}
    labels = label_trees(frame(spark, parents), detail=True)
    ring = {50: [50], 51: [50, 51], 52: [50, 51, 52]}
    want = {i: ring.get(i) or path_of(parents, i) for i in parents}
    assert {r.id: list(r.path) for r in expand_paths(labels, block=7).collect()} == want
    pairs = [tuple(r) for r in expand_descendants(labels, block=7).collect()]
    trees = [(a, i) for i, path in want.items() if i not in ring for a in path[:-1]]
    assert sorted(pairs) == sorted([*trees, (50, 51), (50, 52), (51, 50), (51, 52)])


def test_compact_queries_hold_paths_and_descendants(spark, tmp_path):
    parents = forest(2, 100)
    rows = [(i, [k for k, p in parents.items() if p == i]) for i in parents]
    spark.createDataFrame(rows, "id bigint, kids array<bigint>").withColumn("fetched_at", F.current_timestamp()).write.parquet(f"{tmp_path}/hn_items.parquet")
    found = entry.queries()
    paths = found["p5_paths"](spark, str(tmp_path)).collect()
    place = {(r.head, r.pos): r.id for r in paths}
    for r in paths:
        chains = [(s.chain, s.upto) for s in r.segments] + [(r.head, r.pos)]
        assert [place[c, k] for c, upto in chains for k in range(upto + 1)] == path_of(parents, r.id)
    spans = found["p5_descendants"](spark, str(tmp_path)).collect()
    for r in spans:
        under = {x.id for x in spans if x.root_id == r.root_id and r.pre < x.pre < r.pre + r.size}
        assert under == {i for i in parents if i != r.id and r.id in path_of(parents, i)}


def test_nodes_on_and_below_cycles_have_paths_and_descendants(spark):
    parents = {1: None, 2: 1, 12: 10, 10: 11, 11: 12, 20: 11, 21: 20, 22: 20, 23: 21, 30: 12, 5: 5, 6: 5}
    labels = label_trees(frame(spark, parents), detail=True)
    rows = {r.id: r for r in labels.collect()}
    assert {i: (r.root_id, r.depth, r.size) for i, r in rows.items()} == {
        **{1: (1, 0, 2), 2: (1, 1, 1), 5: (5, -1, 2), 6: (5, -2, 1)},
        **{i: (10, -1, 8) for i in (10, 11, 12)},
        **{20: (10, -2, 4), 21: (10, -2, 2), 22: (10, -2, 1), 23: (10, -2, 1), 30: (10, -2, 1)},
    }
    paths = {r.id: list(r.path) for r in expand_paths(labels).collect()}
    assert paths[23] == [10, 12, 11, 20, 21, 23] and paths[30] == [10, 12, 30] and paths[6] == [5, 6]
    pairs = {}
    for r in expand_descendants(labels).collect():
        pairs.setdefault(r.ancestor, []).append(r.descendant)
    ring = {10, 11, 12, 20, 21, 22, 23, 30}
    assert {a: sorted(d) for a, d in pairs.items()} == {1: [2], 5: [6], 20: [21, 22, 23], 21: [23], **{i: sorted(ring - {i}) for i in (10, 11, 12)}}


def test_parents_without_a_row_count_as_none(spark):
    parents = {1: 99, 2: 1, 3: 2, 4: 98, 5: None, 6: 99}
    for detail in (False, True):
        rows = label_trees(frame(spark, parents), detail=detail).collect()
        assert {r.id: (r.root_id, r.depth) for r in rows} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (6, 0)}
        assert len(rows) == 6
