"""Parent-child rows to full hierarchies by heavy-path decomposition.

All steps are joins and aggregations on keys that spread: subtree sizes and cycle separation by
ancestor doubling (rows leave the working set as soon as they have passed their root, so a
round costs only the rows deeper than 2^k), heavy children by a map-side combinable aggregate,
chain positions by list ranking along heavy edges, and chain depths by doubling over the tree
of chains, whose height is at most log2(n). No subtree is gathered into one task.

Defined results: rows with a null id are ignored; ids repeated in ``kids``, kids without a row
and null kids are ignored; an empty table gives an empty result; a row that lists itself takes
part like any other lister and may form a cycle of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.staging import Staging

CYCLE, BELOW_CYCLE = -1, -2
#: Siblings per block of the two-level prefix sum.
SIBLING_BLOCK = 50_000
#: Places of a chain gathered at once, and places in preorder joined at once.
CHAIN_BLOCK, PRE_BLOCK = 1_000, 1_000


def latest_children(rows: DataFrame, id_col: str, kids_col: str, version_col: str) -> DataFrame:
    """The newest row of each id: ``id, kids``. Null versions count as oldest."""
    pick = F.max(F.struct(F.col(version_col).alias("v"), F.col(kids_col).alias("k")))
    return (
        rows.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(pick.alias("p"))
        .select("id", F.col("p.k").alias("kids"))
    )


def parent_links(nodes: DataFrame) -> DataFrame:
    """``id, parent`` for each row of ``id, kids``; the parent is the smallest id that lists it."""
    own = nodes.select("id", F.lit(None).cast("bigint").alias("parent"), F.lit(True).alias("own"))
    listed = nodes.select(F.explode("kids").alias("id"), F.col("id").alias("parent"), F.lit(False).alias("own"))
    return (
        own.unionByName(listed.where(F.col("id").isNotNull()))
        .groupBy("id")
        .agg(F.min("parent").alias("parent"), F.max("own").alias("own"))
        .where("own")
        .select("id", "parent")
    )


def _sizes_and_cyclic(st: Staging, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subtree sizes of the nodes in trees, and the links of the nodes on or below cycles."""
    active = links.where(F.col("parent").isNotNull()).select("id", F.col("parent").alias("anc"), F.lit(1).cast("bigint").alias("s"))
    incs, previous, staged = [], -1, None
    while True:
        inc = active.groupBy(F.col("anc").alias("u")).agg(F.sum("s").alias("inc"))
        if staged is not None:
            inc = st.cut(inc, "inc")
        incs.append(inc)
        up = active.select(F.col("id").alias("u"), F.col("anc").alias("next"))
        nxt = (
            active.join(up, active["anc"] == up["u"])
            .select("id", F.col("next").alias("anc"), "s")
            .join(inc.select(F.col("u").alias("id"), "inc"), "id", "left")
            .select("id", "anc", (F.col("s") + F.coalesce("inc", F.lit(0))).alias("s"))
        )
        nxt = st.cut(nxt, "active")
        n = nxt.count()
        st.drop(staged)
        active = staged = nxt
        if n == 0 or n == previous:
            break
        previous = n
    total = incs[0]
    for inc in incs[1:]:
        total = total.unionByName(inc)
    cyclic = links.join(active.select("id"), "id", "left_semi")
    trees = links.join(active.select("id"), "id", "left_anti")
    sizes = trees.join(total.groupBy(F.col("u").alias("id")).agg(F.sum("inc").alias("inc")), "id", "left").select(
        "id", "parent", (F.lit(1) + F.coalesce("inc", F.lit(0))).alias("size")
    )
    return st.cut(sizes, "sizes"), st.cut(cyclic, "cyclic")


def _resolve_cycles(st: Staging, cyclic: DataFrame, keep: bool = False) -> DataFrame:
    """``id, root_id, depth`` of the nodes on (-1) or below (-2) cycles; with ``keep``, ``cyclic`` stays staged."""
    cur = cyclic.select("id", F.col("parent").alias("anc"), F.col("id").alias("m"))
    seen = None
    staged = None if keep else cyclic
    while True:
        up = cur.select(F.col("id").alias("u"), F.col("anc").alias("next"), F.col("m").alias("m2"))
        nxt = st.cut(
            cur.join(up, cur["anc"] == up["u"]).select("id", F.col("next").alias("anc"), F.least("m", "m2").alias("m")),
            "cycle",
        )
        image = nxt.select(F.col("anc").alias("id")).distinct()
        # images of f^(2^k) are nested, minima only fall: equal figures twice mean nothing moved
        now = nxt.join(image, "id", "left_semi").agg(F.count("*"), F.sum(F.col("m").cast("decimal(38,0)"))).first()
        st.drop(staged)
        cur = staged = nxt
        if seen == now:
            break
        seen = now
    image = cur.select(F.col("anc").alias("id")).distinct()
    on = cur.join(image, "id", "left_semi").select("id", F.col("m").alias("root_id"))
    below = cur.join(image, "id", "left_anti")
    return on.select("id", "root_id", F.lit(CYCLE).cast("bigint").alias("depth")).unionByName(
        below.join(on.withColumnRenamed("id", "anc"), "anc").select("id", "root_id", F.lit(BELOW_CYCLE).cast("bigint").alias("depth"))
    )


def _opened(st: Staging, cyclic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cycle labels, and the sizes of the trees left when the link into each cycle's smallest id is cut."""
    caught = st.cut(_resolve_cycles(st, cyclic, keep=True), "caught")
    first = caught.where((F.col("depth") == CYCLE) & (F.col("id") == F.col("root_id"))).select("id", F.lit(True).alias("first"))
    opened = st.cut(
        cyclic.join(first, "id", "left").select("id", F.when(F.col("first").isNull(), F.col("parent")).alias("parent")),
        "opened",
    )
    return caught, _sizes_and_cyclic(st, opened)[0]


def _chains(st: Staging, sizes: DataFrame) -> DataFrame:
    """Adds ``head`` and ``pos`` to each tree node: its chain's first node and its place in it."""
    heavy = (
        sizes.where(F.col("parent").isNotNull())
        .groupBy("parent")
        .agg(F.max(F.struct("size", (-F.col("id")).alias("n"))).alias("best"))
        .select((-F.col("best.n")).alias("id"), F.col("best.size").alias("heavy_size"))
    )
    marked = sizes.join(heavy, "id", "left")
    nodes = st.cut(
        marked.select("id", "parent", "size", F.col("heavy_size").isNotNull().alias("is_heavy")),
        "marked",
    )
    heads = nodes.where(~F.col("is_heavy")).select("id", F.col("id").alias("head"), F.lit(0).cast("bigint").alias("pos"))
    # only nodes with children are ever pointed at
    known = nodes.where(~F.col("is_heavy") & (F.col("size") > 1)).select("id", F.col("id").alias("head"), F.lit(0).cast("bigint").alias("pos"))
    active = nodes.where("is_heavy").select("id", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("d"))
    placed = heads
    while True:
        target = known.select(F.col("id").alias("t"), F.lit(None).cast("bigint").alias("t_ptr"), "head", F.col("pos").alias("t_d")).unionByName(
            active.select(F.col("id").alias("t"), F.col("ptr").alias("t_ptr"), F.lit(None).cast("bigint").alias("head"), F.col("d").alias("t_d"))
        )
        joined = st.cut(
            active.join(target, active["ptr"] == target["t"]).select("id", F.col("t_ptr").alias("ptr"), (F.col("d") + F.col("t_d")).alias("d"), "head"),
            "rank",
        )
        ended = joined.where(F.col("head").isNotNull()).select("id", "head", F.col("d").alias("pos"))
        placed, known = placed.unionByName(ended), known.unionByName(ended)
        active = joined.where(F.col("head").isNull()).select("id", "ptr", "d")
        if active.isEmpty():
            break
    return st.cut(nodes.join(placed, "id"), "placed")


def _sibling_offsets(heads: DataFrame) -> DataFrame:
    """For each light child the sizes of the light siblings before it, in the order of a hash of the id.

    Two levels of prefix sums: blocks by the hash's leading bits within the parent, then rows within the
    block, so that a parent with a third of all rows is spread over many windows. The order is the same
    however many blocks there are.
    """
    bits = F.ceil(F.log2(F.count("*") / SIBLING_BLOCK + 1)).cast("int")
    per = heads.groupBy("parent").agg(bits.alias("bits"))
    blocked = heads.join(per, "parent").withColumn("hash", F.shiftrightunsigned(F.xxhash64("id"), 1)).withColumn("block", F.expr("shiftright(hash, 63 - bits)"))
    sums = blocked.groupBy("parent", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("parent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("parent", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("parent", "block").orderBy("hash", "id").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.join(sums, ["parent", "block"]).select(
        "id", (F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0))).alias("earlier")
    )


def _chain_depths(st: Staging, placed: DataFrame, detail: bool) -> DataFrame:
    """``head, root_id, head_depth`` (and ``head_pre, segments``) of each chain, level by level.

    A path crosses at most log2(n) light edges, so there are at most so many rounds.
    """
    lights = placed.where((F.col("id") == F.col("head")) & F.col("parent").isNotNull())
    over = placed.where(F.col("size") > 1).select(
        F.col("id").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("at"), F.col("size").alias("p_size")
    )
    edges = lights.select("id", "parent", "size").join(over, "parent")
    if detail:
        # preorder: the heavy child follows its parent, then the light ones
        heavy = placed.where("is_heavy").select("parent", F.col("size").alias("heavy_size"))
        edges = edges.join(_sibling_offsets(lights.select("id", "parent", "size")), "id").join(heavy, "parent")
    edges = st.cut(edges, "light-edges")
    level = placed.where(F.col("parent").isNull()).select(F.col("id").alias("head"), F.col("id").alias("root_id"), F.lit(0).cast("bigint").alias("head_depth"))
    if detail:
        level = level.withColumn("head_pre", F.lit(0).cast("bigint")).withColumn(
            "segments", F.array().cast("array<struct<chain:bigint,upto:bigint>>")
        )
    out = level
    while True:
        cols = [F.col("id").alias("head"), "root_id", (F.col("head_depth") + F.col("at") + 1).alias("head_depth")]
        if detail:
            cols.append((F.col("head_pre") + F.col("at") + 1 + F.col("heavy_size") + F.col("earlier")).alias("head_pre"))
            cols.append(F.concat("segments", F.array(F.struct(F.col("up").alias("chain"), F.col("at").alias("upto")))).alias("segments"))
        level = st.cut(edges.join(level.withColumnRenamed("head", "up"), "up").select(*cols), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def label_trees(links: DataFrame, detail: bool = False) -> DataFrame:
    """Hierarchy labels of each row of ``id, parent`` (one row per id; parents without a row count as none).

    Gives ``id, root_id, depth``; depth -1 marks a node on a cycle, -2 one below a cycle, both with the
    smallest id of the cycle as root. With ``detail`` also ``size`` (nodes of the subtree, itself
    included), ``head`` and ``pos`` (heavy chain and place in it), ``segments`` (the chains above, each
    with the last place used, from the root down) and ``pre``: the descendants of a node are the nodes
    of the same root with ``pre`` in ``(pre, pre + size)``. A cycle is opened before its smallest id, so
    the labels of a node on or below one give its path from there. On a cycle everything else with the
    same root is a descendant: ``size`` is the number of all these nodes, ``pre`` only a place.
    """
    present = links.select(F.col("id").alias("parent"), F.lit(True).alias("present"))
    known = links.select("id", "parent").join(present, "parent", "left")
    return _label(known.select("id", F.when(F.col("present"), F.col("parent")).alias("parent")), detail)


def _label(links: DataFrame, detail: bool) -> DataFrame:
    """``label_trees`` of links whose parents all have a row."""
    st = Staging(links.sparkSession, "trees")
    links = st.cut(links.select("id", "parent"), "links")
    sizes, cyclic = _sizes_and_cyclic(st, links)
    closed = not cyclic.isEmpty()
    caught = None
    if detail and closed:
        caught, more = _opened(st, cyclic)
        sizes = sizes.unionByName(more)
    placed = _chains(st, sizes)
    chains = _chain_depths(st, placed, detail)
    joined = placed.join(chains, "head")
    depth = (F.col("head_depth") + F.col("pos")).alias("depth")
    if not detail:
        trees = joined.select("id", "root_id", depth)
        return trees.unionByName(_resolve_cycles(st, cyclic)) if closed else trees
    trees = joined.select("id", "root_id", depth, "size", "head", "pos", "segments", (F.col("head_pre") + F.col("pos")).alias("pre"))
    if not closed:
        return trees
    whole = sizes.join(caught.where("id = root_id"), "id", "left_semi").select(F.col("id").alias("root_id"), F.col("size").alias("whole"))
    marks = caught.join(whole, "root_id").select("id", F.col("depth").alias("mark"), "whole")
    return trees.join(marks, "id", "left").select(
        "id",
        "root_id",
        F.coalesce("mark", "depth").alias("depth"),
        F.when(F.col("mark") == CYCLE, F.col("whole")).otherwise(F.col("size")).alias("size"),
        "head",
        "pos",
        "segments",
        "pre",
    )


def hierarchy(rows: DataFrame, id_col: str = "id", kids_col: str = "kids", version_col: str = "fetched_at", detail: bool = False) -> DataFrame:
    """Labels (see ``label_trees``) of a table whose rows list their children; the newest row of an id counts."""
    return _label(parent_links(latest_children(rows, id_col, kids_col, version_col)), detail)


def expand_paths(labels: DataFrame, block: int = CHAIN_BLOCK) -> DataFrame:
    """``id, path`` (array of ids from the root, or from the smallest id of the cycle) by concatenating chain segments of ``label_trees(detail=True)``.

    Chains are gathered in blocks of ``block`` places. The output holds depth + 1 ids a row; ask for it where such a table is wanted.
    """
    st = Staging(labels.sparkSession, "paths")
    trees = st.cut(labels.select("id", "head", "pos", "segments"), "labels")
    own = F.array(F.struct(F.col("head").alias("chain"), F.col("pos").alias("upto")))
    pieces = trees.select("id", F.posexplode(F.concat("segments", own)).alias("seg_no", "seg"))
    of = lambda c: F.floor(F.col(c) / block)
    members = trees.groupBy("head", of("pos").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("members"))
    parts = pieces.select("id", "seg_no", F.col("seg.chain").alias("head"), F.col("seg.upto").alias("upto"))
    parts = parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), of("upto")))).join(members, ["head", "block"])
    used = F.least(F.lit(block), F.col("upto") - F.col("block") * block + 1).cast("int")
    cut = parts.select("id", "seg_no", "block", F.slice("members", F.lit(1), used)["id"].alias("ids"))
    return cut.groupBy("id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("seg_no", "block", "ids")))["ids"]).alias("path"))


def expand_descendants(labels: DataFrame, block: int = PRE_BLOCK) -> DataFrame:
    """``ancestor, descendant`` pairs (output-sized): a range join of ``(root_id, pre, pre + size)`` in blocks of ``pre``."""
    st = Staging(labels.sparkSession, "descendants")
    trees = st.cut(labels.select("id", "root_id", "depth", "pre", "size"), "labels")
    on = F.col("depth") == CYCLE
    spans = trees.select(
        F.col("id").alias("ancestor"),
        "root_id",
        F.when(on, 0).otherwise(F.col("pre") + 1).alias("first"),
        F.when(on, F.col("size") - 1).otherwise(F.col("pre") + F.col("size") - 1).alias("last"),
    ).where("last >= first")
    of = lambda c: F.floor(F.col(c) / block)
    spans = spans.withColumn("block", F.explode(F.sequence(of("first"), of("last"))))
    nodes = trees.select(F.col("id").alias("descendant"), "root_id", "pre", of("pre").alias("block"))
    pairs = spans.join(nodes, ["root_id", "block"]).where("pre BETWEEN first AND last AND descendant <> ancestor")
    return pairs.select("ancestor", "descendant")
