"""Problem 6: parent-child links to full hierarchies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwerk.functions.dates import day
from lotwerk.operators.skew import skew_join
from lotwerk.session import cut, drop
from lotwerk.sources.tables import table

#: List elements with which the ranking's recursion ends: so short a list is ranked in one task.
LOCAL_ROWS = 2_000
#: Share of the nodes that a round of peeling must take for another one to follow.
LEAST_PEELED = 0.1
#: Every so manieth list element is a splitter.
SPLIT = 8
#: Siblings are linked in blocks of so many bits of their id, level by level.
LEVEL_BITS = 12


def current_links(rows: DataFrame, id_: str, parent: str, version: Column) -> DataFrame:
    """(v, p): one row an id with the parent by its newest row; ties: a parent before none, then the smallest."""
    newest = F.max(F.struct(version.alias("at"), F.col(parent).isNotNull().alias("has"), (-F.col(parent)).alias("minus")))
    links = rows.filter(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("v")).agg(newest.alias("n")).select("v", (-F.col("n.minus")).alias("p"))
    known = skew_join(links.filter("p is not null"), links.select(F.col("v").alias("p"), F.lit(True).alias("there")), ["p"], how="inner")
    return links.select("v").join(known.select("v", "p"), "v", "left")


def _on_cycles(core: DataFrame, n: int) -> DataFrame:
    """The rows of core(v, p), n of them, whose node lies on a cycle: the images of all nodes after n steps or more."""
    jump = core.select("v", F.col("p").alias("t"))
    for _ in range(n.bit_length()):
        before = jump
        jump = cut(skew_join(jump, jump.select(F.col("v").alias("t"), F.col("t").alias("u")), ["t"]).select("v", F.col("u").alias("t")))
        drop(before)
    on = cut(jump.select(F.col("t").alias("v")).distinct())
    drop(jump)
    return core.join(on, "v", "left_semi")


def cycles(links: DataFrame, least_peeled: float = LEAST_PEELED) -> DataFrame:
    """(v, c): the nodes on a cycle with its smallest node.

    Leaves are peeled, a level a round, until none is left: what remains are the cycles. A round that peels less than
    least_peeled of what there is shows deep chains, which would take a round a level; there pointer doubling tells the
    cycles from the chains in as many rounds as the rest's size has bits. Either way the rounds grow with the logarithm of
    the size. A cycle's smallest node is found by doubling until no node learns of a smaller one.
    """
    core = cut(links.filter("p is not null"))
    n = core.count()
    while n:
        before, core = core, cut(core.join(core.select(F.col("p").alias("v")).distinct(), "v", "left_semi"))
        drop(before)
        left = core.count()
        if left == n:
            break
        if n - left < least_peeled * n:
            before, core = core, cut(_on_cycles(core, left))
            drop(before)
            break
        n = left
    ring = cut(core.select("v", F.col("p").alias("t"), F.least("v", "p").alias("c"), F.lit(True).alias("new")))
    while not ring.filter("new").isEmpty():
        before = ring
        ahead = ring.select(F.col("v").alias("t"), F.col("t").alias("u"), F.col("c").alias("d"))
        ring = cut(ring.join(ahead, "t").select("v", F.col("u").alias("t"), F.least("c", "d").alias("c"), (F.col("d") < F.col("c")).alias("new")))
        drop(before)
    return ring.select("v", "c")


def next_siblings(nodes: DataFrame, bits: int = LEVEL_BITS) -> DataFrame:
    """(v, sib): the next child by id of the same parent in nodes(v, fp; fp may be null, one group).

    Children are chained within blocks of ids, the blocks within blocks of blocks, and so on, so that a parent of any
    number of children never lies in one window; a window has 2**bits rows at most.
    """
    span = nodes.agg(F.min("v"), F.max("v")).first()
    low, high = span[0] or 0, span[1] or 0
    level = nodes.select("fp", (F.col("v") - low).alias("at"), F.col("v").alias("first"), F.col("v").alias("last"))
    out = None
    width = max(1, (high - low).bit_length())
    while True:
        level = level.withColumn("block", F.shiftright("at", bits))
        order = Window.partitionBy("fp", "block").orderBy("at")
        links = level.select(F.col("last").alias("v"), F.lead("first").over(order).alias("sib")).filter("sib is not null")
        out = links if out is None else out.unionByName(links)
        width -= bits
        if width <= 0:
            return out
        level = level.groupBy("fp", F.col("block").alias("at")).agg(F.min("first").alias("first"), F.max("last").alias("last"))


def rank_list(items: DataFrame, local_rows: int = LOCAL_ROWS, split: int = SPLIT, seed: int = 7) -> DataFrame:
    """(e, after, sum): of every element of items(e, nxt, n, w), a linked list with null at its end, the sums of n and
    of w from the element, itself included, to the end.

    Hashed splitters cut the list into pieces. Every element doubles its pointer until it points at a splitter; those
    that do drop out of the rounds. The splitters are a list a split-th as long and are ranked in the same way, in one
    task once they are few.
    """
    if (size := items.count()) <= max(local_rows, split):
        return _rank_local(items)
    is_splitter = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(split)) == 0
    state = cut(items.withColumn("done", F.col("nxt").isNull() | is_splitter("nxt")))
    for _ in range(2 * size.bit_length()):
        if state.filter("not done").isEmpty():
            break
        steps = state.filter(~is_splitter("e")).select(
            F.col("e").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("n").alias("n2"), F.col("w").alias("w2"), F.col("done").alias("done2")
        )
        moved = state.filter("not done").join(steps, "nxt").select("e", F.col("nxt2").alias("nxt"), (F.col("n") + F.col("n2")).alias("n"), (F.col("w") + F.col("w2")).alias("w"), F.col("done2").alias("done"))
        before, state = state, cut(state.filter("done").unionByName(moved))
        drop(before)
    else:
        if not state.filter("not done").isEmpty():
            raise RuntimeError("the list does not end: its elements lie on a cycle")
    few = state.filter(is_splitter("e")).select("e", "nxt", "n", "w")
    ranked = cut(rank_list(cut(few), local_rows, split, seed + 1))
    return state.join(ranked.select(F.col("e").alias("nxt"), F.col("after").alias("a2"), F.col("sum").alias("s2")), "nxt", "left").select(
        "e", (F.col("n") + F.coalesce("a2", F.lit(0))).alias("after"), (F.col("w") + F.coalesce("s2", F.lit(0))).alias("sum")
    )


def _rank_local(items: DataFrame) -> DataFrame:
    def rank(batches):
        all_ = [b for b in batches if len(b)]
        if not all_:
            return
        part = pd.concat(all_)
        e, n, w = (part[c].tolist() for c in ("e", "n", "w"))
        at = {x: i for i, x in enumerate(e)}
        nxt = [at.get(x, -1) if ok else -1 for x, ok in zip(part["nxt"].fillna(0).astype("int64").tolist(), part["nxt"].notna())]
        follow = set(nxt)
        after, sums, done = [0] * len(e), [0] * len(e), 0
        for head in (i for i in range(len(e)) if i not in follow):
            chain, i = [], head
            while i >= 0:
                chain.append(i)
                i = nxt[i]
            a = s = 0
            for i in reversed(chain):
                a, s = a + n[i], s + w[i]
                after[i], sums[i] = a, s
            done += len(chain)
        if done < len(e):
            raise RuntimeError("the list does not end: its elements lie on a cycle")
        yield pd.DataFrame({"e": e, "after": after, "sum": sums})

    # nxt as text keeps 64 bits where pandas would make nulls floats
    return items.select("e", F.col("nxt"), "n", "w").coalesce(1).mapInArrow(_arrow(rank), "e long, after long, sum long")


def _arrow(f):
    """f over pandas frames whose integers keep 64 bits beside nulls."""
    import pyarrow as pa

    def run(batches):
        frames = (b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for b in batches)
        for out in f(frames):
            yield pa.RecordBatch.from_pandas(out.astype("int64"), preserve_index=False)

    return run


def euler_intervals(nodes: DataFrame, **tuning) -> DataFrame:
    """(v, enter, exit, depth) of the forest nodes(v, fp; fp null at a root): positions in one Euler tour of all trees."""
    nodes = cut(nodes)
    first = nodes.filter("fp is not null").groupBy(F.col("fp").alias("v")).agg(F.min("v").alias("child"))
    tour = nodes.join(first, "v", "left").join(next_siblings(nodes), "v", "left")
    enter, exit_ = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    arcs = F.array(
        F.struct(enter("v").alias("e"), F.coalesce(enter("child"), exit_("v")).alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("w")),
        F.struct(exit_("v").alias("e"), F.coalesce(enter("sib"), exit_("fp")).alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("w")),
    )
    items = cut(tour.select(F.explode(arcs).alias("x")).select("x.*"))
    ranked = rank_list(items, **tuning)
    total = items.count()
    side = F.pmod("e", F.lit(2)) == 0
    return (
        ranked.groupBy(F.shiftright("e", 1).alias("v"))
        .agg(
            F.max(F.when(side, total - F.col("after"))).alias("enter"),
            F.max(F.when(~side, total - F.col("after"))).alias("exit"),
            F.max(F.when(side, -F.col("sum"))).alias("depth"),
        )
    )


def paths(intervals: DataFrame, chunk: int | None = None) -> DataFrame:
    """(v, path, root_mark) of intervals(v, enter, exit, depth, mark): ids from the root joined by '/', and the root's mark.

    The tour is swept in chunks of positions. Which nodes are open where a chunk begins follows from the intervals, so
    the chunks are independent. A sweep keeps the ids of the open nodes, one a level, and joins them when it writes a
    path; the chunks shrink with the greatest depth, so that the paths of one take about 100 MB at most.
    """
    if chunk is None:
        deepest = intervals.agg(F.max("depth")).first()[0] or 0
        chunk = max(64, min(16_384, 8_000_000 // (deepest + 1)))
    begins = F.floor(F.col("enter") / chunk)
    ends = F.floor(F.col("exit") / chunk)
    placed = intervals.select("v", "enter", "exit", "mark", F.explode(F.sequence(begins, ends)).alias("chunk"), begins.alias("own"))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("enter")
        ends: list[int] = []
        names: list[str] = []
        root = None
        out = []
        for v, exit_, mark, chunk_, own in zip(pdf["v"], pdf["exit"], pdf["mark"], pdf["chunk"], pdf["own"]):
            while ends and ends[-1] < exit_:
                ends.pop()
                names.pop()
            if not ends:
                root = mark
            ends.append(exit_)
            names.append(str(v))
            if own == chunk_:
                out.append((v, "/".join(names), root))
        return pd.DataFrame(out, columns=["v", "path", "root_mark"])

    return placed.groupBy("chunk").applyInPandas(sweep, "v long, path string, root_mark string")


def hierarchy(rows: DataFrame, id_: str, parent: str, version: Column, **tuning) -> DataFrame:
    """(id, art, wurzel, tiefe, pfad, n_nachfahren) of every id, as p6_found has it.

    A cycle's nodes are taken as roots of what hangs below them; the Euler tour of that forest gives intervals, and
    these give depth, paths and descendants. Rows without id are left out; a parent that is no id makes a root; several
    rows of an id: the newest holds (see current_links); an id that is its own parent is a cycle. Empty table: no rows.
    Ids must lie within 62 bits.
    """
    links = cut(current_links(rows, id_, parent, version))
    ring = cycles(links, **{k: v for k, v in tuning.items() if k == "least_peeled"})
    marked = links.join(ring, "v", "left")
    forest = marked.select("v", F.when(F.col("c").isNull(), F.col("p")).alias("fp"), "c")
    spans = euler_intervals(forest.select("v", "fp"), **{k: v for k, v in tuning.items() if k in ("local_rows", "split")})
    spans = cut(spans.join(ring, "v", "left").withColumn("mark", F.col("c").cast("string")))
    swept = paths(spans, tuning.get("chunk"))
    below = ((F.col("exit") - F.col("enter") - 1) / 2).cast("long")
    whole = spans.filter("c is not null").groupBy("c").agg(F.sum(below + 1).alias("reach"), F.count("*").alias("size"))
    on_ring = skew_join(spans.filter("c is not null"), whole, ["c"], weight="size").select("v", "reach")
    every = spans.join(swept, "v").join(on_ring, "v", "left")
    tree = F.col("root_mark").isNull()
    return every.select(
        F.col("v").alias("id"),
        F.when(F.col("c").isNotNull(), "zyklus").when(tree, "baum").otherwise("unter_zyklus").alias("art"),
        F.when(tree, F.substring_index("path", "/", 1)).otherwise(F.col("root_mark")).cast("long").alias("wurzel"),
        F.when(tree, F.col("depth")).otherwise(-1).cast("long").alias("tiefe"),
        F.when(tree, F.col("path")).otherwise("").alias("pfad"),
        F.coalesce(F.col("reach") - 1, below).alias("n_nachfahren"),
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dvsh_organisation", "id", "parent_id", "updated_at")
    return hierarchy(rows, "id", "parent_id", day(F.col("updated_at")))


SQL = {
    "p6_found": """
WITH RECURSIVE o AS (SELECT id, parent_id, CASE WHEN updated_at LIKE '__.__.____' THEN CAST(strptime(updated_at, '%d.%m.%Y') AS DATE) ELSE CAST(substr(updated_at, 1, 10) AS DATE) END d FROM dvsh_organisation),
n AS (SELECT id v, parent_id p0 FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY d DESC, parent_id IS NULL, parent_id) = 1),
l AS (SELECT n.v, m.v p FROM n LEFT JOIN n m ON m.v = n.p0),
up AS (
  SELECT v, v a, [v] trail, false again FROM l
  UNION ALL
  SELECT up.v, l.p, list_append(trail, l.p), list_contains(trail, l.p) FROM up JOIN l ON l.v = up.a WHERE l.p IS NOT NULL AND NOT up.again),
e AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY v ORDER BY len(trail) DESC) = 1),
k AS (SELECT v, again, a, trail, CASE WHEN again THEN trail[list_position(trail, a):len(trail) - 1] END ring FROM e),
desc_ AS (SELECT a v, count(DISTINCT v) n FROM up WHERE a <> v GROUP BY a)
SELECT k.v id, CASE WHEN NOT again THEN 'baum' WHEN list_contains(ring, k.v) THEN 'zyklus' ELSE 'unter_zyklus' END art,
  CASE WHEN again THEN list_min(ring) ELSE a END wurzel, CASE WHEN again THEN -1 ELSE len(trail) - 1 END tiefe,
  CASE WHEN again THEN '' ELSE array_to_string(list_reverse(trail), '/') END pfad, coalesce(n, 0) n_nachfahren
FROM k LEFT JOIN desc_ ON desc_.v = k.v
"""
}
QUERIES = {"p6_found": p6_found}
