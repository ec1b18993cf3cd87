"""Problem 5: consolidating pairwise matches into groups, by seed-tree pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwerk.operators.skew import MAX_LOOKUP, skew_join
from lotwerk.session import cut, drop
from lotwerk.sources.tables import table

POSITIVE = ["duplicate_ingest", "merge_candidate", "template_family"]


def connected_groups(links: DataFrame) -> DataFrame:
    """(v, seed): every vertex of links(a, b) with the smallest vertex it is linked with, directly or over others.

    In each round every vertex proposes the minimum of its neighbourhood to the whole neighbourhood; a vertex that no
    one, itself included, proposes drops out as a child of the least minimum it was given, and the minima go on as the
    next round's graph, linked with each other where one vertex was given several. The children form a forest; when no
    links remain, the seeds flow down it, the round that dropped out last first.

    Hot vertices: minima combine before the shuffle, and they come back to the links by a counted broadcast or
    skew_join. Links of a vertex with itself give a group of one; null ends are left out; repeated and reversed links count once. Empty: no rows.
    """
    ok = links.filter("a is not null and b is not null").select("a", "b")
    vertices = ok.select(F.col("a").alias("v")).union(ok.select("b")).distinct()
    edges = cut(ok.union(ok.select(F.col("b"), F.col("a"))).toDF("u", "v").filter("u <> v").distinct())
    dropped: list[DataFrame] = []

    def spread(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(of), "u") if of.count() <= MAX_LOOKUP else skew_join(rows, of, ["u"], weight="n")

    while not edges.isEmpty():
        # edges holds both directions; the minimum of N(u) and u goes to u and to all of N(u)
        least = cut(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        told = cut(spread(edges, least).select("v", "m").union(least.select("u", "m")).distinct().toDF("u", "m"))
        best = cut(told.groupBy("u").agg(F.min("m").alias("top"), F.max(F.col("m") == F.col("u")).alias("chosen"), F.count("*").alias("n")))
        child = cut(best.filter("not chosen").select(F.col("u").alias("v"), F.col("top").alias("parent")))
        dropped.append(child)
        pairs = spread(told, best.filter("n > 1").select("u", "top", "n")).filter("m <> top").select(F.col("m").alias("a"), F.col("top").alias("b"))
        following = cut(pairs.union(pairs.select("b", "a")).toDF("u", "v").distinct())
        for old in (edges, told, least, best):
            drop(old)
        edges = following
    rooted = None
    for child in reversed(dropped):
        if rooted is None:
            rooted = child.select("v", F.col("parent").alias("seed"))
            continue
        known = rooted.select(F.col("v").alias("parent"), "seed")
        below = skew_join(child, known, ["parent"], how="left").select("v", F.coalesce("seed", "parent").alias("seed"))
        rooted = cut(below.unionByName(rooted))
    if rooted is None:
        return vertices.select("v", F.col("v").alias("seed"))
    return vertices.join(rooted, "v", "left").select("v", F.coalesce("seed", "v").alias("seed"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "form_similarity", "form_a", "form_b", "verdict")
    verdict = F.lower(F.regexp_replace("verdict", r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    links = rows.filter("form_a <> form_b").filter(verdict.isin(POSITIVE)).select(F.col("form_a").alias("a"), F.col("form_b").alias("b"))
    return connected_groups(links).select(F.col("v").alias("form_id"), F.col("seed").alias("gruppe"))


SQL = {
    "p5_found": """
WITH RECURSIVE l AS (SELECT form_a a, form_b b FROM form_similarity WHERE form_a <> form_b AND lower(trim(verdict)) IN ('duplicate_ingest', 'merge_candidate', 'template_family')),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a v, a w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w)
SELECT v form_id, min(w) gruppe FROM r GROUP BY v
"""
}
QUERIES = {"p5_found": p5_found}
