"""Problem 4: all similar pairs between set-valued records, by metric pivot partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwerk.functions.text import norm_name
from lotwerk.operators import meeting
from lotwerk.operators.skew import salted_join, skew_join
from lotwerk.session import cut, release
from lotwerk.sources.tables import table

#: Of so many representatives one is drawn as a pivot, by its hash.
PIVOT_EVERY = 8
#: Not read any more: sets of any size meet as meeting.py has it. Tests set it.
PAIRS_TO = 48
#: Copies of a set from which their pairs are given by several tasks.
COPIES = 2_000
#: Guard against binary fractions: similarities are ratios of small integers, thresholds are lowered by this much.
EPS = 1e-9


def sets_of(rows: DataFrame) -> DataFrame:
    """rows(space, id, tok long) as (space, id, tokens): a record's distinct tokens."""
    member = rows.filter("id is not null and tok is not null")
    return member.groupBy("space", "id").agg(F.sort_array(F.collect_set("tok")).alias("tokens"))


def near_pivots(sets: DataFrame, sim: float, min_size: int) -> DataFrame:
    """Every (space, y, p, d): a set and a pivot of sets(space, id, tokens, pivot), pivot telling which are pivots, whose Jaccard
    similarity is sim at least, and their distance; a pivot is near itself. They meet once, by meeting.similar_sets."""
    met = meeting.similar_sets(sets, sim, min_size)
    d = 1 - F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))
    ends = F.array(F.struct(F.col("a").alias("y"), F.col("b").alias("p"), F.col("pb").alias("is")), F.struct(F.col("b").alias("y"), F.col("a").alias("p"), F.col("pa").alias("is")))
    near = met.select("space", F.explode(ends).alias("e"), d.alias("d")).filter("e.is").select("space", "e.y", "e.p", "d")
    return near.unionByName(sets.filter("pivot").select("space", F.col("id").alias("y"), F.col("id").alias("p"), F.lit(0.0).alias("d")))


def similar_sets(sets: DataFrame, threshold: float, min_size: int, pivot_every: int = PIVOT_EVERY) -> DataFrame:
    """Every (space, a, b) with a < b of the different sets(space, id, tokens) whose Jaccard is threshold at least.

    Jaccard distance is a metric. With r = 1 - threshold:

    1. Pivots are drawn by hash; of pivots within r/2 of each other only those that come first in hash order near them
       stay, so that a crowd of alike sets keeps few.
    2. A set goes to its nearest pivot within r/2, its home; a cell's radius R is the distance of its farthest member. A
       set without such a pivot is the pivot of its own cell, of radius 0.
    3. A set is replicated to every cell whose pivot is R + r away at most: by the triangle inequality no member of the
       cell is within r of any other set.
    4. Within cells, members are joined with members and replicas and verified exactly. A pair of two cells is given by
       the cell with the smaller pivot.

    Members of one cell are within r of each other by construction, so the join within cells yields what is asked for
    and not all pairs of a group. No cap on cells, replicas or partners.
    """
    r = 1 - threshold
    drawn = cut(sets.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(pivot_every)) == 0).withColumn("pivot", F.lit(True)))
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(29)), F.col(c))
    beaten = near_pivots(drawn, 1 - r / 2, min_size).filter(order("p") < order("y")).select("space", F.col("y").alias("id")).distinct()
    pivots = drawn.join(beaten, ["space", "id"], "left_anti").select("space", "id", "pivot")
    marked = cut(sets.join(pivots, ["space", "id"], "left").select("space", "id", "tokens", F.coalesce("pivot", F.lit(False)).alias("pivot")))
    release(sets.sparkSession)
    close = cut(near_pivots(marked, 1 - 1.5 * r, min_size))
    release(sets.sparkSession)
    home = close.filter(F.col("d") <= r / 2 + EPS).groupBy("space", "y").agg(F.min("d").alias("hd"), F.min_by("p", F.struct("d", "p")).alias("home"))
    home = cut(home.select("space", "y", "home", "hd"))
    radius = home.groupBy("space", F.col("home").alias("p")).agg(F.max("hd").alias("radius"))
    within = skew_join(close, radius, ["space", "p"]).filter(F.col("d") <= F.col("radius") + r + EPS)
    within = within.join(home.select("space", "y", "home"), ["space", "y"], "left").select("space", "p", "y", "d", F.coalesce("home", "y").alias("home"))
    # only what stays in a cell carries its tokens on
    within = cut(within.join(sets.select("space", F.col("id").alias("y"), F.col("tokens").alias("ytok")), ["space", "y"]))
    members = within.filter("home = p").select("space", "p", F.col("y").alias("x"), F.col("ytok").alias("xtok"), F.col("d").alias("xd"))
    cell = salted_join(within, members, ["space", "p"], 20_000)
    cell = cell.filter((((F.col("home") == F.col("p")) & (F.col("x") < F.col("y"))) | (F.col("home") > F.col("p"))) & (F.abs(F.col("d") - F.col("xd")) <= r + EPS))
    o = F.size(F.array_intersect("xtok", "ytok"))
    cell = cut(cell.filter(o >= (F.size("xtok") + F.size("ytok") - o) * threshold - EPS).select("space", "x", "y"))
    release(sets.sparkSession)
    housed = cut(sets.join(home.select("space", F.col("y").alias("id"), "home"), ["space", "id"], "left").select("space", "id", "tokens", F.col("home").isNull().alias("pivot")))
    own = near_pivots(housed, threshold, min_size).select("space", "y", "p").filter("y <> p")
    own = own.join(home.select("space", "y", "home"), ["space", "y"], "left").filter(F.coalesce("home", "y") > F.col("p"))
    pairs = cell.unionByName(own.select("space", F.col("p").alias("x"), "y"))
    return pairs.select("space", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def set_join(rows: DataFrame, threshold: float = 0.6, min_size: int = 4, pivot_every: int = PIVOT_EVERY) -> tuple[DataFrame, DataFrame]:
    """(pairs(space, a, b), members(space, id, klasse)) of rows(space, id, tok long).

    Sets with fewer than min_size members take no part. Equal sets are one class; pairs are between class
    representatives of different sets. Null ids and tokens are left out, repeated rows count once, empty tables give
    no pairs. Tokens are 64-bit integers; of hashed texts two differ with a chance of 2**-64 of being taken for one.
    """
    sets = cut(sets_of(rows).filter(F.size("tokens") >= min_size))
    representatives, members = meeting.classes_of(sets)
    members = members.select("space", "id", "klasse")
    release(sets.sparkSession)
    pairs = cut(similar_sets(representatives.select("space", "id", "tokens"), threshold, min_size, pivot_every))
    release(sets.sparkSession)
    return pairs, members


def form_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(space, id, tok): names and assigned elements of the forms' fields that are not withdrawn."""
    fields = table(spark, folder, "data_field", "form_id", "name", "ech_element_id", "geloescht_am").filter("geloescht_am is null")
    name = norm_name(F.col("name"))
    names = fields.select(F.lit("names").alias("space"), F.col("form_id").alias("id"), F.when(name != "", F.xxhash64(name)).alias("tok"))
    return names.unionByName(fields.select(F.lit("ech").alias("space"), F.col("form_id").alias("id"), F.col("ech_element_id").alias("tok")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of forms, copies expanded as the stated result wants it."""
    pairs, members = set_join(form_sets(spark, folder))
    a, b = (members.select("space", F.col("klasse").alias(k), F.col("id").alias(f)) for k, f in (("a", "fa"), ("b", "fb")))
    different = salted_join(salted_join(pairs, a, ["space", "a"], both=True), b, ["space", "b"], both=True).select("space", "fa", "fb")
    alike = salted_join(a.withColumnRenamed("a", "k"), b.withColumnRenamed("b", "k"), ["space", "k"], COPIES, both=True).filter("fa < fb").select("space", "fa", "fb")
    return different.unionByName(alike).select(F.least("fa", "fb").alias("form_a"), F.greatest("fa", "fb").alias("form_b"), F.col("space").alias("merkmal"))


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """(form_id, merkmal, klasse, n_links): each form's class of equal sets and the number of forms it is linked with."""
    pairs, members = set_join(form_sets(spark, folder))
    size = members.groupBy("space", "klasse").agg(F.count("*").alias("n"))
    ends = pairs.select("space", F.col("a").alias("klasse"), F.col("b").alias("other")).unionByName(pairs.select("space", F.col("b").alias("klasse"), F.col("a").alias("other")))
    linked = skew_join(ends, size.select("space", F.col("klasse").alias("other"), F.col("n").alias("m")), ["space", "other"]).groupBy("space", "klasse").agg(F.sum("m").alias("links"))
    counted = size.join(linked, ["space", "klasse"], "left").select("space", "klasse", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return skew_join(members, counted, ["space", "klasse"], weight="n").select(F.col("id").alias("form_id"), F.col("space").alias("merkmal"), "klasse", "n_links")


_PAIRS = """
WITH s AS (
  SELECT DISTINCT 'names' merkmal, form_id f, hash(trim(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', ' ', 'g'))) t FROM data_field WHERE geloescht_am IS NULL AND name IS NOT NULL
  UNION SELECT DISTINCT 'ech', form_id, CAST(ech_element_id AS UBIGINT) FROM data_field WHERE geloescht_am IS NULL AND ech_element_id IS NOT NULL),
c AS (SELECT merkmal, f, count(*) n FROM s GROUP BY merkmal, f HAVING count(*) >= 4),
o AS (SELECT a.merkmal, a.f fa, b.f fb, count(*) o FROM s a JOIN s b ON a.merkmal = b.merkmal AND a.t = b.t AND a.f < b.f GROUP BY a.merkmal, a.f, b.f HAVING count(*) >= 2),
p AS (SELECT o.merkmal, fa, fb FROM o JOIN c x ON x.merkmal = o.merkmal AND x.f = fa JOIN c y ON y.merkmal = o.merkmal AND y.f = fb WHERE 5 * o >= 3 * (x.n + y.n - o))
"""
SQL = {
    "p4_found": _PAIRS + "SELECT fa form_a, fb form_b, merkmal FROM p",
    "p4_links": _PAIRS
    + """, l AS (SELECT merkmal, f, count(*) n FROM (SELECT merkmal, fa f FROM p UNION ALL SELECT merkmal, fb FROM p) GROUP BY merkmal, f),
k AS (SELECT merkmal, f, list(t ORDER BY t) ts FROM s JOIN c USING (merkmal, f) GROUP BY merkmal, f)
SELECT k.f form_id, k.merkmal, min(k.f) OVER (PARTITION BY k.merkmal, ts) klasse, coalesce(l.n, 0) n_links FROM k LEFT JOIN l USING (merkmal, f)""",
}
QUERIES = {"p4_found": p4_found, "p4_links": p4_links}
