"""Reusable relational operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwerk.operators.meeting import classes_of, similar_sets
from lotwerk.operators.skew import salted_join, skew_join
from lotwerk.session import cut, drop

#: Copies of a set from which their pairs are given by several tasks.
COPIES = 2_000
#: Members of a class among which a known partner is looked up.
BLOCK = 1_000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row a key: columns of the row that is greatest by order. Combines before the shuffle, unlike a window."""
    best = F.max(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*columns).alias("row")))
    return df.groupBy(*keys).agg(best.alias("best")).select(*keys, *(F.col(f"best.row.{c}").alias(c) for c in columns))


def first_wins(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(keys, value): a lookup table in which the first row of a key by order stays."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_wins(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(keys, value): a lookup table in which the last row of a key by order stays."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group by order, with their rank; Spark prunes to k a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def mode_per_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, total): each key's most frequent value; of equally frequent ones the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col(value)))
    return counts.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("total")).select(*keys, F.col(f"b.{value}").alias(value), (-F.col("b.minus")).alias("n"), "total")


def majority(df: DataFrame, keys: Sequence[str], value: str, share: tuple[int, int] = (2, 3), least: int = 1) -> DataFrame:
    """mode_per_key() of the keys with least rows or more whose mode has the share of them, compared in integers."""
    top, of = share
    return mode_per_key(df, keys, value).filter((F.col("total") >= least) & (F.col("n") * of >= F.col("total") * top))


def leave_one_out(df: DataFrame, key: Sequence[str], group: str, flag: Column) -> DataFrame:
    """(key, group, mine, mine_yes, others, others_yes): a group's rows of a key beside those of all other groups."""
    own = df.groupBy(*key, group).agg(F.count("*").alias("mine"), F.count_if(flag).alias("mine_yes"))
    whole = df.groupBy(*key).agg(F.count("*").alias("all"), F.count_if(flag).alias("all_yes"))
    return own.join(whole, list(key)).select(*key, group, "mine", "mine_yes", (F.col("all") - F.col("mine")).alias("others"), (F.col("all_yes") - F.col("mine_yes")).alias("others_yes"))


def unanimous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): keys whose non-null values all agree, with that value."""
    known = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
    return known.filter("low = high").select(key, F.col("low").alias(value), "n")


def parts_of_total(df: DataFrame, part: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, part, n, total): disjoint parts beside the total they must add up to."""
    parts = df.select(*keys, part.alias("part")).groupBy(*keys, "part").agg(F.count("*").alias("n"))
    whole = df.groupBy(*keys).agg(F.count("*").alias("total"))
    if keys:
        return parts.join(whole, list(keys))
    return parts.withColumn("one", F.lit(1)).join(F.broadcast(whole.withColumn("one", F.lit(1))), "one").drop("one")  # one row


def first_match(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The name of the first rule that holds."""
    chain = None
    for cond, name in rules:
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return chain.otherwise(default)


def all_matches(rules: Sequence[tuple[Column, str]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(cond, name) for cond, name in rules)))


def changed_columns(old: str, new: str, columns: Sequence[str]) -> Column:
    """Names of the columns that differ between the structs old and new; null differs from any value."""
    return F.array_compact(F.array(*(F.when(~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")), F.lit(c)) for c in columns)))


def full_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, art, felder): neu, entfernt or geaendert rows between two versions of a table with one row a key."""
    o, n = (d.select(*keys, F.struct(*columns).alias(x)) for d, x in ((old, "o"), (new, "n")))
    felder = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), F.array_join(changed_columns("o", "n", columns), ","))
    art = F.when(F.col("o").isNull(), "neu").when(F.col("n").isNull(), "entfernt").when(felder != "", "geaendert")
    return o.join(n, list(keys), "full").select(*keys, art.alias("art"), felder.alias("felder")).filter("art is not null")


def upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str], columns: Sequence[str], fill_only: bool = False) -> DataFrame:
    """base with batch's rows put in by key; fill_only: only where base has null. Both have one row a key."""
    b, u = (d.select(*keys, F.struct(*columns).alias(x)) for d, x in ((base, "b"), (batch, "u")))
    first, second = ("b", "u") if fill_only else ("u", "b")
    return b.join(u, list(keys), "full").select(
        *keys,
        *(F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c) if fill_only else F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns),
    )


def merge_rows(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a key with, for each column, the first non-null value by order."""
    return df.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in columns))


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str, value: str, block: Column | None = None) -> DataFrame:
    """left with value of right's row of the same keys with the greatest since <= at; null if there is none.

    block(column time) puts times into ordered blocks, as a day. Rows are matched within a block; where that finds
    none, the last row of the blocks before it is taken, found over one row a block. No window holds more than one
    block's rows of a key, or one row a block. Of several rows at the same since the one with the greatest value holds.
    """
    blk = block if block is not None else F.date_trunc("day", F.col("t"))
    extra = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.struct(*extra).alias("row"), F.col(at).alias("t"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("kind"))  # noqa: E741
    r = right.select(*keys, F.lit(None).cast(l.schema["row"].dataType).alias("row"), F.col(since).alias("t"), F.col(value).alias("v"), F.lit(0).alias("kind"))
    both = l.unionByName(r).withColumn("block", blk)
    inside = Window.partitionBy(*keys, "block").orderBy("t", "kind", "v").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last(F.when(F.col("kind") == 0, F.struct("v")), ignorenulls=True).over(inside))
    ends = r.withColumn("block", blk).groupBy(*keys, "block").agg(F.max(F.struct("t", "v")).alias("end"))
    later = Window.partitionBy(*keys).orderBy("block")
    reach = ends.select(*keys, F.col("end.v").alias("before"), F.col("block").alias("from"), F.lead("block").over(later).alias("to"))
    blocks = l.withColumn("block", blk).select(*keys, "block").distinct().withColumnRenamed("block", "b")
    marks = blocks.select(*keys, F.col("b").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast(right.schema[value].dataType).alias("before"))
    marks = marks.unionByName(reach.select(*keys, F.col("from").alias("x"), F.lit(2).alias("kind"), "before"))
    so_far = Window.partitionBy(*keys).orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("far", F.last(F.when(F.col("kind") == 2, F.struct("before")), ignorenulls=True).over(so_far)).filter("kind = 1").select(*keys, F.col("x").alias("block"), "far")
    out = near.filter("kind = 1").join(carried, [*keys, "block"], "left")
    return out.select(*keys, "row.*", F.coalesce("near.v", "far.before").alias(value))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """points and ranges with low <= at < high, joined over buckets of width instead of all against all."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    r = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__b").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__b")


def class_of(value: Column, classes: Sequence[tuple[int, str]]) -> Column:
    """The label of the class value falls in; classes are (lowest value, label) in rising order."""
    return reduce(lambda rest, c: F.when(value >= c[0], c[1]).otherwise(rest), classes, F.lit(None).cast("string"))


def facet_counts(df: DataFrame, facets: dict[str, str | None]) -> DataFrame:
    """(facet, value, n): for each facet the counts of its values under the filters chosen on all the other facets."""
    chosen = {c: F.col(c) == v for c, v in facets.items() if v is not None}
    parts = []
    for c in facets:
        keep = reduce(lambda a, b: a & b, (cond for k, cond in chosen.items() if k != c), F.lit(True))
        parts.append(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"), keep.alias("keep")))
    return df.select(F.explode(F.array(*parts)).alias("x")).select("x.*").filter("keep").groupBy("facet", "value").agg(F.count("*").alias("n"))


def keyword_search(df: DataFrame, label: str, text: str, query: str) -> DataFrame:
    """df's rows whose text contains all of query's tokens (of two letters or more), with score.

    2 points if the label begins with the first token, 1 if the label has all tokens, 3 if all stand at a word's start.
    """
    tokens = [t for t in query.lower().split() if len(t) >= 2]
    low, key = F.lower(label), F.lower(text)
    every = lambda f: reduce(lambda a, b: a & b, map(f, tokens), F.lit(True))
    score = F.when(low.startswith(tokens[0]), 2).otherwise(0) + F.when(every(low.contains), 1).otherwise(0)
    score += F.when(every(lambda t: F.concat(F.lit(" "), key).contains(f" {t}")), 3).otherwise(0)
    return df.filter(every(key.contains)).withColumn("score", score)


def symmetric(df: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected pairs as rows of both ends, in one pass over df."""
    rest = [c for c in df.columns if c not in (a, b)]
    ends = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))
    return df.select(F.explode(ends).alias("e"), *rest).select(F.col("e.x").alias(a), F.col("e.y").alias(b), *rest)


def jaccard_classes(sets: DataFrame, threshold: float, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(pairs(a, b, o, jaccard), members(id, klasse, n, size)) of sets(id, token), a row a member of a set of min_size or more.

    Equal sets are one class of n, named by its smallest id; pairs a < b are classes that have threshold in common, by
    meeting.similar_sets. Null ids and tokens are left out. Tokens are compared as 64-bit hashes: two differ with a chance
    of 2**-63 of being taken for one.
    """
    known = sets.filter("id is not null and token is not null")
    tokens = F.sort_array(F.collect_set(F.xxhash64("token")))
    own = cut(known.groupBy("id").agg(tokens.alias("tokens")).filter(F.size("tokens") >= min_size).select(F.lit("").alias("space"), "id", "tokens"))
    classes, members = classes_of(own)
    pairs = similar_sets(classes.select("space", "id", "tokens", F.lit(True).alias("pivot")), threshold, min_size)
    j = F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))
    members = members.join(classes.filter("n > 1").select(F.col("id").alias("klasse"), F.size("tokens").alias("size")), "klasse", "left")
    return cut(pairs.select("a", "b", "o", j.alias("jaccard"))), members.select("id", "klasse", "n", "size")


def jaccard_pairs(sets: DataFrame, threshold: float, min_size: int) -> DataFrame:
    """(a, b, o, jaccard) with a < b of sets(id, token), a row a member: pairs of sets that have threshold in common. Pairs of
    classes (see jaccard_classes) are expanded to their members last, and not shuffled after."""
    pairs, members = jaccard_classes(sets, threshold, min_size)
    x, y = (members.select(F.col("klasse").alias(k), F.col("id").alias(i)) for k, i in (("a", "x"), ("b", "y")))
    different = salted_join(salted_join(pairs, x, ["a"], both=True), y, ["b"], both=True).select("x", "y", "o", "jaccard")
    many = members.filter("n > 1").select("klasse", F.col("id").alias("x"), F.col("size").alias("o"), F.lit(1.0).alias("jaccard"))
    alike = salted_join(many, many.select("klasse", F.col("x").alias("y")), ["klasse"], COPIES, both=True).filter("x < y").select("x", "y", "o", "jaccard")
    return different.unionByName(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "o", "jaccard")


def jaccard_pairs_with(sets: DataFrame, threshold: float, min_size: int, known: DataFrame) -> DataFrame:
    """(a, b, known's columns) of jaccard_pairs(), left joined to known, which has one row a pair a < b at most.

    The pairs are not shuffled for this: known's rows are brought to the pairs while these are half expanded, one row for
    each set and similar class, the set's own included, and looked up as the other half is. Of a class with many members
    BLOCK or so are a block of their own, so that no list of known partners is longer.
    """
    columns = [c for c in known.columns if c not in ("a", "b")]
    pairs, members = jaccard_classes(sets, threshold, min_size)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.select("id", "klasse", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    known = cut(known)
    placed = cut(skew_join(known, own.select(F.col("id").alias("a"), F.col("klasse").alias("ka"), F.col("block").alias("in_a")), ["a"]))
    drop(known)
    ends = skew_join(placed, own.select(F.col("id").alias("b"), F.col("klasse").alias("kb"), F.col("block").alias("in_b")), ["b"])
    rising = F.col("ka") <= F.col("kb")  # x is of the smaller class, of one class the smaller id
    x, y, block = (F.when(rising, F.col(p)).otherwise(F.col(q)).alias(c) for p, q, c in (("a", "b", "x"), ("b", "a", "y"), ("in_b", "in_a", "block")))
    partners = F.collect_list(F.struct("y", F.struct(*columns).alias("row")))
    seen = ends.select(x, y, F.greatest("ka", "kb").alias("klasse"), block, *columns).groupBy("x", "klasse", "block").agg(partners.alias("seen"))

    others = salted_join(pairs.select("a", "b"), members.select(F.col("klasse").alias("a"), F.col("id").alias("x")), ["a"], both=True)
    half = others.select("x", F.col("b").alias("klasse"), F.lit(False).alias("alike"))
    half = half.unionByName(members.filter("n > 1").select(F.col("id").alias("x"), "klasse", F.lit(True).alias("alike")))
    large = F.broadcast(members.filter((F.col("id") == F.col("klasse")) & (F.col("n") > BLOCK)).select("klasse", blocks.alias("blocks")))
    half = half.join(large, "klasse", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    half = cut(half.join(seen, ["x", "klasse", "block"], "left"))
    drop(placed)
    out = salted_join(half, own.withColumnRenamed("id", "y"), ["klasse", "block"], COPIES).filter("not alike or x < y")
    row = F.get("seen.row", (F.array_position("seen.y", F.col("y")) - 1).cast("int"))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), row.alias("row")).select("a", "b", *(F.col(f"row.{c}").alias(c) for c in columns))


def best_partners(sets: DataFrame, threshold: float, min_size: int) -> DataFrame:
    """(id, partner, jaccard): each set's best partner in jaccard_pairs(), of equally good ones the smallest.

    Nothing is as good as an equal set, so pairs are not expanded: a set of a class of several goes to the smallest other
    one of its class, any other to the smallest one of the best class.
    """
    pairs, members = jaccard_classes(sets, threshold, min_size)
    best = symmetric(pairs.select("a", "b", "jaccard"), "a", "b").groupBy("a").agg(F.min(F.struct((-F.col("jaccard")).alias("minus"), "b")).alias("x"))
    single = members.filter("n = 1").join(best.withColumnRenamed("a", "id"), "id").select("id", F.col("x.b").alias("partner"), (-F.col("x.minus")).alias("jaccard"))
    many = members.filter("n > 1")
    second = many.filter("id <> klasse").groupBy("klasse").agg(F.min("id").alias("second"))
    equal = skew_join(many, second, ["klasse"]).select("id", F.when(F.col("id") == F.col("klasse"), F.col("second")).otherwise(F.col("klasse")).alias("partner"), F.lit(1.0).alias("jaccard"))
    return single.unionByName(equal)


def greedy_sets(sets: DataFrame, threshold: float, min_size: int) -> DataFrame:
    """(a, b, jaccard): greedy_one_to_one() of jaccard_pairs(), without expanding them.

    Pairs of equal sets come first: they leave each id of a class with the next one. As left only a class's last id is free
    then, as right only its first, so a pair of classes is one pair of ids at most either way.
    """
    pairs, members = jaccard_classes(sets, threshold, min_size)
    following = F.lead("id").over(Window.partitionBy("klasse").orderBy("id"))
    chain = members.filter("n > 1").select(F.col("id").alias("a"), following.alias("b"), F.lit(1.0).alias("jaccard")).filter("b is not null")
    last = members.groupBy("klasse").agg(F.max("id").alias("last"))
    ends = symmetric(pairs.select("a", "b", "jaccard"), "a", "b").join(last.withColumnRenamed("klasse", "a"), "a")
    free = ends.filter("last < b").select(F.col("last").alias("a"), "b", "jaccard")
    return chain.unionByName(greedy_one_to_one(free, "a", "b", "jaccard"))


def match_in_waves(left: DataFrame, right: DataFrame, lid: str, rid: str, waves: Sequence[tuple[str, Sequence[str]]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched(lid, rid, wave), left without a partner, right without a partner).

    In each wave rows pair if their columns are equal, none null, and no other row of either side that is still free
    has the same; uniqueness is counted by aggregation, so the join is one to one and a hot value never meets another.
    """
    matched = None
    for name, columns in waves:
        sides = []
        for df, id_ in ((left, lid), (right, rid)):
            known = df.dropna(subset=list(columns))
            sides.append(known.groupBy(*columns).agg(F.count("*").alias("c"), F.min(id_).alias(id_)).filter("c = 1").drop("c"))
        pairs = sides[0].join(sides[1], list(columns)).select(lid, rid, F.lit(name).alias("wave"))
        pairs = cut(pairs)
        matched = pairs if matched is None else matched.unionByName(pairs)
        left, right = left.join(pairs.select(lid), lid, "left_anti"), right.join(pairs.select(rid), rid, "left_anti")
    return matched, left, right


def greedy_one_to_one(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """The pairs that taking the best score first, and each side once, leaves; ties by left, then right.

    In each round every pair that is the best of both its sides is taken and what shares a side with it drops out; that
    is the same set as one pass in order of score, without a driver's loop over rows.
    """
    rank = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    free = cut(pairs.select(left, right, score).distinct())
    taken = []
    while not free.isEmpty():
        best_l = free.groupBy(left).agg(F.min(rank).alias("__b")).select("__b")
        best_r = free.groupBy(right).agg(F.min(rank).alias("__b")).select("__b")
        both = cut(best_l.intersect(best_r).select(F.col("__b.l").alias(left), F.col("__b.r").alias(right), (-F.col("__b.s")).alias(score)))
        taken.append(both)
        before, free = free, cut(free.join(both.select(left), left, "left_anti").join(both.select(right), right, "left_anti"))
        drop(before)
    return reduce(DataFrame.unionByName, taken) if taken else free


def _numbered_grams(name: Column, gram: int) -> Column:
    """The grams of name, a gram's second occurrence being another gram than its first."""
    cells = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - gram + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(gram)))
    return F.transform(cells, lambda x, i: F.concat_ws("/", F.size(F.filter(F.slice(cells, 1, i + 1), lambda y: y == x)).cast("string"), x))


def _shortened(name: Column, most: int) -> Column:
    """name with 0 to most letters left out, every way."""
    rows = last = F.array(name)
    for _ in range(most):
        last = F.flatten(F.transform(last, lambda s: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: i <= F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        last = F.array_distinct(last)
        rows = F.concat(rows, last)
    return F.array_distinct(rows)


def edit_pairs(names: DataFrame, most: int, gram: int = 2) -> DataFrame:
    """(a, b, d): all pairs a < b of distinct names(name) at most most insertions, deletions or replacements apart.

    An edit touches gram of a name's numbered grams, so names within most edits share one of their most * gram + 1 rarest
    if both have more than that many. Shorter names and what is near them in length share what is left when most letters
    are taken out of either.
    """
    distinct = cut(names.filter("name is not null").select("name").distinct())
    need = most * gram + 1
    grams = distinct.select("name", F.explode(_numbered_grams(F.col("name"), gram)).alias("g"))
    counts = grams.groupBy("g").agg(F.count("*").alias("n"))
    ranked = skew_join(grams, counts, ["g"], weight="n").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda x: x["g"]).alias("gs"))
    longest_short = need + gram - 1
    keys = ranked.filter(F.length("name") > longest_short).select("name", F.explode(F.slice("gs", 1, need)).alias("k"))
    some = distinct.filter(F.length("name") <= longest_short + most)
    short = some.select("name", F.explode(_shortened(F.col("name"), most)).alias("k"))
    met = None
    for posted in (keys, short):
        posted = cut(posted)
        one = salted_join(posted.select(F.col("name").alias("a"), "k"), posted.select(F.col("name").alias("b"), "k"), ["k"]).filter("a < b").select("a", "b")
        met = one if met is None else met.union(one)
    d = F.levenshtein("a", "b")
    return met.distinct().withColumn("d", d).filter(F.col("d") <= most)


def _ratio(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in pairs:
        yield b.assign(ratio=[SequenceMatcher(None, x, y).ratio() for x, y in zip(b["a"], b["b"])])


def ratio_pairs(names: DataFrame, least: float, gram: int = 2) -> DataFrame:
    """(a, b, ratio): all ordered pairs a <> b of distinct names(name) whose difflib ratio is least (over 0.8) or more.

    A ratio leaves (1 - least) * (length of a + length of b) letters unmatched at most, and lengths 2 / least - 1 apart;
    so many insertions and deletions touch gram times as many of a name's numbered grams, and the rarest ones beyond are shared.
    """
    distinct = names.filter("name is not null and name <> ''").select("name").distinct()
    grams = distinct.select("name", F.explode(_numbered_grams(F.col("name"), gram)).alias("g"))
    counts = grams.groupBy("g").agg(F.count("*").alias("n"))
    ranked = grams.join(counts, "g").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda x: x["g"]).alias("gs"))
    touched = (F.floor((1 - least) * (2 / least) * F.length("name") + 1e-9) * gram + 1).cast("int")
    posted = ranked.select("name", F.length("name").alias("l"), F.explode(F.slice("gs", F.lit(1), touched)).alias("k"))
    met = posted.select(F.col("name").alias("a"), F.col("l").alias("la"), "k").join(posted.select(F.col("name").alias("b"), F.col("l").alias("lb"), "k"), "k")
    met = met.filter((F.col("a") < F.col("b")) & (2 * F.least("la", "lb") >= (least - 1e-9) * (F.col("la") + F.col("lb")))).select("a", "b").distinct()
    near = met.filter(F.levenshtein("a", "b") <= (1 - least) * (F.length("a") + F.length("b")) + 1e-9)
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return near.repartition("a").mapInPandas(_ratio, "a string, b string, ratio double").filter(F.col("ratio") >= least)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """df with the row number name of each row in its group by order. block rises with order; rows are numbered within
    blocks and go on from the sizes of the blocks before, so that no window holds more than a block of a group."""
    placed = df.withColumn("__b", block)
    sizes = placed.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    return placed.join(offset, [*keys, "__b"]).withColumn(name, inside + F.col("__o")).drop("__b", "__o")


#: Rows of a block of a stratum that one window holds, about.
SAMPLE_BLOCK = 16_384


def first_in_hash_order(df: DataFrame, stratum: str, key: str, size: DataFrame) -> DataFrame:
    """df(stratum, key) with of every stratum the first k rows in the order of key's MD5; size(stratum, k).

    Rows are put in blocks by the hash's first bits and the blocks counted; only a block that the k rows reach into is
    put in order, so that a stratum of any size is never in one window. A null stratum is a stratum.
    """
    rows = cut(df.withColumn("__h", F.md5(F.col(key).cast("string"))))
    digits = max(0, (rows.count() // SAMPLE_BLOCK).bit_length() + 3) // 4
    rows = rows.withColumn("__b", F.substring("__h", 1, digits) if digits else F.lit(""))
    sizes = rows.groupBy(stratum, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(stratum).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    reached = sizes.withColumn("__o", before).join(size.select(F.col(stratum).alias("__s"), F.col("k").alias("__k")), F.col(stratum).eqNullSafe(F.col("__s"))).filter("__o < __k")
    reached = reached.select("__s", F.col("__b").alias("__c"), "__o", "__k")
    some = rows.join(reached, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__c")))
    nr = F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__h", key)) + F.col("__o")
    return some.withColumn("__r", nr).filter("__r <= __k").select(*df.columns)


def terms_in_texts(documents: DataFrame, terms: DataFrame, id_: str, at_once: int = 50_000) -> DataFrame:
    """(id, doc_id): the terms(id, term) that documents(doc_id, text) contain, wherever they stand, letter for letter.

    An automaton of the terms passes over each text once; lists longer than at_once are taken in several passes. Null texts
    and null or empty terms give nothing; repeated rows are found once each.
    """
    docs = documents.filter("text is not null").select("doc_id", "text")
    terms = cut(terms.filter(f"{id_} is not null and term is not null and term <> ''").select(id_, "term").distinct())
    parts = max(1, -(-terms.count() // at_once))
    out = None
    for k in range(parts):
        some = [(r[0], r[1]) for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()]  # about at_once
        sent = documents.sparkSession.sparkContext.broadcast(some)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import ahocorasick

            ids: dict[str, list] = {}
            for i, term in sent.value:
                ids.setdefault(term, []).append(i)
            automaton = ahocorasick.Automaton()
            for term, i in ids.items():
                automaton.add_word(term, i)
            automaton.make_automaton()
            for b in batches:
                rows = [(i, doc) for doc, text in zip(b["doc_id"], b["text"]) for i in ({i for _, found in automaton.iter(text) for i in found} if ids else ())]
                yield pd.DataFrame(rows, columns=[id_, "doc_id"])

        kinds = dict(terms.dtypes)[id_], dict(docs.dtypes)["doc_id"]
        one = docs.mapInPandas(search, f"{id_} {kinds[0]}, doc_id {kinds[1]}")
        out = one if out is None else out.unionByName(one)
    return out
