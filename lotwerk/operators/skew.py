"""Joins whose big side may have keys that hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwerk.session import cut

#: Rows of a key from which it is heavy.
SPLIT_ROWS = 100_000
#: Bound of the list of heavy keys that is broadcast. A table of N rows has at most N / SPLIT_ROWS heavy keys; where these
#: are more than HEAVY, the largest are taken, and any other key has N / HEAVY rows at most.
HEAVY = 100_000


def _heavy(counts: DataFrame, keys: list[str], split_rows: int, *columns: Column) -> DataFrame:
    """The heavy keys of counts(keys, __n)."""
    return counts.filter(F.col("__n") > split_rows).orderBy(F.desc("__n"), *keys).limit(HEAVY).select(*keys, *columns)


def skew_join(big: DataFrame, unique: DataFrame, keys: list[str], weight: str | None = None, how: str = "inner", split_rows: int | None = None) -> DataFrame:
    """big joined to unique, which has one row a key at most.

    Keys with more than split_rows (SPLIT_ROWS) rows of big, by unique's column weight where it knows them, else counted,
    are joined by broadcast of their rows of unique, one a key, so that no task gets all rows of a hot key; the other keys
    are shuffled. how: inner or left. Null keys match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    columns = [*big.columns, *(c for c in unique.columns if c not in keys)]
    blank = None
    if how == "left":  # rows with a null key would all meet in one task, and match nothing
        whole = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys))
        blank = big.filter(~whole).select(*big.columns, *(F.lit(None).cast(unique.schema[c].dataType).alias(c) for c in columns[len(big.columns) :]))
        big = big.filter(whole)
    counts = unique.select(*keys, F.col(weight).alias("__n")) if weight else big.groupBy(*keys).agg(F.count("*").alias("__n"))
    heavy = _heavy(counts, keys, SPLIT_ROWS if split_rows is None else split_rows)
    big_hot, big_rest = (big.join(F.broadcast(heavy), keys, kind) for kind in ("left_semi", "left_anti"))
    some = unique.join(F.broadcast(heavy), keys, "left_semi")
    out = big_hot.join(F.broadcast(some), keys, how).select(*columns).unionByName(big_rest.join(unique, keys, how).select(*columns))
    return out if blank is None else out.unionByName(blank)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], split_rows: int | None = None, both: bool = False) -> DataFrame:
    """Inner join where both sides may have many rows a key.

    Keys with more than split_rows (SPLIT_ROWS) rows of big are split by the hash of big's rows into parts of about that
    size; small's rows of such a key go to each part. With both, keys with many rows of small are split the other way as
    well, so that a task gets a part of either side. The other keys are joined as they are. Null keys match nothing.
    """
    split_rows = SPLIT_ROWS if split_rows is None else split_rows
    parts = F.coalesce("__parts", F.lit(1))

    def salted(many: DataFrame, few: DataFrame, salt: str) -> tuple[DataFrame, DataFrame]:
        counts = many.groupBy(*keys).agg(F.count("*").alias("__n"))
        heavy = F.broadcast(_heavy(counts, keys, split_rows, F.ceil(F.col("__n") / split_rows).cast("int").alias("__parts")))
        split = many.join(heavy, keys, "left").withColumn(salt, F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("__parts")
        return split, few.join(heavy, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")

    big, small = salted(big, small, "__s")
    if not both:
        return big.join(small, [*keys, "__s"]).drop("__s")
    small, big = salted(small, big, "__t")
    return big.join(small, [*keys, "__s", "__t"]).drop("__s", "__t")


#: Rows of a lookup table up to which checked_join broadcasts it.
MAX_LOOKUP = 200_000


def checked_join(big: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", most: int = MAX_LOOKUP) -> DataFrame:
    """big joined to unique, which has one row a key at most: by broadcast if, counted, it has most rows or fewer, else
    by skew_join. unique is written to the shared folder first, so that it is made once."""
    unique = cut(unique)
    if unique.count() <= most:
        return big.join(F.broadcast(unique), keys, how)
    return skew_join(big, unique, keys, how=how)
