"""Gates: queries that return the rows that break a rule, and a registry to run them all before a table is published."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """child's rows whose non-null column is not in parent's key."""
    keys = parent.select(F.col(key).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def vocabulary(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose non-null column is none of values."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(values)))


def iff(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows where exactly one of two conditions holds."""
    return df.filter(a != b)


def implies(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows where a holds and b does not, null counting as not."""
    return df.filter(a & ~F.coalesce(b, F.lit(False)))


def schema_drift(df: DataFrame, expected: T.StructType) -> list[str]:
    """Columns missing, added or of another type."""
    have, want = ({f.name: f.dataType.simpleString() for f in x.fields} for x in (df.schema, expected))
    out = [f"{c} is missing" for c in want if c not in have] + [f"{c} is not declared" for c in have if c not in want]
    return out + [f"{c} is {have[c]}, not {want[c]}" for c in want if c in have and have[c] != want[c]]


class Gates:
    """A registry of named gates, each a function of a session that returns error rows."""

    def __init__(self) -> None:
        self._gates: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str) -> Callable:
        def put(f: Callable[[SparkSession], DataFrame]) -> Callable:
            if name in self._gates:
                raise ValueError(f"gate {name} exists")
            self._gates[name] = f
            return f

        return put

    def errors(self, spark: SparkSession) -> dict[str, int]:
        """The number of errors of every gate that has any."""
        counts = {name: f(spark).count() for name, f in self._gates.items()}
        return {k: n for k, n in counts.items() if n}


def sum_of_parts(parts: DataFrame, whole: DataFrame, keys: Sequence[str], value: str, total: str) -> DataFrame:
    """(keys, teile, ganzes): where the sum of parts' value is not whole's total; a side that is missing counts as null."""
    p = parts.groupBy(*keys).agg(F.sum(value).alias("teile"))
    w = whole.select(*keys, F.col(total).alias("ganzes"))
    return p.join(w, list(keys), "full").filter(~F.col("teile").eqNullSafe(F.col("ganzes")))


def wording(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(spalte, muster, n): how many values of every text column match each pattern that no text may, in one pass."""
    columns = [c for c, kind in df.dtypes if kind == "string"]
    cells = [(c, k) for c in columns for k in patterns]
    row = df.agg(*(F.count_if(F.col(c).rlike(patterns[k])).alias(f"n{i}") for i, (c, k) in enumerate(cells)))
    found = F.array(*(F.struct(F.lit(c).alias("spalte"), F.lit(k).alias("muster"), F.col(f"n{i}").alias("n")) for i, (c, k) in enumerate(cells)))
    return row.select(F.explode(found).alias("x")).select("x.*").filter("n > 0")
