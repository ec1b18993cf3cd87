"""The reusable operators on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lotwerk.operators import gates as G
from lotwerk.operators import relational as R
from lotwerk.operators import skew


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_as_of_join_over_blocks(spark):
    rnd = random.Random(4)
    t0 = dt.datetime(2026, 1, 1)
    at = lambda: t0 + dt.timedelta(hours=rnd.randint(0, 24 * 12))
    left = [(i, rnd.choice("ab"), at()) for i in range(200)]
    right = [(rnd.choice("abc"), at(), rnd.randint(0, 99)) for _ in range(25)]
    got = R.as_of_join(spark.createDataFrame(left, "i int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, since timestamp_ntz, val int"), ["k"], "t", "since", "val")
    want = {i: max(((s, v) for k2, s, v in right if k2 == k and s <= t), default=(0, None))[1] for i, k, t in left}
    assert {r.i: r.val for r in got.collect()} == want
    assert got.count() == 200


def test_skew_joins(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY", 2)
    monkeypatch.setattr(skew, "SPLIT_ROWS", 15)
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 20}", None if i % 11 == 0 else i % 4) for i in range(400)], "i int, k string, z int")
    small = spark.createDataFrame([("hot", 1, 5), ("k0", 2, 5), ("k3", 2, 6), ("none", 3, 7), (None, 4, 8)], "k string, v int, w int")
    for how in ("inner", "left"):
        assert rows(skew.skew_join(big, small, ["k"], how=how).select("i", "v", "w").na.fill(-1)) == rows(big.join(small, "k", how).select("i", "v", "w").na.fill(-1))
        assert rows(skew.skew_join(big, small, ["k"], weight="w", how=how).select("i", "v").na.fill(-1)) == rows(big.join(small, "k", how).select("i", "v").na.fill(-1))
    gaps = big.withColumn("k", F.when(F.col("i") % 4 > 0, F.col("k")))
    for w in (None, "w"):
        assert rows(skew.skew_join(gaps, small, ["k"], w, "left").select("i", "v", "w").na.fill(-1)) == rows(gaps.join(small, "k", "left").select("i", "v", "w").na.fill(-1))
    assert rows(skew.checked_join(gaps, small, ["k"], "left", 0).select("i", "v").na.fill(-1)) == rows(gaps.join(small, "k", "left").select("i", "v").na.fill(-1))
    many = small.union(small)
    for both in (False, True):
        assert rows(skew.salted_join(big, many, ["k"], 1, both).select("i", "v")) == rows(big.join(many, "k").select("i", "v"))
    assert rows(skew.salted_join(big, many, ["k"], 20).select("i", "v")) == rows(big.join(many, "k").select("i", "v"))
    with pytest.raises(ValueError):
        skew.skew_join(big, small, ["k"], how="full")


def test_mode_majority_and_unanimity(spark):
    df = spark.createDataFrame([("a", x) for x in "xxyy"] + [("b", x) for x in "zzy"] + [("c", None), ("c", "q")], "k string, v string")
    assert rows(R.mode_per_key(df.filter("k <> 'c'"), ["k"], "v")) == [("a", "x", 2, 4), ("b", "z", 2, 3)]
    assert rows(R.majority(df, ["k"], "v", (2, 3), 3)) == [("b", "z", 2, 3)]
    assert rows(R.unanimous(df, "k", "v")) == [("c", "q", 1)]


def test_diff_upsert_and_waves(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, s string, n int")
    b = spark.createDataFrame([(2, "y", None), (3, "z", 1), (4, "w", 2)], "k int, s string, n int")
    assert rows(R.full_diff(a, b, ["k"], ["s", "n"]).na.fill("")) == [(1, "entfernt", ""), (2, "geaendert", "n"), (4, "neu", "")]
    assert rows(R.upsert(a, b, ["k"], ["s", "n"]).na.fill(-1)) == [(1, "x", -1), (2, "y", -1), (3, "z", 1), (4, "w", 2)]
    assert rows(R.upsert(a, b, ["k"], ["n"], fill_only=True).na.fill(-1)) == [(1, -1), (2, 1), (3, 1), (4, 2)]
    left = spark.createDataFrame([("l1", "a", "1"), ("l2", "b", "2"), ("l3", "b", "3"), ("l4", "c", None)], "l string, x string, y string")
    right = spark.createDataFrame([("r1", "a", "1"), ("r2", "b", "3"), ("r3", "b", "9"), ("r4", "c", None)], "r string, x string, y string")
    m, old, new = R.match_in_waves(left, right, "l", "r", [("both", ["x", "y"]), ("one", ["x"])])
    assert rows(m) == [("l1", "r1", "both"), ("l2", "r3", "one"), ("l3", "r2", "both"), ("l4", "r4", "one")]
    assert old.count() == new.count() == 0


def test_small_helpers(spark):
    df = spark.createDataFrame([(1, "Amt für Bau", "bau amt"), (2, "Bauamt", "das bauamt"), (3, "Schule", "schule")], "i int, label string, txt string")
    assert [(r.i, r.score) for r in R.keyword_search(df, "label", "txt", "bau a").orderBy("i").collect()] == [(1, 4), (2, 6)]
    assert rows(R.symmetric(spark.createDataFrame([(1, 2, "x")], "a int, b int, c string"), "a", "b")) == [(1, 2, "x"), (2, 1, "x")]
    p = spark.createDataFrame([(1.0,), (5.0,), (10.0,)], "v double")
    r = spark.createDataFrame([("a", 0.0, 5.0), ("b", 5.0, 100.0)], "n string, lo double, hi double")
    assert rows(R.range_join(p, r, "v", "lo", "hi", 3.0).select("v", "n")) == [(1.0, "a"), (5.0, "b"), (10.0, "b")]
    f = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "a string, b string")
    assert rows(R.facet_counts(f, {"a": "x", "b": None})) == [("a", "x", 2), ("a", "y", 1), ("b", "1", 1), ("b", "2", 1)]
    assert rows(R.parts_of_total(f, F.col("a"))) == [("x", 2, 3), ("y", 1, 3)]
    s = spark.createDataFrame([(i, t) for i, ts in {1: "abcd", 2: "abce", 3: "wxyz"}.items() for t in ts], "id int, token string")
    assert [(x.a, x.b, x.o) for x in R.jaccard_pairs(s, 0.5, 4).collect()] == [(1, 2, 3)]


def test_gates(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "c int"), spark.createDataFrame([(1,)], "p int")
    assert rows(G.foreign_key(child, "c", parent, "p")) == [(2,)]
    assert rows(G.vocabulary(child, "c", [1])) == [(2,)]
    assert rows(G.iff(child, F.col("c") == 1, F.col("c") < 3)) == [(2,)]
    assert rows(G.implies(child, F.col("c") > 0, F.col("c") == 1)) == [(2,)]
    assert G.schema_drift(child, parent.schema) == ["p is missing", "c is not declared"]
    gates = G.Gates()
    gates.add("fk")(lambda s: G.foreign_key(child, "c", parent, "p"))
    gates.add("ok")(lambda s: child.limit(0))
    assert gates.errors(spark) == {"fk": 1}
    with pytest.raises(ValueError):
        gates.add("ok")(None)


def test_greedy_and_edit_pairs(spark):
    rnd = random.Random(8)
    pairs = sorted({(rnd.randrange(30), 100 + rnd.randrange(30)): rnd.randrange(6) for _ in range(150)}.items(), key=lambda x: (-x[1], x[0]))
    used, want = set(), set()
    for (a, b), s in pairs:
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b, s))
    df = spark.createDataFrame([(a, b, s, "x") for (a, b), s in pairs], "a int, b int, s int, l string")
    assert {tuple(r) for r in R.greedy_one_to_one(df, "a", "b", "s").collect()} == want
    assert R.greedy_one_to_one(df.limit(0), "a", "b", "s").count() == 0
    names = ["".join(rnd.choices("abc", k=rnd.randint(1, 9))) for _ in range(60)] + ["aaaaaaaaaa", "aaaaaaaaab", "amt fuer bauten", "amt fuer banten", ""]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    distinct = sorted(set(names))
    want = {(a, b, lev(a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if lev(a, b) <= 2}
    assert {tuple(r) for r in R.edit_pairs(spark.createDataFrame([(n,) for n in names + [None]], "name string"), 2).collect()} == want


def test_sample_and_terms(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(R, "SAMPLE_BLOCK", 7)
    df = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(300)], "s string, k long")
    got = R.first_in_hash_order(df, "s", "k", spark.createDataFrame([("a", 20), (None, 5)], "s string, k int"))
    order = sorted(range(300), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert {(r.s, r.k) for r in got.collect()} == {("a", i) for i in [i for i in order if i % 3][:20]} | {(None, i) for i in [i for i in order if not i % 3][:5]}
    docs = spark.createDataFrame([(1, "abcabd"), (2, ""), (3, None), (4, "xbc")], "doc_id long, text string")
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", "bc", "abd", "", None, "zz", "bc"])], "i int, term string")
    for at_once in (50_000, 2):
        assert rows(R.terms_in_texts(docs, terms, "i", at_once)) == [(0, 1), (1, 1), (1, 4), (2, 1), (6, 1), (6, 4)]
    assert R.terms_in_texts(docs, terms.limit(0), "i").count() == 0
