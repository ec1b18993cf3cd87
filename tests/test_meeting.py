"""Similar pairs of sets against all pairs, also when groups are split and looked at in small pieces."""

import random
from itertools import combinations

import pytest

from lotwerk.operators import meeting as M
from lotwerk.operators import relational as R
from lotwerk.plans import joins, more


def made(seed, n=160):
    rnd = random.Random(seed)
    sets, base = {}, []
    for i in range(n):
        if i % 6 == 0:
            base = rnd.sample(range(90), rnd.randint(2, 15))
        s = set(base) - {rnd.choice(base)} | {rnd.randrange(90) for _ in range(rnd.choice([0, 1, 3]))} if rnd.random() < 0.7 else set(base)
        sets[i] = s | ({1000, 1001} if i % 2 else set())  # tokens of half of all sets
    return sets


def brute(sets, sim, least):
    ok = {i: s for i, s in sets.items() if len(s) >= least}
    pairs = {(a, b): (len(ok[a] & ok[b]), len(ok[a] & ok[b]) / len(ok[a] | ok[b])) for a, b in combinations(sorted(ok), 2)}
    return {k: v for k, v in pairs.items() if v[1] >= sim - 1e-9}


CASES = pytest.mark.parametrize("seed,sim,least,small", [(1, 0.35, 4, False), (2, 0.35, 4, True), (3, 0.7, 2, True), (4, 0.2, 1, True)])


def frame(spark, sets):
    return spark.createDataFrame([(i, f"t{x}") for i, s in sets.items() for x in s] + [(3, None), (None, "t1")], "id int, token string")


def shrink(monkeypatch):
    """Every frequent token is dealt to groups, tables and pieces are tiny, most tokens are unknown."""
    for name, value in (("GROUP_ROWS", 7), ("AT_ONCE", 20), ("PAIRS_AT_ONCE", 11), ("CELLS_AT_ONCE", 300), ("FREQUENT", 20)):
        monkeypatch.setattr(M, name, value)


def shuffled(spark):
    """Bytes of shuffles that this session has written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@CASES
def test_pairs(spark, monkeypatch, seed, sim, least, small):
    if small:
        shrink(monkeypatch)
    df = frame(spark, made(seed))
    got = [((r.a, r.b), (r.o, r.jaccard)) for r in R.jaccard_pairs(df, sim, least).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(made(seed), sim, least)
    assert R.jaccard_pairs(df.limit(0), sim, least).count() == 0


def test_chance_meetings_are_not_shuffled(spark):
    """3,000 sets of six tokens of 30: nearly all pairs share a token, few are similar, and only these are shuffled."""
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, f"t{x}") for i in range(3000) for x in rnd.sample(range(30), 6)], "id int, token string")
    before = shuffled(spark)
    assert R.jaccard_pairs(df, 0.7, 4).count() > 1000
    assert shuffled(spark) - before < 2e6


@CASES
def test_best(spark, monkeypatch, seed, sim, least, small):
    if small:
        shrink(monkeypatch)
    best = {}
    for (a, b), (_, j) in brute(made(seed), sim, least).items():
        for x, y in ((a, b), (b, a)):
            best[x] = min(best.get(x, (0, 0)), (-j, y))
    got = R.best_partners(frame(spark, made(seed)), sim, least)
    assert {(r.id, r.partner, r.jaccard) for r in got.collect()} == {(x, y, -j) for x, (j, y) in best.items()}


def copies(spark, folder):
    """2,000 forms with the same four names, a million pairs, none judged but one."""
    at = "timestamp '2025-01-01'"
    spark.range(2000).selectExpr("id form_id", "explode(array('A', 'B', 'C', 'D')) name", f"if(id < 0, {at}, null) geloescht_am").write.parquet(f"{folder}/data_field.parquet")
    spark.createDataFrame([(7, 3, " Gleich")], "form_a long, form_b long, verdict string").write.parquet(f"{folder}/form_similarity.parquet")
    return str(folder)


def test_best_of_copies_without_their_pairs(spark, tmp_path):
    folder, before = copies(spark, tmp_path), shuffled(spark)
    best = {r.id: (r.partner, r.jaccard) for r in joins.best_match(spark, folder).collect()}
    assert best == {i: (0 if i else 1, 1.0) for i in range(2000)}
    assert shuffled(spark) - before < 1e6


@CASES
def test_greedy(spark, monkeypatch, seed, sim, least, small):
    if small:
        shrink(monkeypatch)
    left, right, taken = set(), set(), set()
    for (a, b), (_, j) in sorted(brute(made(seed), sim, least).items(), key=lambda x: (-x[1][1], x[0])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            taken.add((a, b, j))
    assert {tuple(r) for r in R.greedy_sets(frame(spark, made(seed)), sim, least).collect()} == taken


def test_greedy_of_copies_without_their_pairs(spark, tmp_path):
    folder, before = copies(spark, tmp_path), shuffled(spark)
    assert {(r.a, r.b) for r in more.greedy_match(spark, folder).collect()} == {(i, i + 1) for i in range(1999)}
    assert shuffled(spark) - before < 1e6


def test_carry_over_of_chance_meetings(spark, tmp_path):
    """2,000 forms of six names of 60: many share names, few are similar, one pair is judged."""
    rnd, folder = random.Random(9), str(tmp_path)
    sets = {i: set(rnd.sample(range(60), 6)) for i in range(2000)}
    want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.35 * len(sets[a] | sets[b])}
    judged = min(want)
    fields = spark.createDataFrame([(i, f" N{x} ") for i, s in sets.items() for x in s], "form_id long, name string")
    fields.selectExpr("*", "cast(null as timestamp) geloescht_am").write.parquet(f"{folder}/data_field.parquet")
    spark.createDataFrame([(judged[1], judged[0], " Gleich")], "form_a long, form_b long, verdict string").write.parquet(f"{folder}/form_similarity.parquet")
    before = shuffled(spark)
    got = {(r.a, r.b): (r.verdict, r.behalten) for r in more.carry_over(spark, folder).collect()}
    assert got == {p: ("gleich", True) if p == judged else (None, False) for p in want}
    assert shuffled(spark) - before < 2e6


@CASES
def test_pairs_with_known(spark, monkeypatch, seed, sim, least, small):
    if small:
        shrink(monkeypatch)
        monkeypatch.setattr(R, "COPIES", 3)
        monkeypatch.setattr(R, "BLOCK", 2)
    sets = made(seed)
    sets |= {1000 + i: set(sets[i % 12]) for i in range(90)}  # classes of several
    want, rnd = sorted(brute(sets, sim, least)), random.Random(seed)
    known = {p: f"v{i}" for i, p in enumerate(rnd.sample(want, len(want) // 3) + [(0, 5000), (5000, 5001), (-1, 0)])}
    known |= {p: "far" for p in rnd.sample(list(combinations(sorted(sets), 2)), 200) if p not in known}
    df = spark.createDataFrame([(*p, v) for p, v in known.items()], "a int, b int, v string")
    got = [tuple(r) for r in R.jaccard_pairs_with(frame(spark, sets), sim, least, df).collect()]
    assert sorted(got, key=lambda r: r[:2]) == [(*p, known.get(p)) for p in want]
    assert {r[2] for r in R.jaccard_pairs_with(frame(spark, sets), sim, least, df.limit(0)).collect()} == {None}


def test_carry_over_of_copies_without_their_pairs(spark, tmp_path):
    """As with more verdicts than can be broadcast."""
    folder, before, key = copies(spark, tmp_path), shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = more.carry_over(spark, folder).selectExpr("count(*)", "sum(int(a < b))", "count(verdict)", "max(if(behalten, struct(a, b, verdict), null))").first()
    finally:
        spark.conf.set(key, kept)
    assert tuple(got) == (1999 * 1000, 1999 * 1000, 1, (3, 7, "gleich"))
    assert shuffled(spark) - before < 1e6
