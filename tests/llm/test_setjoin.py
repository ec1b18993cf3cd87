"""Problem 4 against all pairs."""

import random
from itertools import combinations

import pytest

from lotwerk.llm import setjoin as J
from lotwerk.operators import skew

ROW = "space string, id long, tok long, tokens string, y int"


def brute(sets, t, least):
    ok = {k: v for k, v in sets.items() if len(v) >= least}
    return {(a[0], a[1], b[1]) for a, b in combinations(sorted(ok), 2) if a[0] == b[0] and len(ok[a] & ok[b]) >= t * len(ok[a] | ok[b]) - 1e-9}


def families(seed, n=220, vocabulary=60):
    rnd = random.Random(seed)
    sets, base = {}, None
    for i in range(n):
        if i % 7 == 0:
            base = set(rnd.sample(range(vocabulary), rnd.randint(4, 14)))
        s = set(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            s.discard(rnd.choice(sorted(s))) if len(s) > 2 and rnd.random() < 0.5 else s.add(rnd.randrange(vocabulary))
        sets[rnd.choice("ab"), i] = s
    return sets


@pytest.mark.parametrize("seed,t,least,every,to", [(1, 0.6, 4, 2, 48), (2, 0.6, 4, 8, 7), (3, 0.8, 2, 3, 9), (4, 0.5, 1, 1, 48)])
def test_all_pairs(spark, monkeypatch, seed, t, least, every, to):
    monkeypatch.setattr(J, "PAIRS_TO", to)
    sets = families(seed)
    rows = [(sp, i, x, "clash", 0) for (sp, i), s in sets.items() for x in s]
    rows += rows[:50] + [("a", None, 1, "", 0), ("a", 9999, None, "", 0)]
    pairs, members = J.set_join(spark.createDataFrame(rows, ROW), t, least, every)
    classes = {}
    for r in members.collect():
        classes.setdefault((r.space, r.klasse), []).append(r.id)
    got = [(r.space, *sorted((x, y))) for r in pairs.collect() for x in classes[r.space, r.a] for y in classes[r.space, r.b]]
    got += [(sp, *c) for (sp, _), m in classes.items() for c in combinations(sorted(m), 2)]
    assert len(got) == len(set(got))
    assert set(got) == brute(sets, t, least)


@pytest.mark.parametrize("split", [None, 10])
def test_hot_crowd_and_empty(spark, monkeypatch, split):
    if split:  # one pivot, one key and one class beyond what a task may get
        monkeypatch.setattr(skew, "SPLIT_ROWS", split)
    # a third of the sets are variants of one, another third are copies
    core = set(range(12))
    sets = {("s", i): core - {i % 12} | {100 + i} for i in range(40)} | {("s", 100 + i): core for i in range(40)} | {("s", 200 + i): set(range(i * 20, i * 20 + 8)) for i in range(40)}
    pairs, members = J.set_join(spark.createDataFrame([(sp, i, x, "", 0) for (sp, i), s in sets.items() for x in s], ROW))
    copies = {r.id: r.klasse for r in members.collect()}
    assert {copies[100 + i] for i in range(40)} == {100}
    want = {p for p in brute(sets, 0.6, 4) if copies[p[1]] == p[1] and copies[p[2]] == p[2]}
    assert {(r.space, r.a, r.b) for r in pairs.collect()} == want
    none, nobody = J.set_join(spark.createDataFrame([], ROW))
    assert none.count() == nobody.count() == 0


def test_chance_meetings_are_not_shuffled(spark):
    """1,500 sets of nine tokens of 25: most pairs share tokens, few are similar, and only these leave the tasks."""
    rnd = random.Random(3)
    rows = spark.createDataFrame([("s", i, x, "", 0) for i in range(1500) for x in rnd.sample(range(25), 9)], ROW)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = store.executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = shuffled()
    J.set_join(rows, 0.6, 4)[0].count()
    assert shuffled() - before < 2e6
