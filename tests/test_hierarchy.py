"""Problem 6 against plain Python, the distributed ways forced."""

import random

import pytest
from pyspark.sql import functions as F

from lotwerk.operators import hierarchy as H

ROW = "id long, parent_id long, day string, v string, enter long"


def brute(parents):
    up = {v: p if p in parents else None for v, p in parents.items()}
    kids = {}
    for v, p in up.items():
        kids.setdefault(p, []).append(v)
    out = set()
    for v in up:
        trail, x = [], v
        while x is not None and x not in trail:
            trail.append(x)
            x = up[x]
        seen, todo = set(), [v]
        while todo:
            for k in kids.get(todo.pop(), ()):
                if k not in seen and k != v:
                    seen.add(k)
                    todo.append(k)
        if x is None:
            out.add((v, "baum", trail[-1], len(trail) - 1, "/".join(map(str, reversed(trail))), len(seen)))
        else:
            ring = trail[trail.index(x) :]
            out.add((v, "zyklus" if v in ring else "unter_zyklus", min(ring), -1, "", len(seen)))
    return out


def forest(n, seed):
    rnd = random.Random(seed)
    ids = rnd.sample(range(1, n * 3), n)
    parents = {}
    for i, v in enumerate(ids):
        r = rnd.random()
        parents[v] = None if r < 0.02 or i == 0 else 10**9 + i if r < 0.04 else ids[0] if r < 0.35 else ids[i - 1] if r < 0.8 else rnd.choice(ids[:i])
    for _ in range(4):  # cycles, one a loop
        a = rnd.choice(ids)
        b, hops = a, 0
        while parents.get(b) in parents and hops < 5:
            b, hops = parents[b], hops + 1
        parents[b] = a
    parents[ids[7]] = ids[7]
    return parents


@pytest.mark.parametrize("tuning", [{"local_rows": 0, "least_peeled": 1.0, "split": 3, "chunk": 16}, {"least_peeled": 0.0}, {}])
def test_random(spark, tuning):
    parents = forest(400, 2)
    rows = [(v, p, "2026-01-02", "x", 1) for v, p in parents.items()]
    rows += [(v, None, "2026-01-01", "y", 2) for v in list(parents)[::5]] + rows[:30] + [(None, 3, "2026-01-01", "z", 1)]
    got = H.hierarchy(spark.createDataFrame(rows, ROW), "id", "parent_id", F.col("day"), **tuning).collect()
    assert len(got) == len(parents)
    assert {tuple(r) for r in got} == brute(parents)


def test_deep_chain_and_long_cycle(spark):
    parents = {i: i - 1 if i > 1 else None for i in range(1, 600)} | {1000 + i: 1000 + (i + 1) % 300 for i in range(300)}
    rows = [(v, p, "2026-01-02", "x", 1) for v, p in parents.items()]
    got = H.hierarchy(spark.createDataFrame(rows, ROW), "id", "parent_id", F.col("day"), local_rows=0, split=4)
    assert {tuple(r) for r in got.collect()} == brute(parents)


def test_depth_of_ten_thousand(spark):
    n = 10_000
    rows = [(i, i - 1 if i > 1 else None, "2026-01-02", "x", 1) for i in range(1, n + 1)]
    got = H.hierarchy(spark.createDataFrame(rows, ROW), "id", "parent_id", F.col("day"))
    whole = got.select("id", "tiefe", "n_nachfahren", "wurzel", F.length("pfad").alias("l"), F.expr("size(split(pfad, '/'))").alias("parts")).collect()
    assert all((r.tiefe, r.n_nachfahren, r.wurzel, r.parts) == (r.id - 1, n - r.id, 1, r.id) for r in whole) and len(whole) == n
    assert max(r.l for r in whole) == len("/".join(map(str, range(1, n + 1))))


def test_a_list_without_end_is_told(spark):
    items = spark.createDataFrame([(i, (i + 1) % 40, 1, 1) for i in range(40)], "e long, nxt long, n long, w long")
    with pytest.raises(Exception, match="does not end"):
        H.rank_list(items, local_rows=0, split=4).collect()


def test_empty_and_ties(spark):
    assert H.hierarchy(spark.createDataFrame([], ROW), "id", "parent_id", F.col("day")).count() == 0
    rows = [(1, None, "d", "", 0), (2, 1, "d", "", 0), (3, 2, "d", "", 0), (3, 1, "d", "", 0), (3, None, "d", "", 0)]
    got = {r.id: r.pfad for r in H.hierarchy(spark.createDataFrame(rows, ROW), "id", "parent_id", F.col("day")).collect()}
    assert got == {1: "1", 2: "1/2", 3: "1/3"}
