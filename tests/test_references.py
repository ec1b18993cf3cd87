"""Problem 1 against plain Python."""

import datetime as dt
import random

import pytest

from lotwerk.operators import references as R

REF = "tabelle string, satz string, ziel_tabelle string, ziel_id long, ankunft timestamp_ntz, extra string"
TGT = "ziel_tabelle string, id long, ankunft timestamp_ntz, geloescht boolean, extra string"
T0 = dt.datetime(2026, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def brute(refs, tgts):
    recs, known = {}, {}
    for tab, satz, zt, zid, at, _ in refs:
        recs.setdefault((tab, satz), []).append((at, zt, zid))
    for zt, i, at, gone, _ in tgts:
        if i is not None:
            a, g = known.get((zt, i), (None, False))
            known[zt, i] = (at if a is None else min(a, at) if at else a, g or gone)
    out = set()
    for (tab, satz), rows in recs.items():
        first = min((r[0] for r in rows if r[0]), default=None)
        _, zt, zid = max(rows, key=lambda r: r[0] or dt.datetime.min)
        if zid is None:
            continue
        k = known.get((zt, zid))
        art = "fehlt" if k is None else "geloescht" if k[1] else "verspaetet" if k[0] and first and k[0] > first else None
        if art:
            out.add((tab, satz, zid, art, first and first.strftime("%Y-%m")))
    return out


@pytest.mark.parametrize("sent", [0, 1000])
def test_random(spark, monkeypatch, sent):
    monkeypatch.setattr(R, "MAX_SENT", sent)
    rnd = random.Random(3)
    tgts = [("e", i, day(rnd.randint(0, 40)), rnd.random() < 0.05, "x") for i in rnd.sample(range(-50, 9000), 2500)]
    tgts += [(z, i, day(rnd.randint(0, 60)), g, "y") for z, i, _, g, _ in rnd.sample(tgts, 200)]
    refs = []
    for n in range(3000):
        row = ("t", str(n), "e", 4242 if n % 3 == 0 else rnd.randint(-60, 9050) if n % 7 else None, day(rnd.randint(20, 60)), "z")
        refs.append(row)
        if n % 10 == 0:
            refs.append(row[:4] + (row[4] + dt.timedelta(days=3), "again"))
    got = R.faulty_references(spark.createDataFrame(refs, REF), spark.createDataFrame(tgts, TGT)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(refs, tgts)


def test_edges(spark):
    empty_t, empty_r = spark.createDataFrame([], TGT), spark.createDataFrame([], REF)
    one = spark.createDataFrame([("t", "1", None, 5, None, None), ("t", None, "e", 7, day(0), None), ("t", "2", "e", None, day(0), None)], REF)
    assert {tuple(r) for r in R.faulty_references(one, empty_t).collect()} == {("t", "1", 5, "fehlt", None), ("t", None, 7, "fehlt", "2026-01")}
    assert R.faulty_references(empty_r, empty_t).count() == 0
    # a run's edges and block borders
    size = 1 << R.BLOCK_BITS
    tgt = spark.createDataFrame([("e", i, day(0), False, "") for i in (size - 1, size, size + 1, -1, 2**40)], TGT)
    refs = spark.createDataFrame([("t", str(i), "e", i, day(1), "") for i in (size - 2, size - 1, size, size + 1, size + 2, -1, 0, 2**40, 2**40 + 1)], REF)
    assert {r.ziel_id for r in R.faulty_references(refs, tgt).collect()} == {size - 2, size + 2, 0, 2**40 + 1}
