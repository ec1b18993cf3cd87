"""Problem 2 against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lotwerk.operators import history as H

EV = "id long, kennung string, datum string, ereignis string, vorher string, nachher string, geladen_am string"
REG = "kennung string, seit string, schluessel string, geladen_am timestamp_ntz, status string"


def text(rnd, d):
    iso = f"2026-01-{d:02d}"
    return rnd.choice([iso, iso + "T08:15:00", f"{d:02d}.01.2026"])


def brute(events, registry):
    out = set()
    starts = {r[0]: r for r in registry}
    for k, (_, seit, key, _, _) in starts.items():
        mine = {}
        for i, kk, datum, e, v, n, _ in events:
            if kk == k and datum:
                day = datum[:10] if "." not in datum else f"{datum[6:]}-{datum[3:5]}-{datum[:2]}"
                ident = (day, e, v, n)
                mine[ident] = min(mine.get(ident, i), i)
        rows = sorted((day, i, e, v, n) for (day, e, v, n), i in mine.items())
        original = next((v for *_, v, _ in rows if v is not None), key)
        state, days = ("aktiv", original), {seit: ("aktiv", original)}
        for day, _, e, _, n in rows:
            s, kkey = state
            state = (s, n) if e == "umbenannt" else ({"entfallen": "entfallen", "abgeloest": "abgeloest", "reaktiviert": "aktiv"}.get(e, s), kkey)
            days[day] = state
        versions = []
        for day in sorted(days):
            if not versions or versions[-1][1] != days[day]:
                versions.append((day, days[day]))
        for (ab, (s, kk)), nxt in zip(versions, [*versions[1:], (H.FOREVER, None)]):
            out.add((k, ab, nxt[0], s, kk))
    return out


def sample(seed):
    rnd = random.Random(seed)
    registry = [(f"k{i}", "2026-01-01", None if i % 5 == 0 else f"s{i}", None, "aktiv") for i in range(25)]
    events = []
    for i in range(260):
        k = "k0" if rnd.random() < 0.4 else f"k{rnd.randint(0, 26)}"
        e = rnd.choice(["umbenannt"] * 3 + ["entfallen", "abgeloest", "reaktiviert"])
        n = rnd.choice(["a", "b", "c"]) if e == "umbenannt" else None
        events.append((i * 3, k, text(rnd, rnd.randint(2, 28)) if i % 50 else None, e, rnd.choice([None, "v", "w"]), n, "x"))
    events += [(1000 + i, *events[i * 5][1:]) for i in range(20)]
    return events, registry


@pytest.mark.parametrize("cursor", [-1, 100, 500, 10_000])
def test_any_cut_of_the_log(spark, cursor):
    events, registry = sample(5)
    got = H.identifier_history(spark.createDataFrame(events, EV), spark.createDataFrame(registry, REG), cursor).select(*H.CHAIN).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(events, registry)


def test_published_chains_are_replaced(spark):
    events, registry = sample(7)
    ev, reg = spark.createDataFrame(events, EV), spark.createDataFrame(registry, REG)
    starts = H.starts_of(reg)
    H.publish(H.build_chains(H.day_facts(ev.filter("id < 300")), starts), "test_chains")
    for low, high in ((300, 600), (600, 2000)):
        batch = ev.filter((F.col("id") >= low) & (F.col("id") < high))
        H.publish(H.rebuild_affected(H.published(spark, "test_chains"), batch, ev.filter(F.col("id") < high), starts), "test_chains")
    assert {tuple(r) for r in H.published(spark, "test_chains").select(*H.CHAIN).collect()} == brute(events, registry)


def test_edges(spark):
    none, regs = spark.createDataFrame([], EV), spark.createDataFrame([("k", "05.02.2026", None, None, "x"), (None, "2026-01-01", "s", None, "x")], REG)
    assert [tuple(r) for r in H.identifier_history(none, regs, 0).select(*H.CHAIN).collect()] == [("k", "2026-02-05", H.FOREVER, "aktiv", None)]
    assert H.identifier_history(none, spark.createDataFrame([], REG), 0).count() == 0
    at = spark.createDataFrame([("k", "2026-03-01", 1)], "kennung string, tag string, x int")
    assert H.versions_on(H.identifier_history(none, regs, 0), at).first().status == "aktiv"
