"""Queries of plans/more against plain Python."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from lotwerk.plans import more as M


def test_best_spelling(spark):
    rnd = random.Random(5)
    stems = ["".join(rnd.choices("abcde ", k=rnd.randint(1, 40))).strip() or "a" for _ in range(25)]
    names = []
    for _ in range(220):
        w = list(rnd.choice(stems))
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randint(0, 1)] = rnd.choice(["", "f", "ab"])
        names.append("".join(w))
    names += ["Betreibungs und Konkursamt Schaffhausen", "Betreibungsamt und Konkursamt Schaffhausen", "Bau (Amt)", "Bau", "Bau", None, ""]
    n = Counter(x for x in names if x)
    key = lambda x: " ".join(x.split(" (")[0].lower().split())
    want = {}
    for x in n:
        for y in n:
            if x != y and key(x) and key(y) and (r := SequenceMatcher(None, key(y), key(x)).ratio()) >= 0.88:
                want[x] = min(want.get(x, (0,)), (-r, -n[y], y))
    got = {r.name: (-r.ratio, -r.n, r.best) for r in M.best_spelling_of(spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    assert got == want and got["Betreibungsamt und Konkursamt Schaffhausen"][2] == "Betreibungs und Konkursamt Schaffhausen"


def test_letter_evidence(spark):
    rnd = random.Random(1)
    t = "".join(rnd.choices("abcdefghäöü", k=400))
    rows = [("ganz", t, "x" + t), ("mitte", t, t[60:200]), ("fremd", t, "q" * 900), ("kurz", "Bu\u0308ro, Straße 1", "das bürostrasse"), ("leer", "12 3", t), ("anfang", t, t[:-1]), ("knapp", t[:79], t[:45])]
    got = {r.id: tuple(r)[1:] for r in M.evidence(spark.createDataFrame(rows, "id string, excerpt string, other string"), ["id"]).collect()}
    want = {"ganz": (6, 6, True, True), "mitte": (6, 2, True, False), "fremd": (6, 0, False, False), "kurz": (1, 1, True, True), "anfang": (6, 5, True, False), "knapp": (1, 1, True, True)}
    assert got == want


def test_chains_of_any_length(spark):
    rows = [(f"a{i}", f"a{i + 1}") for i in range(200)] + [("a200", None)] + [("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("w", "weg"), (None, "a0"), ("a0", "a1")]
    got = {r.kennung: (r.stand, r.schritte, r.zyklus) for r in M.follow_chains(spark.createDataFrame(rows, "kennung string, abgeloest_durch string")).collect()}
    assert all(got[f"a{i}"] == ("a200", 200 - i, False) for i in range(201))
    assert {k for k, v in got.items() if v[2]} == {"x", "y", "z", "s"}
    assert got["w"] == ("weg", 1, False) and got[None] == ("a200", 201, False)


def test_pipeline():
    from lotwerk.operators.pipeline import Pipeline

    ran = []
    p = Pipeline()
    p.step("a")(lambda: ran.append("a"))
    p.step("b", ["a"])(lambda: ran.append("b"))
    p.step("c", ["a", "b"])(lambda: ran.append("c") or 3)
    for names in (["b"], ["a", "c"], ["b", "a"], ["x"]):
        with pytest.raises(ValueError):
            p.run(names)
    assert ran == []
    assert p.run(["c"], done=["a", "b"]) == {"c": 3} and p.run() == {"a": None, "b": None, "c": 3}
    with pytest.raises(ValueError):
        p.step("d", ["nie"])(print)
