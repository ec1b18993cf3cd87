"""Problem 8 against shingles."""

import os
import random

import pytest
from compare import FOLDER

from lotwerk.llm import leaks as L


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = L.words(t or "")
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t, *_ in docs:
        w = L.words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_words():
    assert L.words("Grüße, Äpfel-\n  baum 3.5_x Où?") == ["grueße", "aepfelbaum", "3", "5", "x", "où"]
    assert L.words("A-B\r\nC-\r\nD") == ["a", "b", "cd"]


@pytest.mark.parametrize("passage", [3, 6, 12])
def test_random(spark, passage):
    rnd = random.Random(passage)
    vocabulary = [f"w{i}" for i in range(40)] + ["der", "die"] * 20
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(2, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "der " * 30), (93, " ".join(f"u{i}" for i in range(20)))]
    docs = []
    for d in range(120):
        w = rnd.choices(vocabulary, k=rnd.randint(0, 60))
        if d % 3 == 0:
            src = (items[rnd.randrange(25)][1]).split()
            a = rnd.randrange(len(src))
            w[5:5] = src[a : a + rnd.randint(passage - 2, passage + 4)]
        if d % 10 == 0:
            w += ["der"] * 40
        docs.append((d, " ".join(w).upper() if d % 4 == 0 else ",\n".join(w), "clash"))
    docs += [(500, None, ""), (None, "der die", ""), (501, "", ""), (502, "der " * 3000, "")] + docs[:5]
    got = [(r.doc_id, r.item_id) for r in L.leaks(spark.createDataFrame(docs, "doc_id long, text string, term string"), spark.createDataFrame(items, "item_id long, text string"), passage).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, items, passage)


def test_longest_near_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x " + text + " y"), (2, " ".join(w if i % 7 else "neu" for i, w in enumerate(text.split())))], "doc_id long, text string")
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == [(1, 7, 30)]
    wanted = L.item_words(items)
    near = L.near_matches(L.build_index(docs, wanted.select("term")), wanted, rarest=30, least=20)
    assert {(r.doc_id, r.item_id) for r in near.collect()} == {(1, 7), (2, 7)}
    assert L.leaks(docs.limit(0), items).count() == 0
    assert L.leaks(docs, items.limit(0)).count() == 0


def test_index_without_vocabulary(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "eins zwei eins")], "doc_id long, text string")
    assert {(r.term, tuple(r.positions)) for r in L.build_index(docs).collect()} == {("eins", (0, 2)), ("zwei", (1,))}
    monkeypatch.setattr(L, "MAX_WORDS", 0)
    some = L.build_index(docs, spark.createDataFrame([("zwei",), ("drei",)], "term string"))
    assert [r.term for r in some.collect()] == ["zwei"]


def test_near_finds_parts(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(rnd.choices([f"w{i}x{k}" for k in range(60)] + [f"v{k}" for k in range(30)] + ["der", "die"] * 15, k=rnd.randint(40, 89)))) for i in range(30)]
    items.append((90, "der die " * 20))
    docs, changed = [], set()
    for d in range(240):
        i, text = items[d % len(items)]
        w = text.split()
        a = rnd.randrange(len(w) - 12)
        part = w[a : a + (12 if d % 2 else rnd.randint(12, 30))]
        if d % 3 == 0:  # a word changed in every 12
            part = [x if k % 12 != 5 else "neu" for k, x in enumerate(part)]
            changed.add((d, i))
        filler = rnd.choices([f"f{k}" for k in range(200)] + ["der", "die"] * 20, k=60)
        docs.append((d, " ".join(filler[:30] + part + filler[30:])))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    wanted = L.item_words(frames[1]).distinct()
    near = {(r.doc_id, r.item_id): r.n_terms for r in L.near_matches(L.build_index(frames[0], wanted.select("term")), wanted).collect()}
    assert brute(docs, items, 12) <= set(near)
    assert {(d, i) for d, i in changed if i != 90} <= set(near)
    assert all(6 <= n <= 8 for n in near.values())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_near_holds_found(spark):
    found, near = ({(r.doc_id, r.item_id) for r in L.QUERIES[q](spark, FOLDER).collect()} for q in ("p8_found", "p8_near"))
    assert found and found <= near
