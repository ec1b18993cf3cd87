"""Problem 5 against union-find."""

import random

import pytest

from lotwerk.llm import components
from lotwerk.llm.components import connected_groups

ROW = "a long, b long, v string, m int"


def brute(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(v, find(v)) for v in up}


def run(spark, links):
    got = [tuple(r) for r in connected_groups(spark.createDataFrame([(a, b, "x", 1) for a, b in links], ROW)).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("most", [0, 200_000])
def test_random(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MAX_LOOKUP", most)
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(5, None), (None, None), (7, 7), (1000, 1000)]
    links += links[:40] + [(b, a) for a, b in links[:40]]
    assert run(spark, links) == brute(links)


def test_chain_star_and_cycle(spark):
    chain = [(i, i + 1) for i in range(0, 120)]
    random.Random(2).shuffle(chain)
    star = [(500, 500 + i) for i in range(1, 150)]
    ring = [(700 + i, 700 + (i + 1) % 50) for i in range(50)]
    zigzag = [(900 + i, 1100 - i) for i in range(60)] + [(1100 - i, 901 + i) for i in range(60)]
    assert run(spark, chain + star + ring + zigzag) == brute(chain + star + ring + zigzag)


def test_empty(spark):
    assert run(spark, []) == set()
