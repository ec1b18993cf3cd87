"""Problem 9: shares, caps, positions."""

import pytest
from pyspark.sql import functions as F

from lotwerk.llm import mixing as M

COUNTS = "doc_id long, source string, tokens long, position string"
TARGETS = "source string, anteil double, max_wiederholung int"


def counts(spark):
    rows = [(i, "big", 50 + i % 37, "p") for i in range(2000)] + [(10_000 + i, "small", 30 + i % 11, "p") for i in range(60)] + [(20_000 + i, "unlisted", 10, "p") for i in range(9)]
    return spark.createDataFrame(rows, COUNTS)


def targets(spark):
    return spark.createDataFrame([("big", 0.7, 2), ("small", 0.2, 4), ("missing", 0.1, 3)], TARGETS)


def check(rows, by, repeats):
    seen = set()
    for r in rows:
        assert 1 <= r.kopie <= repeats[r.source] and 0 <= r.position <= 1
        assert (r.doc_id, r.kopie) not in seen
        seen.add((r.doc_id, r.kopie))
    # a second copy only where the first is
    assert all(k == 1 or (d, k - 1) in seen for d, k in seen)


@pytest.mark.parametrize("block", [16_384, 50])
def test_shares_and_caps(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    mixed = M.mix(counts(spark), targets(spark))
    rows = mixed.collect()
    check(rows, None, {"big": 2, "small": 4})
    whole = sum(r.tokens for r in rows)
    share = {s: sum(r.tokens for r in rows if r.source == s) / whole for s in ("big", "small")}
    assert share["big"] == pytest.approx(0.7 / 0.9, abs=0.002) and share["small"] == pytest.approx(0.2 / 0.9, abs=0.002)
    # the scarcer source is used up
    small = sum(r.tokens for r in rows if r.source == "small")
    assert small == pytest.approx(4 * sum(30 + i % 11 for i in range(60)), rel=0.01)
    order = [r.position for r in rows]
    assert order == sorted(order)


def test_schedule(spark):
    schedule = {"big": [(0.0, 1.0), (0.5, 1.0), (1.0, 0.0)], "small": [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0)]}
    rows = M.mix(counts(spark), targets(spark), schedule=schedule).collect()
    small = sorted(r.position for r in rows if r.source == "small")
    assert small[0] >= 0.5
    # weight rises from nothing, so half of the demand is due at 0.5 + 0.5 * sqrt(0.5)
    assert small[len(small) // 2] == pytest.approx(0.5 + 0.5 * 0.5**0.5, abs=0.02)
    flat = M.mix(counts(spark), targets(spark), schedule={"big": [(0, 1), (1, 1)], "small": [(0, 2), (1, 2)]})
    assert flat.filter("source = 'big'").agg(F.avg("position")).first()[0] == pytest.approx(0.5, abs=0.01)


def test_any_number_of_sources(spark, monkeypatch):
    want = {(r.position, r.doc_id, r.kopie) for r in M.mix(counts(spark), targets(spark)).collect()}
    monkeypatch.setattr(M, "MAX_SOURCES", 0)
    assert {(r.position, r.doc_id, r.kopie) for r in M.mix(counts(spark), targets(spark)).collect()} == want


def test_total_and_empty(spark):
    rows = M.mix(counts(spark), targets(spark), total=10**9).collect()
    assert max(r.kopie for r in rows if r.source == "big") == 2
    check(rows, None, {"big": 2, "small": 4})
    assert M.mix(counts(spark).limit(0), targets(spark)).count() == 0
    assert M.mix(counts(spark), targets(spark).limit(0)).count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a", "Hello world <|endoftext|>", 1), (1, "a", "Hello world <|endoftext|>", 1), (2, "a", "", 1), (3, "a", None, 1), (4, None, "x", 1), (5, "b", "ab " * 20_000, 1)], "doc_id long, source string, text string, tokens int")
    got = {r.doc_id: r.tokens for r in M.token_counts(docs).collect()}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(f"{M.TOKENIZERS}/{M.TOKENIZER}")
    tok.encode_special_tokens = True
    assert got == {1: len(tok.encode("Hello world <|endoftext|>").ids), 5: len(tok.encode("ab " * 20_000).ids)}
