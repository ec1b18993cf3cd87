"""Problem 7 on a small fixture."""

import datetime as dt

from lotwerk.operators import snapshots as N

ROW = "quelle string, abzug string, schluessel string, gelesen_am timestamp_ntz, title string, unterlagen string, art string, marks int"
T = dt.datetime(2026, 1, 1)


def rows(spark, data):
    return spark.createDataFrame([(q, a, k, T + dt.timedelta(hours=h), t, u, "x", 1) for q, a, k, h, t, u in data], ROW)


def test_changes(spark):
    data = [
        ("A", "1", "same", 0, "t", '[{"a": 1, "b": "\\u00fc"}]'), ("A", "2", "same", 9, "t", '[{"b":"ü","a":1}]'),
        ("A", "1", "order", 0, "t", "[1, 2]"), ("A", "2", "order", 0, "t", "[2, 1]"),
        ("A", "1", "gone", 0, "t", None), ("A", "2", "new", 0, "t", None),
        ("A", "1", "null", 0, None, None), ("A", "2", "null", 0, "", None),
        ("A", "1", "text", 0, "t", "{kaputt"), ("A", "2", "text", 0, "t", "{kaputt"),
        ("A", "1", "reread", 0, "a", None), ("A", "1", "reread", 5, "b", None), ("A", "2", "reread", 0, "b", None), ("A", "2", "reread", 0, "b", None),
        ("A", "1", None, 0, "t", None), ("A", "2", None, 0, "u", None), ("B", "1", "x", 0, "t", None),
    ]
    pairs = spark.createDataFrame([("A", "2", "1")], "quelle string, abzug string, vorher string")
    got = N.snapshot_changes(rows(spark, data), pairs, ["title", "unterlagen"])
    assert {(r.schluessel, r.art, tuple(r.felder or ())) for r in got.collect()} == {
        ("order", "geaendert", ("unterlagen",)), ("gone", "entfernt", ()), ("new", "neu", ()), ("null", "geaendert", ("title",)), (None, "geaendert", ("title",)),
    }


def test_open_pairs_and_empty(spark):
    h = spark.createDataFrame([("A", "1"), ("A", "2"), ("A", "2"), ("A", "3"), ("B", "1"), ("A", None)], "quelle string, datum string")
    log = spark.createDataFrame([("A", "2")], "quelle string, abzug string")
    pairs = N.open_pairs(h, log)
    assert [tuple(r) for r in pairs.collect()] == [("A", "3", "2")]
    assert N.snapshot_changes(rows(spark, []), pairs, ["title"]).count() == 0
    gone = N.snapshot_changes(rows(spark, [("A", "2", "k", 0, "t", None)]), pairs, ["title"]).collect()
    assert [(r.schluessel, r.art) for r in gone] == [("k", "entfernt")]


def test_fingerprint_takes_all_columns(spark):
    pairs = spark.createDataFrame([("A", "2", "1")], "quelle string, abzug string, vorher string")
    data = [("A", "1", "k", 0, None, "t"), ("A", "2", "k", 0, "t", None)]
    assert N.snapshot_changes(rows(spark, data), pairs, ["title", "unterlagen"]).first().felder == ["title", "unterlagen"]
