"""Problem 3: spellings with known meaning, and the distributed form."""

import itertools
import time

import pytest

from lotwerk.llm.mapping import Matcher, edits, map_names, normal, unmatched_input

CANON = [(1, "teil", "Familienname", '["Nachname"]'), (2, "teil", "Pflegestufe", None), (3, "teil", "Schulstufe", '["Stufe"]'), (4, "teil", "Gebäudeversicherungswert", None), (5, "teil", "Strasse und Hausnummer", None), (6, "beil", "Auszug aus dem Strafregister", None), (7, "beil", "Statuten", None)]
SYLLABLES = ["ba", "be", "bi", "di", "do", "fe", "fu", "ko", "la", "me"]
SAME = {
    "familienname": 1, "Famlienname": 1, "Familien- name": 1, "Famil ienname": 1, "Familienna…": 1, "2. Nachname": 1, "Angabe Nachname (falls vorhanden)": 1, "NACHNAME:": 1, "Fam1lienname": 1,
    "Pflege-stufe": 2, "Stufe": 3, "GebÃ¤udeversicherungswert": 4, "Geb?udeversicherungswert": 4, "Gebaeudeversicherungswert": 4, "StrasseUndHausnummer": 5, "und Hausnummer, Strasse": 5,
    "siehe oben": 0, "Quarzdrift": 0, "???": 0, "": 0, "  ": 0, "Mondphase 2": 0,
}


@pytest.fixture(scope="module")
def teil():
    return Matcher([(1, "Familienname"), (1, "Nachname"), (2, "Pflegestufe"), (3, "Schulstufe"), (3, "Stufe"), (4, "Gebäudeversicherungswert"), (5, "Strasse und Hausnummer")])


@pytest.mark.parametrize("typed,meant", SAME.items())
def test_meaning(teil, typed, meant):
    assert teil(typed) == meant


def test_longest_mention_wins():
    m = Matcher([(1, "Kopie"), (2, "Kopie Pass"), (3, "Pass")])
    assert m.mention("die kopie pass hier") == (9, 2)
    assert m.mention("die ko pie pa ss hier") == (9, 2) and m.mention("kopien passen") == (0, 0)
    assert Matcher([(1, "Pass"), (2, "Passfotos")])("pass fotoss") == 1  # an exact mention wins over a longer name misspelt


def test_sets_of_words():
    m = Matcher([(1, "Strasse und Hausnummer"), (2, "Telefon tagsüber"), (3, "Bewilligung der Eigentümerin"), (4, "Baupläne im Massstab 1:100"), (5, "Pass")])
    same = {"Hausnumer, Strasse": 1, "strasseundhausnumer": 1, "Strasse undd Haus nummer": 1, "tagsübr, Telefo": 2, "der Eigentümrin dieser Sache Bewillgung": 3, "Bewilligung": 3, "Bauplläne in Massstab 1:100": 4, "Eigentum der Stadt": 0, "Passt": 5, "Hast": 0}
    assert {v: m(v) for v in same} == same


def test_a_list_in_parts(spark, monkeypatch):
    from lotwerk.llm import mapping

    canon = [(i, "teil", f"{a}{b}{c}feld", None) for i, (a, b, c) in enumerate(itertools.product(SYLLABLES, repeat=3), 10)] + [(1, "teil", "Familienname", '["Nachname"]'), (2, "teil", "Name", None), (None, "teil", "x", None)]
    typed = ["Familenname", "Der Nachname", "Sein Name", "Familienname Name", "Quarzdrift", "bakobufeld", "dikofefeldt"]
    rows = spark.createDataFrame([(i, "teil", n) for i, n in enumerate(typed)], "id int, bereich string, name string")
    canon = spark.createDataFrame(canon, "kanon_id long, bereich string, bezeichnung string, auch string")
    whole = {r.id: r.kanon_id for r in map_names(rows, canon).collect()}
    assert [whole[i] for i in range(5)] == [1, 1, 2, 1, 0] and whole[5] > 9 and whole[6] > 9
    monkeypatch.setattr(mapping, "MAX_CANON", 200)
    assert {r.id: r.kanon_id for r in map_names(rows, canon).collect()} == whole


def test_a_long_list():
    m = Matcher([(i, "".join(x) + "wert") for i, x in enumerate(itertools.islice(itertools.product(SYLLABLES, repeat=6), 100_001))])
    began = time.time()
    assert m("bababababawert") == 0 and m("bababababadiwert") == m("Babababababiwert") + 1 and m("zzzzzz qqqqqq") == 0
    assert time.time() - began < 20


def test_edits():
    assert [edits("abcd", "abdc", 3), edits("abc", "abc", 0), edits("abc", "xyz", 2), edits("", "ab", 2), edits("p?b", "pub", 1)] == [1, 0, 3, 2, 0]
    assert normal("Straße  GRÖSSE") == normal("Strasse Groesse")


def test_rows(spark):
    canon = spark.createDataFrame(CANON, "kanon_id long, bereich string, bezeichnung string, auch string")
    rows = spark.createDataFrame([(i, "teil", n, "k", 1) for i, n in enumerate(SAME)] + [(90, "teil", None, "k", 1), (91, None, "Nachname", "k", 1), (92, "nie", "Nachname", "k", 1), (93, "teil", "x" * 50_000, "k", 1), (94, "teil", "Familienname", "k", 1), (95, "beil", "aus dem Strafregister, Auszug", "k", 1)], "id int, bereich string, name string, n string, kanon_id int")
    got = {r.id: r.kanon_id for r in map_names(rows, canon).collect()}
    assert [got[i] for i in range(len(SAME))] == list(SAME.values())
    assert [got[i] for i in range(90, 96)] == [0, 0, 0, 0, 1, 6]
    assert map_names(rows.limit(0), canon).count() == 0
    left = {r.id for r in unmatched_input(rows, canon).collect()}
    assert 94 not in left and 90 not in left and 0 in left and list(SAME).index("  ") not in left
    assert {r.kanon_id for r in map_names(rows, canon.limit(0)).collect()} == {0}
