"""Problem 10: endings with a known verdict."""

from lotwerk.llm.truncation import judged, length_spikes, not_quoted

WHOLE = [
    "Das Gesuch ist einzureichen.", "Wer prüft das?", "Er sagte: «Ja.»", "Beilagen:\n- Ausweis\n- Plan der Anlage", "Text.\n\n| Feld | Wert |\n| a | 3 |", "Satz.\n\nKontakt: Das Amt, Weg 3, Ort",
    "Satz.\n\nFreundliche Grüsse\nDas Amt", "Satz. (Schluss)", "Satz. Ende", "Satz.\n\nSeite 3 von 6", "Satz.\n\nOrtsau, 1.2.2024", "Satz.\n\n» Zurück zur Übersicht", "Satz.\n---", "Satz.\n[x] Ja\n[ ] Nein",
    "Das sind Belege usw.", "Stand ist Nummer 90.00.", "Satz!  \n", "Satz. </p>", "Satz …fertig.",
]
CUT = [
    "Das Gesuch ist einzu", "Das Gesuch ist einzureichen. Die Geb", "Erster Satz.\nDer zweite wird", "Das Amt prüft die …", "Das Amt prüft die Ang...", "Das Amt prüft [...]", "Das Amt prüft die (mehr)",
    "Das Amt prüft die An</p>", "Das Amt prüft die An\xa0 ", "Die Frist nach Art.", "Sie endet am 20.12.", "Es gilt, sofern;", "Satz.\nTitel: Er lief. Dann ging", "Das Amt prüft … </p>\n",
]


def run(spark, rows):
    return judged(spark.createDataFrame(rows, "doc_id long, source string, text string, cut string, s int"))


def test_endings(spark):
    rows = [(i, "q", t, "clash", 1) for i, t in enumerate(WHOLE + CUT)]
    got = {r.doc_id: r.cut for r in run(spark, rows).collect()}
    assert [t for i, t in enumerate(WHOLE) if got[i]] == []
    assert [t for i, t in enumerate(CUT) if not got[len(WHOLE) + i]] == []


def test_spikes(spark):
    rows = []
    for i in range(40):  # lengths without a spike, of the shape of notes
        rows.append((i, "a", "Satz." + "x" * i * 3 + ".\n\nKontakt: Das Amt", "", 0))
    for i in range(12):  # a limit of 100 characters that cuts notes, too
        rows.append((100 + i, "a", ("Satz " + "y" * i + ". " + "z" * 200)[:70] + ".\n\nKontakt: " + "Das Bauamt am Weg" + "klmnopqrstuv"[i] * 30, "", 0))
    rows = [(d, s, t[:100] if d >= 100 else t, c, x) for d, s, t, c, x in rows]
    for i in range(12):  # 64 bytes at most in another source, characters uneven
        rows.append((200 + i, "b", ("ä" * i + "q" * 20 + ".\n\nOrt: " + "klmnopqrstuv"[i] * 90).encode()[:64].decode(errors="ignore"), "", 0))
    got = {r.doc_id: r.cut for r in run(spark, rows).collect()}
    assert not any(got[i] for i in range(40))
    assert all(got[100 + i] for i in range(12)) and all(got[200 + i] for i in range(12))


def test_edges(spark):
    rows = [(1, None, None, "", 0), (2, None, "", "", 0), (3, None, " \n ", "", 0), (4, None, "Nur ein Wort", "", 0), (4, None, "Nur ein Wort", "", 0), (5, "q", "a" * 300_000, "", 0), (None, "q", "Satz.", "", 0)]
    assert sorted((r.doc_id or 0, r.cut) for r in run(spark, rows).collect()) == [(0, False), (4, True), (4, True), (5, True)]
    assert run(spark, rows[:0]).count() == 0


def test_quotations(spark):
    quote = spark.createDataFrame([("Laut Vermerk 9 hat Olk die Auf-\nlage nie erfüllt.",), (None,), ("kurz",)], "text string")
    rows = [(1, "q", "Satz. Laut vermerk 9 HAT olk", "", 0), (2, "q", "Satz. Laut Vermerk 9 hat Ol", "", 0), (3, "q", "Satz. olk die Auflage nie", "", 0), (4, "q", "Satz. Laut Vermerk 9 hat Olk …", "", 0), (5, "q", "Satz. die Auf-\n lage nie erfu\u0308llt", "", 0), (6, "q", "die auflage nie erfuellt", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, cut string, s int")
    assert {r.doc_id: r.cut for r in not_quoted(judged(df), quote).collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_number_cut_at_a_spike(spark):
    rows = [(i, "a", "Tel. 052 632 71 10\nSatz." + "x" * i * 3 + ".\n\nTel. 052 632 71 1" + str(i % 10), "", 0) for i in range(40)]  # whole numbers, lengths without a spike
    for i in range(12):  # a limit of 100 characters, the number whole or cut
        note = "\n\nTel. 052 632 71 " + str(10 + i) if i < 6 else "\n\nTel. 052 632 7"
        rows.append((100 + i, "a", ("Satz " + "y" * i + ". " + "z" * 200)[: 99 - len(note)] + "." + note, "", 0))
    got = {r.doc_id: r.cut for r in run(spark, rows).collect()}
    assert not any(got[i] for i in [*range(40), *range(100, 106)])
    assert all(got[i] for i in range(106, 112))


def test_spike_and_mark_win(spark):
    quote = spark.createDataFrame([("Laut Vermerk 9 hat Olk die Auflage nie erfüllt.",)], "text string")
    rows = [(i, "a", "Satz." + "x" * i * 3 + ".", "", 0) for i in range(40)]
    for i in range(12):  # a limit of 100 characters, at a word's end in a quotation or after parentheses
        tail = ". Laut Vermerk 9 hat Olk" if i % 2 else ". Dies gilt (vgl. Ziff. 4)"
        rows.append((100 + i, "a", "Satz " + "y" * (95 - len(tail)) + tail, "", 0))
    rows += [(200, "b", "Das gilt hier (vgl. Ziff. 4) …", "", 0), (201, "b", "Das gilt hier. (vgl. Ziff. 4)", "", 0), (202, "b", "Das gilt hier. (Schluss)", "", 0), (203, "b", "Das gilt hier (vgl. Ziff. 4)", "", 0)]
    got = {r.doc_id: r.cut for r in not_quoted(run(spark, rows), quote).collect()}
    assert all(got[100 + i] for i in range(12))
    assert [got[i] for i in range(200, 204)] == [True, False, False, True]


def test_long_lines(spark):
    item = "- " + "Angabe zum Vorhaben und zur Lage " * 9  # a complete list item of 292 letters and more
    open_ = "Das Amt prüft " + "die Lage und " * 30
    rows = [(1, "q", "Satz.\n" + item.strip(), "", 0), (2, "q", open_ + "Hinweis: " + "n" * 191, "", 0), (3, "q", open_ + "xHinweis: " + "n" * 191, "", 0), (4, "q", "Satz.\n- kurz", "", 0)]
    assert {r.doc_id: r.cut for r in run(spark, rows).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_the_size_of_the_corpus_changes_no_verdict(spark):
    few = [(i, "q", t, "", 0) for i, t in enumerate(WHOLE + CUT)]
    many = few + [(1000 + i, "r", f"Der Satz {i} steht hier.\nEr ist zu Ende.", "", 0) for i in range(3000)]
    a, b = ({r.doc_id: r.weg for r in run(spark, rows).collect() if r.doc_id < 1000} for rows in (few, many))
    assert a == b


def test_length_spikes(spark):
    rows = [(i, "a", "t", 10 + 7 * i, 10 + 7 * i) for i in range(60)] + [(100 + i, "a", "t", 250, 250 + i) for i in range(9)] + [(200 + i, "a", "u", 90 + i, 300 - (i % 8 == 0)) for i in range(24)] + [(300 + i, None, "t", 77, 80) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, source string, spalte string, chars long, bytes long")
    got = {r.id: r.grenze for r in length_spikes(df).collect()}
    assert all(got[100 + i] == "zeichen" for i in range(9)) and all(got[200 + i] == "bytes" for i in range(24)) and all(got[300 + i] == "zeichen" for i in range(5))
    assert not any(got[i] for i in range(60) if 10 + 7 * i not in (250, *range(297, 301)))


def test_long_last_lines(spark):
    rows = [(1, "q", "Satz.\n- " + "wort " * 60 + "ende", "", 0), (2, "q", "Satz.\nDer " + "wort " * 60 + "- " + "wort " * 39 + "wort", "", 0), (3, "q", "Satz.\nDer " + "x" * 60 + " - " + "w" * 198, "", 0)]
    assert {r.doc_id: r.cut for r in run(spark, rows).collect()} == {1: False, 2: True, 3: True}
