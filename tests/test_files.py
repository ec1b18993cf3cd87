"""Sources, sinks, scalar functions and streams."""

import datetime as dt
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lotwerk.functions import scalars as S
from lotwerk.sources import files, sinks, versions
from lotwerk.streaming import streams


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return path


def one(spark, expr, value="x"):
    return spark.createDataFrame([(value,)], "c string").select(expr.alias("v")).first().v


def test_json_inputs(spark, tmp_path):
    write(tmp_path / "a.json", '{"form_id": 1, "items": [{"n": "x"}]}')
    write(tmp_path / "b.json", "{kaputt")
    got = {r.file: (r.form_id, r.corrupt is None) for r in files.json_folder(spark, str(tmp_path), "form_id int, items array<struct<n:string>>").collect()}
    assert got == {"a.json": (1, True), "b.json": (None, False)}
    docs = spark.createDataFrame([('{"urteile": [{"id": 1}, {"id": 2}]}',), ('[{"id": 3}]',), ("nichts",), (None,)], "t string")
    assert sorted(r.item.id for r in files.json_items(docs, "t", "urteile", "struct<id:int>").collect()) == [1, 2, 3]


def test_xsd_html_text_and_law(spark, tmp_path):
    write(tmp_path / "eCH-0044-4-1.xsd", '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" version="4.1"><xs:element name="person"/><xs:simpleType name="sex"><xs:restriction base="xs:string"><xs:enumeration value="1"/></xs:restriction></xs:simpleType>'
          '<xs:complexType name="T"><xs:sequence><xs:element name="k"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="A"/></xs:restriction></xs:simpleType></xs:element></xs:sequence></xs:complexType></xs:schema>')  # fmt: skip
    write(tmp_path / "bad.xsd", "<xs:schema")
    got = {tuple(r) for r in files.xsd_catalogue(spark, str(tmp_path)).collect()}
    assert got == {("eCH-0044-4-1.xsd", "4.1", "element", None, "person"), ("eCH-0044-4-1.xsd", "4.1", "element", None, "k"), ("eCH-0044-4-1.xsd", "4.1", "value", "sex", "1"), ("eCH-0044-4-1.xsd", "4.1", "value", "@T.k", "A"), ("bad.xsd", None, "unreadable", None, None)}
    names = spark.createDataFrame([("eCH-0044-4-1.xsd",), ("eCH-0044-3-9.xsd",), ("eCH-0011-2-8-1.xsd",), ("eCH-0011-1-8-1.xsd",), ("x.xsd",)], "file string")
    assert {tuple(r) for r in files.main_schema_files(names).collect()} == {("eCH-0044", "eCH-0044-4-1.xsd"), ("eCH-0011", "eCH-0011-1-8-1.xsd")}
    page = spark.createDataFrame([(1, '<h1>T &amp; U</h1><script>x<y</script><h2>Eins</h2><p>a&nbsp;b</p><h2>Zwei</h2><a href="/z">c</a>')], "id int, html string")
    r = files.html_sections(page).first()
    assert (r.title, [tuple(x) for x in r.sections], r.links) == ("T & U", [("Eins", "a b"), ("Zwei", "c")], ["/z"])
    folder = tmp_path / "snap"
    folder.mkdir()
    write(folder / "s.txt", f"url: https://a.example\ntitel: Register\nsha256: {hashlib.sha256(b'Inhalt').hexdigest()}\n---\nInhalt")
    r = files.text_snapshots(spark, str(folder)).first()
    assert (r.url, r.titel, r.art, r.text, r.intact) == ("https://a.example", "Register", None, "Inhalt", True)
    lines = ["Kopf", "Art. 1", "Zweck", "Dies gilt.", "17", "Art. 2a", "Der Satz endet.", "Ende."]
    law = spark.createDataFrame([("l", i, t) for i, t in enumerate(lines)], "law string, line_no int, text string")
    assert {(r.article, r.heading) for r in files.law_articles(law).collect()} == {("1", "Zweck"), ("2a", None)}
    kinds = {r.file: r.art for r in files.file_inventory(spark, str(tmp_path), [(r"\.xsd$", "schema")]).collect()}
    assert kinds == {"eCH-0044-4-1.xsd": "schema", "bad.xsd": "schema", "s.txt": "sonstiges"}


def test_office_packages(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Titel"/></w:pPr><w:r><w:t>Ge</w:t></w:r><w:r><w:t>such</w:t></w:r></w:p><w:p/></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {x}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {x}><sheetData><row><c r="A1" t="s" s="3"><v>0</v></c><c r="B1"><v>7</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "c.docx").write_bytes(b"kein zip")
    got = {(r.file, r.place, r.style, r.text) for r in files.office_texts(spark, str(tmp_path)).collect()}
    assert got == {("a.docx", "0", "Titel", "Gesuch"), ("a.docx", "1", None, ""), ("b.xlsx", "A1", "3", "Name"), ("b.xlsx", "B1", None, "7"), ("b.xlsx", "C1", None, "in"), ("c.docx", None, None, None)}


def test_publish(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    with pytest.raises(sinks.GateError):
        sinks.publish(df, path, {"never": df})
    assert not os.path.exists(tmp_path / "t")
    assert sinks.publish(df, path, {"ok": df.limit(0)})
    assert not sinks.publish(df.orderBy(F.desc("k")), path)
    assert sinks.publish(df.union(df), path) and versions.published(spark, path).count() == 4
    assert os.listdir(tmp_path) == ["t"]
    df.withColumn("tag", F.lit("2026-01-01")).union(df.withColumn("tag", F.lit("2026-02-01")).limit(1)).write.partitionBy("tag").parquet(f"{path}2")
    assert files.dated_versions(spark, f"{path}2").count() == 1 and files.dated_versions(spark, f"{path}2", "2026-01-15").count() == 2


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(i, f"a{i}", i % 3) for i in range(50)], "k long, v string, x int")
    versions.publish(df, path, "k", 8)
    old = versions.published(spark, path)
    kept = {d for d in os.listdir(tmp_path / "t") if d.startswith("v_")}
    touched = spark.createDataFrame([(3,), (70,), (4,)], "k long")
    versions.replace_keys(spark.createDataFrame([(3, "neu", 9), (70, "dazu", None)], "k long, v string, x int"), touched, path, "k", 8)
    want = {(i, f"a{i}", i % 3) for i in range(50) if i not in (3, 4)} | {(3, "neu", 9), (70, "dazu", None)}
    assert {tuple(r) for r in versions.published(spark, path).collect()} == want
    assert old.count() == 50 and kept < {d for d in os.listdir(tmp_path / "t") if d.startswith("v_")}  # a reader of the old version goes on
    versions.publish(df.limit(0), path, "k", 8)
    assert versions.published(spark, path).count() == 0 and versions.published(spark, f"{path}x") is None
    versions.publish(df, path, "k", 8)
    assert not kept & set(os.listdir(tmp_path / "t"))  # and the oldest is cleared away


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, 'x;"y')], "k int, v string")
    sinks.json_lines(df, f"{tmp_path}/j")
    assert files.json_lines(spark, f"{tmp_path}/j", "k int, v string").count() == 3
    sinks.csv_export(df.coalesce(1), f"{tmp_path}/c")
    text = next(p for p in (tmp_path / "c").iterdir() if p.suffix == ".csv").read_text()
    assert text.startswith('"k";"v"')
    assert {r.k: len(r.points) for r in sinks.nested_map(df, "k").collect()} == {1: 2, 2: 1}
    assert {r.v for r in sinks.gaps_marked(df).collect()} == {"a", "FEHLT", 'x;"y'}
    path = str(tmp_path / "contract.json")
    assert sinks.write_contract(df, path) == "1.0.0" == sinks.write_contract(df, path)
    assert json.load(open(path))["schema"]["required"] == ["k"]
    schema = sinks.contract(df)
    assert sinks.violations(schema, {"k": 1, "v": None}) == []
    assert sinks.violations(schema, {"v": 3}) == ["$.k is missing", "$.v is no string"]
    assert sinks.write_contract(df.withColumn("n", F.lit(1)), path) == "1.1.0"
    assert sinks.write_contract(df.withColumn("k", F.col("k").cast("string")).withColumn("n", F.lit(1)), path) == "2.0.0"


def test_scalars(spark):
    assert one(spark, S.norm_label(F.col("c")), " Name  der\tPerson: *") == "name der person"
    assert one(spark, S.slug(F.col("c")), "  Größe – Öl/Wärme ") == "groesse-oel-waerme"
    assert one(spark, S.thousands(F.lit(1234567))) == "1'234'567"
    assert one(spark, S.half_up_percent(F.lit(1), F.lit(8))) == 13
    days = {"1. Januar 2026": dt.date(2026, 1, 1), "3. März 2020": dt.date(2020, 3, 3), "31.2.2026": None, "1.12.2022": dt.date(2022, 12, 1), "2026-05-06": dt.date(2026, 5, 6), "morgen": None}
    assert {k: one(spark, S.german_date(F.col("c")), k) for k in days} == days
    assert one(spark, S.check_digit(F.col("c")), "761345678901") == (10 - sum(int(x) * (1, 3)[i % 2] for i, x in enumerate("761345678901")) % 10) % 10
    lists = {'["a","b"]': ["a", "b"], '"[\\"a\\"]"': ["a"], "kaputt": [], "": []}
    assert {k: one(spark, S.json_list(F.col("c")), k) for k in lists} == lists
    assert one(spark, S.json_equal(F.col("c"), F.lit('{"b": 2, "a": 1}')), '{"a":1,"b":2}')
    assert one(spark, S.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert one(spark, S.decrypt(S.encrypt(F.col("c"), F.lit("0123456789abcdef")), F.lit("0123456789abcdef")), "geheim") == "geheim"
    assert one(spark, S.contrast(F.lit("000000"), F.lit("ffffff"))) == pytest.approx(21)
    assert one(spark, S.mend_encoding(F.col("c")), "GrÃ¶sse") == "Grösse" and one(spark, S.mend_encoding(F.col("c")), "Grösse") == "Grösse"
    assert tuple(one(spark, S.hex_rgb(F.col("c")), "ff8000")) == (255, 128, 0)


def test_streams(spark, tmp_path):
    ev = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), i % 3, "view" if i % 2 else "click", 1.0) for i in range(40)]
    src = tmp_path / "events"
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1)
    df.filter("event_id < 20").write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    first = {}
    for i, _, u, t, _ in ev[:20]:
        first.setdefault((u, t), i)
    got = {r.event_id: (r.art, r.quelle) for r in streams.drained(streams.once_only(stream)).collect()}
    assert got == {i: ("gespeichert" if first[u, t] == i else "verwendet", first[u, t]) for i, _, u, t, _ in ev[:20]}


def test_history_stream(spark, tmp_path):
    from lotwerk.operators import history as H

    reg = spark.createDataFrame([("k1", "2026-01-01", "a", None), ("k2", "2026-01-01", "b", None)], "kennung string, seit string, schluessel string, geladen_am timestamp_ntz")
    ev = [(1, "k1", "2026-02-01", "umbenannt", "a", "x"), (2, "k2", "2026-02-01", "entfallen", "b", None), (3, "k1", "2026-01-15", "umbenannt", "a", "y")]
    schema = "id long, kennung string, datum string, ereignis string, vorher string, nachher string"
    name = f"stream_{tmp_path.name}"
    for i in range(3):
        spark.createDataFrame(ev[i : i + 1], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    streams.keep_history(stream, str(tmp_path / "raw"), reg, name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in H.published(spark, name).select(*H.CHAIN).collect()}
    assert got == {tuple(r) for r in H.identifier_history(spark.createDataFrame(ev, schema), reg, 99).select(*H.CHAIN).collect()}
