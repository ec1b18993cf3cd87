"""Readers for the catalogue's input files: all read by executors, none looped over on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_folder(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All JSON documents of a folder by a declared schema, with file, and corrupt holding what could not be read."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    declared = T.StructType([*declared.fields, T.StructField("corrupt", T.StringType())])
    rows = spark.read.schema(declared).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(folder)
    return rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def json_items(texts: DataFrame, column: str, key: str, item: str) -> DataFrame:
    """One row an item (of the DDL type item) of documents that are {key: [items]} or just [items]; others give none."""
    doc = F.try_parse_json(F.col(column))
    listed = F.coalesce(F.try_variant_get(doc, f"$.{key}", f"array<{item}>"), F.try_variant_get(doc, "$", f"array<{item}>"))
    return texts.withColumn("item", F.explode(listed)).drop(column)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def xsd_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(file, version, kind, type_name, value) of schema files: element names, and values of named and inline enumerations.

    Inline enumerations are named @Type.element. Every file is parsed whole by one task.
    """
    import xml.etree.ElementTree as ET

    xs = "{http://www.w3.org/2001/XMLSchema}"

    def parse(batches):
        import pandas as pd

        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    root = ET.fromstring(raw)
                except ET.ParseError:
                    out.append((name, None, "unreadable", None, None))
                    continue
                version = root.get("version")
                up = {c: p for p in root.iter() for c in p}
                for el in root.iter(f"{xs}element"):
                    if el.get("name"):
                        out.append((name, version, "element", None, el.get("name")))
                for st in root.iter(f"{xs}simpleType"):
                    label = st.get("name")
                    if not label:
                        owner, kind = up.get(st), None
                        while (kind := up.get(kind if kind is not None else st)) is not None and not (kind.tag == f"{xs}complexType" and kind.get("name")):
                            pass
                        label = f"@{kind.get('name') if kind is not None else ''}.{owner.get('name', '') if owner is not None else ''}"
                    out += [(name, version, "value", label, e.get("value")) for e in st.iter(f"{xs}enumeration")]
            yield pd.DataFrame(out, columns=["file", "version", "kind", "type_name", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xsd").load(folder).select("path", "content")
    return files.mapInPandas(parse, "file string, version string, kind string, type_name string, value string")


def main_schema_files(files: DataFrame) -> DataFrame:
    """Of each standard's schema files(file) its own: highest version, lowest part, no supplements in other languages."""
    named = files.select("file", *(F.regexp_extract("file", r"^(eCH-\d{4})(?:-(\d+))?-(\d+)-(\d+)\.xsd$", i).alias(c) for i, c in enumerate(("standard", "part", "major", "minor"), 1)))
    named = named.filter("standard <> ''")
    best = F.max(F.struct(F.col("major").cast("int").alias("a"), F.col("minor").cast("int").alias("b"), (-F.coalesce(F.expr("try_cast(part as int)"), F.lit(0))).alias("c"), "file"))
    return named.groupBy("standard").agg(best.alias("x")).select("standard", "x.file")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a tag of XML files, as the articles of a law."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def text_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(file, url, art, titel, abgerufen, sha256, text, intact): texts under a header block that ends in a line ---."""
    whole = spark.read.text(folder, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    cutpos = F.instr("value", "\n---\n")
    head, text = F.left("value", cutpos), F.substr("value", cutpos + 5)
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?m)^{name}:\s*(.*)$", 1), F.lit(""))
    rows = whole.filter(cutpos > 0).select("file", *(field(n).alias(n) for n in ("url", "art", "titel", "abgerufen", "sha256")), text.alias("text"))
    return rows.withColumn("intact", F.sha2("text", 256) == F.col("sha256"))


def html_sections(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with title, sections (heading and visible text between headings) and links."""
    from lotwerk.functions.scalars import visible_text

    parts = F.split(F.col(column), r"(?i)<h2[^>]*>")
    section = lambda p: F.struct(visible_text(F.element_at(F.split(p, r"(?i)</h2>"), 1)).alias("heading"), visible_text(F.coalesce(F.get(F.split(p, r"(?i)</h2>"), F.lit(1)), F.lit(""))).alias("text"))
    return pages.select(
        *[c for c in pages.columns if c != column],
        visible_text(F.regexp_extract(column, r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("title"),
        F.transform(F.slice(parts, 2, F.size(parts)), section).alias("sections"),
        F.regexp_extract_all(F.col(column), F.lit(r'(?i)href="([^"]*)"'), F.lit(1)).alias("links"),
    )


def law_articles(lines: DataFrame) -> DataFrame:
    """(law, article, heading, text) of ordered lines(law, line_no, text).

    A line that begins with Art. or § opens an article, and the line after it is its heading if it does not end a
    sentence; lines before the first article are left out, as are lines that stand for a page and those that come back
    more than three times in a law, its running headers. Windows are one law's lines.
    """
    law = Window.partitionBy("law").orderBy("line_no")
    seen = F.count("*").over(Window.partitionBy("law", "text"))
    kept = lines.filter(F.trim("text") != "").withColumn("seen", seen).filter("seen <= 3").filter(~F.col("text").rlike(r"^\s*\d+\s*$"))
    number = F.regexp_extract("text", r"^\s*(?:Art\.|§)\s*(\d+(?:\s?[a-z]+)?)", 1)
    opened = kept.withColumn("no", F.nullif(number, F.lit(""))).withColumn("article", F.last("no", ignorenulls=True).over(law))
    opened = opened.withColumn("after", F.lag("no").over(law)).filter("article is not null")
    heading = F.max(F.when(F.col("after").isNotNull() & F.col("no").isNull() & ~F.col("text").rlike(r"[.;:]\s*$"), F.col("text")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return opened.groupBy("law", "article").agg(heading.alias("heading"), body.alias("text"))


def file_inventory(spark: SparkSession, folder: str, rules: list[tuple[str, str]], default: str = "sonstiges") -> DataFrame:
    """(file, size, art): files of a folder tree classed by the first rule whose pattern their name matches."""
    from lotwerk.operators.relational import first_match

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("size"))
    return files.withColumn("art", first_match([(F.col("file").rlike(p), name) for p, name in rules], default))


def dated_versions(spark: SparkSession, base: str, on: str | None = None) -> DataFrame:
    """The newest version, not after the day on, of a table kept as base/tag=YYYY-MM-DD."""
    all_ = spark.read.parquet(base)
    tags = all_.select("tag").distinct() if on is None else all_.select("tag").distinct().filter(F.col("tag").cast("string") <= on)
    newest = tags.agg(F.max("tag")).first()[0]
    return all_.filter(F.col("tag") == F.lit(newest)).drop("tag")


def office_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, part, place, style, text) of .docx paragraphs and .xlsx cells; a file that cannot be read gives one row
    with part unreadable. Each package is opened whole by one task."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    sheet = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def parse(batches):
        import io
        import xml.etree.ElementTree as ET
        import zipfile

        import pandas as pd

        def text(node, tag):
            return "".join(t.text or "" for t in node.iter(tag))

        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    pack = zipfile.ZipFile(io.BytesIO(raw))
                    if name.lower().endswith(".docx"):
                        for i, p in enumerate(ET.fromstring(pack.read("word/document.xml")).iter(f"{word}p")):
                            style = p.find(f"{word}pPr/{word}pStyle")
                            out.append((name, "document", str(i), style.get(f"{word}val") if style is not None else None, text(p, f"{word}t")))
                        continue
                    shared = [text(x, f"{sheet}t") for x in ET.fromstring(pack.read("xl/sharedStrings.xml")).iter(f"{sheet}si")] if "xl/sharedStrings.xml" in pack.namelist() else []
                    for part in sorted(n for n in pack.namelist() if n.startswith("xl/worksheets/sheet")):
                        for c in ET.fromstring(pack.read(part)).iter(f"{sheet}c"):
                            v = c.findtext(f"{sheet}v")
                            value = shared[int(v)] if c.get("t") == "s" and v else text(c, f"{sheet}t") or v
                            out.append((name, part.rsplit("/", 1)[-1][:-4], c.get("r"), c.get("s"), value))
                except (zipfile.BadZipFile, KeyError, IndexError, ET.ParseError):
                    out.append((name, "unreadable", None, None, None))
            yield pd.DataFrame(out, columns=["file", "part", "place", "style", "text"])

    packages = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx}").load(folder).select("path", "content")
    return packages.mapInPandas(parse, "file string, part string, place string, style string, text string")
