"""Problem 7: what changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwerk.functions.dates import day, day_text
from lotwerk.operators.skew import checked_join
from lotwerk.session import cut
from lotwerk.sources.tables import table

COMPARED = ["title", "kurzbeschreibung", "unterlagen", "gebuehren", "dienststelle", "status"]


def json_value(text: Column) -> Column:
    """JSON text in one spelling: no white space, keys in order, characters unescaped; other text stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def latest_reads(rows: DataFrame, compared: list[str], json_columns: tuple[str, ...]) -> DataFrame:
    """(quelle, abzug, schluessel, marks): of the row of a key with the latest gelesen_am one hash a compared column.

    The hashes are taken before the shuffle, so no text is moved; two of 64 bits that are equal by chance would hide a
    change. Ties: the greatest hashes.
    """
    value = lambda c: json_value(F.col(c)) if c in json_columns else F.col(c)
    marks = F.array(*(F.coalesce(F.xxhash64(F.col(c).isNull(), value(c)), F.lit(0)) for c in compared))
    newest = F.max(F.struct(F.col("gelesen_am").alias("at"), marks.alias("marks")))
    return rows.groupBy("quelle", "abzug", "schluessel").agg(newest.alias("r")).select("quelle", "abzug", "schluessel", F.col("r.marks").alias("marks"))


def snapshot_changes(rows: DataFrame, pairs: DataFrame, compared: list[str] = COMPARED, json_columns: tuple[str, ...] = ("unterlagen",)) -> DataFrame:
    """(quelle, abzug, vorher, schluessel, art, felder) of every key that differs between the harvests of pairs.

    rows(quelle, abzug, schluessel, gelesen_am, compared...): raw rows of the full snapshots. pairs(quelle, abzug,
    vorher): which harvest is compared with which. felder are the columns that differ, for art geaendert. EXCEPT ALL
    of fingerprinted rows both ways takes the identical rows away; only the residues are joined in full by key. A harvest
    is in pairs once at most on either side.

    Null values equal each other and differ from any value; json_columns are compared as JSON values, text that is no
    JSON as text. Null keys are one key. A harvest without rows removes all keys of the one before. No pairs: no rows.
    """
    pairs = cut(pairs.select("quelle", "abzug", "vorher").distinct())
    # only harvests of a pair are read further: those logged long ago stay out before anything is parsed or shuffled
    wanted = pairs.select("quelle", "abzug").union(pairs.select("quelle", "vorher")).distinct().withColumn("asked", F.lit(True))
    some = checked_join(rows, wanted, ["quelle", "abzug"])
    marked = cut(latest_reads(some, compared, json_columns))
    columns = ["quelle", "abzug", "vorher", "schluessel", "marks"]
    # a harvest may hold a third of all rows and is one key here, so pairs is never shuffled against unless it is huge
    now = checked_join(marked, pairs, ["quelle", "abzug"]).select(*columns)
    then = checked_join(marked.withColumnRenamed("abzug", "vorher"), pairs, ["quelle", "vorher"]).select(*columns)
    added, gone = now.exceptAll(then), then.exceptAll(now)
    key = ["quelle", "abzug", "vorher", "schluessel"]
    a = added.select(*key, F.col("marks").alias("new"))
    g = gone.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("marks").alias("old"))
    on = F.col(key[0]).eqNullSafe(F.col(f"_{key[0]}"))
    for k in key[1:]:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = a.join(g, on, "full").select(*(F.coalesce(k, f"_{k}").alias(k) for k in key), "new", "old")
    names = F.array(*map(F.lit, compared))
    differ = F.filter(F.transform(names, lambda n, i: F.when(F.get("new", i) != F.get("old", i), n)), lambda n: n.isNotNull())
    art = F.when(F.col("old").isNull(), "neu").when(F.col("new").isNull(), "entfernt").otherwise("geaendert")
    return both.select(*key, art.alias("art"), F.when(art == "geaendert", differ).alias("felder"))


def open_pairs(harvests: DataFrame, log: DataFrame) -> DataFrame:
    """(quelle, abzug, vorher): each harvest with an earlier one of its source and no row in the change log yet."""
    order = Window.partitionBy("quelle").orderBy("abzug")
    dates = harvests.select("quelle", F.col("datum").alias("abzug")).filter("abzug is not null").distinct()
    return (
        dates.withColumn("vorher", F.lag("abzug").over(order))
        .filter("vorher is not null")
        .join(log.select("quelle", "abzug").distinct(), ["quelle", "abzug"], "left_anti")
    )


def p7_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The change log as it would go on, with the columns that changed joined by commas."""
    # harvests are told apart and put in order by their day, whatever its spelling
    same = lambda df, c: df.withColumn(c, F.coalesce(day_text(day(F.col(c))), c))
    rows = same(table(spark, folder, "quellen_zeile", "quelle", "abzug", "schluessel", "gelesen_am", *COMPARED), "abzug")
    pairs = open_pairs(same(table(spark, folder, "quellen_abzug", "quelle", "datum"), "datum"), same(table(spark, folder, "quellen_aenderung", "quelle", "abzug"), "abzug"))
    return snapshot_changes(rows, pairs).withColumn("felder", F.array_join("felder", ","))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_changes(spark, folder).select("quelle", "abzug", "schluessel", "art")


_CHANGES = """
WITH h AS (SELECT DISTINCT quelle, datum abzug FROM quellen_abzug),
p AS (SELECT * FROM (SELECT quelle, abzug, lag(abzug) OVER (PARTITION BY quelle ORDER BY abzug) vorher FROM h)
  WHERE vorher IS NOT NULL AND (quelle, abzug) NOT IN (SELECT (quelle, abzug) FROM quellen_aenderung)),
j AS (SELECT quelle, abzug, schluessel, gelesen_am, title, kurzbeschreibung, gebuehren, dienststelle, status, unterlagen,
    CASE WHEN unterlagen IS NULL THEN NULL ELSE CAST(list_transform(CAST(unterlagen AS JSON[]), lambda x: list_sort(map_entries(CAST(x AS MAP(VARCHAR, JSON))))) AS VARCHAR) END u
  FROM quellen_zeile),
r AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY quelle, abzug, schluessel ORDER BY gelesen_am DESC) = 1),
n AS (SELECT p.quelle, p.abzug, p.vorher, r.* EXCLUDE (quelle, abzug) FROM p JOIN r ON r.quelle = p.quelle AND r.abzug = p.abzug),
o AS (SELECT p.quelle, p.abzug, p.vorher, r.* EXCLUDE (quelle, abzug) FROM p JOIN r ON r.quelle = p.quelle AND r.abzug = p.vorher),
b AS (SELECT coalesce(n.quelle, o.quelle) quelle, coalesce(n.abzug, o.abzug) abzug, coalesce(n.vorher, o.vorher) vorher, coalesce(n.schluessel, o.schluessel) schluessel,
  CASE WHEN o.schluessel IS NULL THEN 'neu' WHEN n.schluessel IS NULL THEN 'entfernt' ELSE 'geaendert' END art,
  concat_ws(',', CASE WHEN n.title IS DISTINCT FROM o.title THEN 'title' END,
    CASE WHEN n.kurzbeschreibung IS DISTINCT FROM o.kurzbeschreibung THEN 'kurzbeschreibung' END,
    CASE WHEN n.u IS DISTINCT FROM o.u THEN 'unterlagen' END, CASE WHEN n.gebuehren IS DISTINCT FROM o.gebuehren THEN 'gebuehren' END,
    CASE WHEN n.dienststelle IS DISTINCT FROM o.dienststelle THEN 'dienststelle' END, CASE WHEN n.status IS DISTINCT FROM o.status THEN 'status' END) felder
  FROM n FULL JOIN o ON n.quelle = o.quelle AND n.abzug = o.abzug AND n.schluessel = o.schluessel)
"""
SQL = {
    "p7_found": _CHANGES + "SELECT quelle, abzug, schluessel, art FROM b WHERE art <> 'geaendert' OR felder <> ''",
    "p7_changes": _CHANGES + "SELECT quelle, abzug, vorher, schluessel, art, CASE WHEN art = 'geaendert' THEN felder END felder FROM b WHERE art <> 'geaendert' OR felder <> ''",
}
QUERIES = {"p7_found": p7_found, "p7_changes": p7_changes}
