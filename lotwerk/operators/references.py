"""Problem 1: references to records that do not exist."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwerk.operators.skew import skew_join
from lotwerk.session import cut
from lotwerk.sources.tables import table

#: Ids of a block; runs end at block borders, so no window holds more than 2 * 2**BLOCK_BITS rows.
BLOCK_BITS = 12
#: Faulty targets up to which they are broadcast; a row takes about 60 bytes.
MAX_SENT = 200_000


def key_runs(parents: DataFrame) -> DataFrame:
    """(space, block, start, end, latest, any_deleted): contiguous runs of the ids of parents(space, id, arrived, deleted).

    parents has one row an id. A run is kept with the latest arrival in it and whether one of it is deleted, so that a
    reference into a clean run needs no look at the single id.
    """
    blocks = parents.withColumn("block", F.shiftright("id", BLOCK_BITS))
    order = Window.partitionBy("space", "block").orderBy("id")
    return (
        blocks.withColumn("island", F.col("id") - F.row_number().over(order))
        .groupBy("space", "block", "island")
        .agg(F.min("id").alias("start"), F.max("id").alias("end"), F.max("arrived").alias("latest"), F.max("deleted").alias("any_deleted"))
        .drop("island")
    )


def as_of_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """keys(space, id, ...) with end, latest, any_deleted of the run with the greatest start <= id in the id's block."""
    extra = [c for c in keys.columns if c not in ("space", "id")]
    k = keys.select("space", F.shiftright("id", BLOCK_BITS).alias("block"), "id", F.lit(1).alias("kind"), *extra)
    r = runs.select("space", "block", F.col("start").alias("id"), F.lit(0).alias("kind"), "end", "latest", "any_deleted")
    before = Window.partitionBy("space", "block").orderBy("id", "kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = k.unionByName(r, allowMissingColumns=True)
    for c in ("end", "latest", "any_deleted"):
        matched = matched.withColumn(c, F.last(c, ignorenulls=True).over(before))
    return matched.filter("kind = 1").drop("kind", "block")


def faulty_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """Every record of references whose target is missing, deleted or arrived later.

    references(tabelle, satz, ziel_tabelle, ziel_id, ankunft): raw rows; a record (tabelle, satz) may come several
    times. Its arrival is the earliest, its reference that of the row that arrived last (ties by hash).
    targets(ziel_tabelle, id, ankunft, geloescht): raw rows; an id's arrival is the earliest, and it is deleted if any
    row says so. Returns (tabelle, satz, ziel_id, art, periode).

    Records are condensed to distinct targets before anything else; those are matched as of the run index, and only
    targets in a run with a deletion or a late arrival are looked up singly. The records then take the verdict of
    their target: by broadcast when the faulty targets are MAX_SENT at most, else with only the heaviest broadcast.

    Null reference: no row. Null target table or one without rows: fehlt. Null arrivals: never verspaetet, periode null
    when the record has none. Rows with a null key count as one record. Empty targets: every reference is fehlt.
    """
    # fixed-width state only, so that the records are condensed by hashing without a sort: the exact arrival, then the
    # target's hash, in one number
    space = F.coalesce(F.xxhash64("ziel_tabelle"), F.lit(0))
    micros = F.coalesce(F.unix_micros(F.col("ankunft").cast("timestamp")), F.lit(-(1 << 60))).cast("decimal(19,0)")
    at = (micros * F.lit(Decimal(1 << 62)).cast("decimal(19,0)")).cast("decimal(38,0)") + F.shiftright(F.xxhash64("ziel_id", "ziel_tabelle"), 2).cast("decimal(19,0)")
    at = at.cast("decimal(38,0)")
    records = cut(
        references.select("tabelle", "satz", space.alias("space"), F.col("ziel_id").alias("id"), "ankunft", at.alias("at"))
        .groupBy("tabelle", "satz")
        .agg(F.min("ankunft").alias("ankunft"), F.max_by("id", "at").alias("id"), F.max_by("space", "at").alias("space"))
        .filter("id is not null")
    )
    known = (
        targets.filter("id is not null")
        .groupBy(F.xxhash64("ziel_tabelle").alias("space"), "id")
        .agg(F.min("ankunft").alias("arrived"), F.max("geloescht").alias("deleted"))
    )
    keys = records.groupBy("space", "id").agg(F.count("*").alias("n"), F.min("ankunft").alias("first"))
    matched = as_of_runs(keys, key_runs(known))
    beyond = F.col("end").isNull() | (F.col("id") > F.col("end"))
    look = cut(matched.filter(beyond | F.col("any_deleted") | (F.col("latest") > F.col("first"))).withColumn("beyond", beyond))
    bad = (
        look.filter("not beyond")
        .select("space", "id", "n", "first")
        .join(known, ["space", "id"])
        .filter("deleted or arrived > first")
        .select("space", "id", "n", "arrived", F.when(F.col("deleted"), "geloescht").otherwise("verspaetet").alias("why"))
    )
    missing = look.filter("beyond").select("space", "id", "n", F.lit(None).cast("timestamp_ntz").alias("arrived"), F.lit("fehlt").alias("why"))
    faulty = cut(missing.unionByName(bad))
    if faulty.count() <= MAX_SENT:
        found = records.join(F.broadcast(faulty.drop("n")), ["space", "id"])
    else:
        found = skew_join(records, faulty, ["space", "id"], weight="n")
    return found.filter("why <> 'verspaetet' or arrived > ankunft").select(
        "tabelle", "satz", F.col("id").alias("ziel_id"), F.col("why").alias("art"), F.date_format("ankunft", "yyyy-MM").alias("periode")
    )


def catalogue_references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The references of the catalogue's four referring columns and their targets, as faulty_references takes them."""
    parts = [
        ("data_subfield", F.col("id").cast("string"), F.lit("ech_element"), "ech_element_id", ["id"]),
        ("form_outcome", F.col("form_id").cast("string"), F.lit("article"), "article_id", ["form_id"]),
        ("beilage", F.col("id").cast("string"), F.lit("data_field"), "data_field_id", ["id"]),
        ("kennung", F.col("kennung"), F.col("ziel_tabelle"), "ziel_id", ["kennung", "ziel_tabelle"]),
    ]
    references = None
    for name, key, target, column, needed in parts:
        rows = table(spark, folder, name, *needed, column, "geladen_am").select(
            F.lit(name).alias("tabelle"), key.alias("satz"), target.alias("ziel_tabelle"), F.col(column).alias("ziel_id"), F.col("geladen_am").alias("ankunft")
        )
        references = rows if references is None else references.unionByName(rows)
    targets = None
    for name, deletes in (("ech_element", True), ("article", True), ("data_field", True), ("data_subfield", False)):
        rows = table(spark, folder, name, "id", "geladen_am", *["geloescht_am"] * deletes).select(
            F.lit(name).alias("ziel_tabelle"),
            "id",
            F.col("geladen_am").alias("ankunft"),
            (F.col("geloescht_am").isNotNull() if deletes else F.lit(False)).alias("geloescht"),
        )
        targets = rows if targets is None else targets.unionByName(rows)
    return references, targets


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return faulty_references(*catalogue_references(spark, folder))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Faults per table, month and kind."""
    return p1_found(spark, folder).groupBy("tabelle", "periode", "art").agg(F.count("*").alias("n"))


_REFS = """
refs AS (
  SELECT 'data_subfield' tabelle, CAST(id AS VARCHAR) satz, 'ech_element' zt, ech_element_id ziel_id, geladen_am FROM data_subfield
  UNION ALL SELECT 'form_outcome', CAST(form_id AS VARCHAR), 'article', article_id, geladen_am FROM form_outcome
  UNION ALL SELECT 'beilage', CAST(id AS VARCHAR), 'data_field', data_field_id, geladen_am FROM beilage
  UNION ALL SELECT 'kennung', kennung, ziel_tabelle, ziel_id, geladen_am FROM kennung),
rec AS (SELECT tabelle, satz, max(zt) zt, max(ziel_id) ziel_id, min(geladen_am) am FROM refs GROUP BY tabelle, satz HAVING max(ziel_id) IS NOT NULL),
tgt AS (
  SELECT 'ech_element' zt, id, min(geladen_am) am, count(geloescht_am) > 0 weg FROM ech_element GROUP BY id
  UNION ALL SELECT 'article', id, min(geladen_am), count(geloescht_am) > 0 FROM article GROUP BY id
  UNION ALL SELECT 'data_field', id, min(geladen_am), count(geloescht_am) > 0 FROM data_field GROUP BY id
  UNION ALL SELECT 'data_subfield', id, min(geladen_am), false FROM data_subfield GROUP BY id),
found AS (
  SELECT r.tabelle, r.satz, r.ziel_id,
    CASE WHEN t.id IS NULL THEN 'fehlt' WHEN t.weg THEN 'geloescht' WHEN t.am > r.am THEN 'verspaetet' END art,
    strftime(r.am, '%Y-%m') periode
  FROM rec r LEFT JOIN tgt t ON t.zt = r.zt AND t.id = r.ziel_id)
"""
SQL = {
    "p1_found": f"WITH {_REFS} SELECT * FROM found WHERE art IS NOT NULL",
    "p1_report": f"WITH {_REFS} SELECT tabelle, periode, art, count(*) n FROM found WHERE art IS NOT NULL GROUP BY tabelle, periode, art",
}
QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
