"""Constraints and gates: each query's rows are errors, or figures of how many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwerk.functions import scalars as S
from lotwerk.operators import gates as G
from lotwerk.plans.registry import money, registry
from lotwerk.sources.tables import table

QUERIES, SQL, query = registry()


@query("""SELECT 'lineitem.l_orderkey' fk, count(*) n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'data_subfield.data_field_id', count(*) FROM data_subfield WHERE data_field_id IS NOT NULL AND data_field_id NOT IN (SELECT id FROM data_field) UNION ALL SELECT 'beilage.data_field_id', count(*) FROM beilage WHERE data_field_id IS NOT NULL AND data_field_id NOT IN (SELECT id FROM data_field)""")
def gate_fk(s: SparkSession, d: str) -> DataFrame:
    """Rows of each foreign key without a target."""
    keys = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("data_subfield", "data_field_id", "data_field", "id"), ("beilage", "data_field_id", "data_field", "id")]
    out = None
    for t, c, parent, pk in keys:
        rows = G.foreign_key(table(s, d, t, c), c, table(s, d, parent, pk), pk)
        part = rows.agg(F.count("*").alias("n")).select(F.lit(f"{t}.{c}").alias("fk"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT id, count(*) n FROM data_subfield GROUP BY id, geladen_am HAVING count(*) > 1")
def gate_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Rows delivered twice at the same time."""
    return G.duplicates(table(s, d, "data_subfield", "id", "geladen_am"), ["id", "geladen_am"]).select("id", "n")


@query("SELECT obligatorium wert, count(*) n FROM beilage WHERE obligatorium IS NOT NULL AND obligatorium NOT IN ('zwingend', 'bedingt') GROUP BY ALL")
def gate_vocab(s: SparkSession, d: str) -> DataFrame:
    """Values outside a vocabulary."""
    return G.vocabulary(table(s, d, "beilage", "obligatorium"), "obligatorium", ["zwingend", "bedingt"]).groupBy(F.col("obligatorium").alias("wert")).agg(F.count("*").alias("n"))


@query("SELECT kennung, status FROM (SELECT DISTINCT kennung, status, bis FROM kennung) WHERE (status = 'aktiv') <> (bis IS NULL)")
def gate_iff(s: SparkSession, d: str) -> DataFrame:
    """Rows where one condition holds without the other."""
    k = table(s, d, "kennung", "kennung", "status", "bis").distinct()
    return G.iff(k, F.col("status") == "aktiv", F.col("bis").isNull()).select("kennung", "status")


@query("SELECT a.quelle, a.datum, CAST(anzahl AS BIGINT) anzahl, n FROM (SELECT DISTINCT * FROM quellen_abzug) a LEFT JOIN (SELECT datei, count(DISTINCT schluessel) n FROM quellen_zeile GROUP BY datei) z ON z.datei = a.datei WHERE anzahl IS DISTINCT FROM n")
def gate_recount(s: SparkSession, d: str) -> DataFrame:
    """Stored counts that differ from a recount; none are expected."""
    z = table(s, d, "quellen_zeile", "datei", "schluessel").groupBy("datei").agg(F.count_distinct("schluessel").alias("n"))
    a = table(s, d, "quellen_abzug").distinct().join(z, "datei", "left")
    return a.select("quelle", "datum", F.col("anzahl").cast("long").alias("anzahl"), "n").filter(~F.col("anzahl").eqNullSafe(F.col("n")))


@query("SELECT 'region' ebene, CAST(sum(x) AS DOUBLE) summe FROM (SELECT r_name, sum(CAST(o_totalprice AS DECIMAL(18,2))) x FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL) UNION ALL SELECT 'nation', CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders UNION ALL SELECT 'gesamt', CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders")
def gate_parts(s: SparkSession, d: str) -> DataFrame:
    """A total on three levels, each summed from the one below."""
    o = table(s, d, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("x"))
    n = o.join(table(s, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("x").alias("x"))
    r = n.join(table(s, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.sum("x").alias("x"))
    out = None
    for name, df in (("gesamt", o), ("nation", n), ("region", r)):
        row = df.agg(F.sum("x").cast("double").alias("summe")).select(F.lit(name).alias("ebene"), "summe")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND n_chars <> length(text)")
def gate_stored_length(s: SparkSession, d: str) -> DataFrame:
    """Stored lengths that are not the text's; none are expected."""
    return table(s, d, "documents", "doc_id", "text", "n_chars").filter(F.length("text") != F.col("n_chars")).select("doc_id")


@query("SELECT id, art FROM (SELECT s.id, min(s.name) AS name, min(f.name) fname FROM data_subfield s JOIN data_field f ON f.id = s.data_field_id GROUP BY s.id), LATERAL (SELECT CASE WHEN name IS NULL THEN 'ohne_name' WHEN contains(lower(coalesce(fname, '')), lower(name)) THEN 'im_feldnamen' ELSE 'ok' END art) WHERE art <> 'ok'")
def gate_containment(s: SparkSession, d: str) -> DataFrame:
    """A value that must not be, or must be, contained in its quote."""
    sub = table(s, d, "data_subfield", "id", "data_field_id", "name")
    f = table(s, d, "data_field", "id", "name").select(F.col("id").alias("data_field_id"), F.col("name").alias("fname"))
    g = sub.join(f, "data_field_id").groupBy("id").agg(F.min("name").alias("name"), F.min("fname").alias("fname"))
    art = F.when(F.col("name").isNull(), "ohne_name").when(F.contains(F.lower(F.coalesce("fname", F.lit(""))), F.lower("name")), "im_feldnamen")
    return g.select("id", art.alias("art")).filter("art is not null")


@query(r"SELECT DISTINCT kennung FROM kennung WHERE NOT regexp_full_match(kennung, 'sh:(formular:[ft][0-9]+:feld:[0-9]+(:teil:[0-9]+)?|gesetz:[a-z]+-[0-9]+:art-[0-9]+-[0-9]+)')")
def gate_identifier_shape(s: SparkSession, d: str) -> DataFrame:
    """Identifiers that are not built as they must be."""
    k = table(s, d, "kennung", "kennung").distinct()
    return k.filter(~F.col("kennung").rlike(r"^sh:(formular:[ft][0-9]+:feld:[0-9]+(:teil:[0-9]+)?|gesetz:[a-z]+-[0-9]+:art-[0-9]+-[0-9]+)$"))


@query("SELECT DISTINCT k.kennung, k.abgeloest_durch FROM kennung k WHERE k.abgeloest_durch IS NOT NULL AND (k.status <> 'abgeloest' OR k.abgeloest_durch NOT IN (SELECT kennung FROM kennung WHERE kennung IS NOT NULL))")
def gate_successor(s: SparkSession, d: str) -> DataFrame:
    """Successors that do not exist, or belong to identifiers that are not superseded."""
    k = table(s, d, "kennung", "kennung", "abgeloest_durch", "status").filter("abgeloest_durch is not null").distinct()
    there = table(s, d, "kennung", "kennung").distinct().select(F.col("kennung").alias("abgeloest_durch"), F.lit(True).alias("there"))
    return k.join(there, "abgeloest_durch", "left").filter("status <> 'abgeloest' or there is null").select("kennung", "abgeloest_durch").distinct()


@query("SELECT 'at' zeichen, count_if(contains(text, '@')) n FROM documents UNION ALL SELECT 'pfad', count_if(regexp_matches(text, '(/Users/|/home/|C:\\\\)')) FROM documents UNION ALL SELECT 'url', count_if(contains(text, 'https://')) FROM documents")
def gate_wording(s: SparkSession, d: str) -> DataFrame:
    """Characters and paths that no published text may hold, counted."""
    t = table(s, d, "documents", "text")
    tests = {"at": F.col("text").contains("@"), "pfad": F.col("text").rlike(r"(/Users/|/home/|C:\\)"), "url": F.col("text").contains("https://")}
    row = t.agg(*(F.count_if(c).alias(k) for k, c in tests.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("zeichen"), F.col(k).alias("n")) for k in tests))).alias("x")).select("x.*")


@query("SELECT kennung FROM kennung GROUP BY kennung HAVING count(DISTINCT sha256(concat_ws('|', art, coalesce(schluessel, ''), coalesce(merkmal, '')))) > 1")
def gate_immutable(s: SparkSession, d: str) -> DataFrame:
    """Columns that must never change between deliveries of a row, and did; none are expected."""
    k = table(s, d, "kennung", "kennung", "art", "schluessel", "merkmal").select("kennung", S.fingerprint(F.col("art"), F.col("schluessel"), F.col("merkmal"), length=64).alias("fp"))
    return k.groupBy("kennung").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("kennung")
