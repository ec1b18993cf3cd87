"""Further scalar rules, updates by lookup, references from everywhere, and generic gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwerk.functions.dates import day
from lotwerk.operators import gates as G
from lotwerk.operators.relational import first_match
from lotwerk.operators.skew import skew_join
from lotwerk.plans.registry import money, registry
from lotwerk.sources.tables import table

QUERIES, SQL, query = registry()

#: Small numbers in words.
NUMBER_WORDS = {"zehn": 10, "vierzehn": 14, "zwanzig": 20, "dreissig": 30, "sechzig": 60, "neunzig": 90}
#: Conditions as readers see them.
READER_TEXT = {r"^nur bei ": "wird verlangt bei ", r"^falls ": "wird verlangt, falls ", r"^ab (\d+) ": r"wird verlangt ab $1 ", r"^bei ": "wird verlangt bei "}
#: Codes of data types that a form of flat fields may use.
FLAT_TYPES = ["text", "number", "date", "boolean", "money", "enum"]


@query(r"SELECT DISTINCT datei, regexp_replace(regexp_replace(lower(datei), '\.[a-z0-9]+$', ''), '[^a-z]+', '', 'g') stamm, list_max(list_transform(regexp_extract_all(datei, '(?:19|20)[0-9]{2}'), lambda x: CAST(x AS INTEGER))) jahr FROM quellen_abzug WHERE datei IS NOT NULL")
def file_stems(s: SparkSession, d: str) -> DataFrame:
    """File names without separators, numbers and suffix, and the latest year in them."""
    f = table(s, d, "quellen_abzug", "datei").filter("datei is not null").distinct()
    stem = F.regexp_replace(F.regexp_replace(F.lower("datei"), r"\.[a-z0-9]+$", ""), "[^a-z]+", "")
    years = F.transform(F.regexp_extract_all("datei", F.lit("(?:19|20)[0-9]{2}"), F.lit(0)), lambda x: x.cast("int"))
    return f.select("datei", stem.alias("stamm"), F.array_max(years).alias("jahr"))


_WORD_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in NUMBER_WORDS.items())


@query(rf"SELECT tage, count(*) n FROM (SELECT coalesce(TRY_CAST(w AS INTEGER), CASE w {_WORD_CASE} END) tage FROM (SELECT unnest(regexp_extract_all(lower(text), '([0-9]+|{'|'.join(NUMBER_WORDS)}) tagen?\b', 1)) w FROM documents WHERE text IS NOT NULL)) GROUP BY tage")
def number_words(s: SparkSession, d: str) -> DataFrame:
    """Terms in days found in texts, in digits or in words."""
    t = table(s, d, "documents", "text").filter("text is not null")
    w = t.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"([0-9]+|{'|'.join(NUMBER_WORDS)}) tagen?\b"), F.lit(1))).alias("w"))
    named = F.lit(None).cast("int")
    for k, v in NUMBER_WORDS.items():
        named = F.when(F.col("w") == k, v).otherwise(named)
    return w.groupBy(F.coalesce(F.expr("try_cast(w as int)"), named).alias("tage")).agg(F.count("*").alias("n"))


@query("SELECT id, 'Art. ' || regexp_replace(article_no, '^([0-9]+)(bis|ter|quater|[a-z]*)$', '\\1') || CASE WHEN regexp_matches(article_no, '[a-z]') THEN ' ' || regexp_extract(article_no, '^[0-9]+(.*)$', 1) ELSE '' END || ' (' || law_id || ')' zitat, ltrim(regexp_extract(article_no, '^[0-9]+'), '0') nummer FROM (SELECT id, min(article_no) article_no, min(law_id) law_id FROM article GROUP BY id) WHERE article_no IS NOT NULL AND law_id IS NOT NULL")
def citations(s: SparkSession, d: str) -> DataFrame:
    """Articles as they are cited, and their bare numbers."""
    a = table(s, d, "article", "id", "article_no", "law_id").groupBy("id").agg(F.min("article_no").alias("no"), F.min("law_id").alias("law")).filter("no is not null and law is not null")
    bare = F.regexp_replace("no", "^([0-9]+)(bis|ter|quater|[a-z]*)$", "$1")
    suffix = F.when(F.col("no").rlike("[a-z]"), F.concat(F.lit(" "), F.regexp_extract("no", "^[0-9]+(.*)$", 1))).otherwise("")
    return a.select("id", F.concat(F.lit("Art. "), bare, suffix, F.lit(" ("), F.col("law").cast("string"), F.lit(")")).alias("zitat"), F.ltrim(F.regexp_extract("no", "^[0-9]+", 0), F.lit("0")).alias("nummer"))


def _sql_replaced(c: str) -> str:
    for a, b in READER_TEXT.items():
        c = f"regexp_replace({c}, '{a}', '{b.replace('$', chr(92))}')"
    return c


@query(f"SELECT bedingung, {_sql_replaced('bedingung')} text, count(*) n FROM beilage WHERE bedingung IS NOT NULL GROUP BY bedingung")
def reader_text(s: SparkSession, d: str) -> DataFrame:
    """Conditions in readers' words, by a table of replacements in order."""
    b = table(s, d, "beilage", "bedingung").filter("bedingung is not null").groupBy("bedingung").agg(F.count("*").alias("n"))
    t = F.col("bedingung")
    for a, r in READER_TEXT.items():
        t = F.regexp_replace(t, a, r)
    return b.select("bedingung", t.alias("text"), "n")


@query("SELECT stufe, count(*) n FROM (SELECT CASE WHEN last_checked IS NULL THEN 'ohne' WHEN starts_with(last_checked, 'UNVERIFIED') THEN 'offen' WHEN starts_with(last_checked, '20') THEN 'geprueft' ELSE 'anders' END stufe FROM article) GROUP BY stufe")
def check_levels(s: SparkSession, d: str) -> DataFrame:
    """How far rows are verified, by how their mark begins."""
    c = F.col("last_checked")
    level = first_match([(c.isNull(), "ohne"), (c.startswith("UNVERIFIED"), "offen"), (c.startswith("20"), "geprueft")], "anders")
    return table(s, d, "article", "last_checked").groupBy(level.alias("stufe")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT kennung, CASE WHEN seit LIKE '__.__.____' THEN seit ELSE substr(seit, 9, 2) || '.' || substr(seit, 6, 2) || '.' || substr(seit, 1, 4) END seit FROM kennung WHERE seit IS NOT NULL")
def readable_dates(s: SparkSession, d: str) -> DataFrame:
    """Days as DD.MM.YYYY whatever their spelling."""
    k = table(s, d, "kennung", "kennung", "seit").filter("seit is not null")
    return k.select("kennung", F.date_format(day(F.col("seit")), "dd.MM.yyyy").alias("seit")).distinct()


@query(f"SELECT form_id, len(list_filter(list(DISTINCT data_type) FILTER (data_type IS NOT NULL), lambda x: NOT list_contains({FLAT_TYPES}, x))) = 0 flach FROM data_field WHERE geloescht_am IS NULL GROUP BY form_id")
def code_subset(s: SparkSession, d: str) -> DataFrame:
    """Forms all of whose data types are among the official codes."""
    f = table(s, d, "data_field", "form_id", "data_type", "geloescht_am").filter("geloescht_am is null")
    codes = F.array(*map(F.lit, FLAT_TYPES))
    return f.groupBy("form_id").agg((F.size(F.array_except(F.collect_set("data_type"), codes)) == 0).alias("flach"))


@query("""WITH e AS (SELECT id eid, min(standard) standard FROM ech_element GROUP BY id), f AS (SELECT id, min(ech_element_id) el, min(ech_standard_code) code FROM data_field GROUP BY id)
SELECT f.id, coalesce(code, (SELECT standard FROM e WHERE eid = el)) code, code IS NULL AND EXISTS (SELECT 1 FROM e WHERE eid = el AND standard IS NOT NULL) gesetzt FROM f""")
def conditional_update(s: SparkSession, d: str) -> DataFrame:
    """A column set from another table where it is empty; a frequent element's rows are not gathered."""
    e = table(s, d, "ech_element", "id", "standard").groupBy(F.col("id").alias("el")).agg(F.min("standard").alias("standard"))
    f = table(s, d, "data_field", "id", "ech_element_id", "ech_standard_code").groupBy("id").agg(F.min("ech_element_id").alias("el"), F.min("ech_standard_code").alias("code"))
    j = skew_join(f, e, ["el"], how="left")
    return j.select("id", F.coalesce("code", "standard").alias("code"), (F.col("code").isNull() & F.col("standard").isNotNull()).alias("gesetzt"))


#: Every column that refers to data_field.
REFERRING = [("data_subfield", "data_field_id"), ("beilage", "data_field_id")]


@query("WITH g AS (SELECT DISTINCT id FROM data_field WHERE geloescht_am IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{t}.{c}' spalte, count(*) n, count(DISTINCT {c}) n_ziele FROM {t} WHERE {c} IN (SELECT id FROM g)" for t, c in REFERRING) + " UNION ALL SELECT 'kennung.ziel_id', count(*), count(DISTINCT ziel_id) FROM kennung WHERE ziel_tabelle = 'data_field' AND ziel_id IN (SELECT id FROM g)")
def referring_columns(s: SparkSession, d: str) -> DataFrame:
    """Rows of every column that refers to a withdrawn field, the polymorphic one too: what must be turned when it goes."""
    gone = table(s, d, "data_field", "id", "geloescht_am").filter("geloescht_am is not null").select(F.col("id").alias("ziel")).distinct()
    parts = [(f"{t}.{c}", table(s, d, t, c).select(F.col(c).alias("ziel"))) for t, c in REFERRING]
    parts.append(("kennung.ziel_id", table(s, d, "kennung", "ziel_tabelle", "ziel_id").filter("ziel_tabelle = 'data_field'").select(F.col("ziel_id").alias("ziel"))))
    out = None
    for name, rows in parts:
        row = rows.join(gone, "ziel", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("ziel").alias("n_ziele")).select(F.lit(name).alias("spalte"), "n", "n_ziele")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT coalesce(l.k, o.o_orderkey) o_orderkey, CAST(l.x AS DOUBLE) teile, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) ganzes FROM (SELECT l_orderkey k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) x FROM lineitem GROUP BY ALL) l FULL JOIN orders o ON o.o_orderkey = l.k WHERE l.x IS DISTINCT FROM CAST(o_totalprice AS DECIMAL(18,2))")
def gate_sum_of_parts(s: SparkSession, d: str) -> DataFrame:
    """Totals that are not the sum of their parts."""
    parts = table(s, d, "lineitem", "l_orderkey", "l_extendedprice").select(F.col("l_orderkey").alias("o_orderkey"), money("l_extendedprice").alias("x"))
    whole = table(s, d, "orders", "o_orderkey", "o_totalprice").withColumn("t", money("o_totalprice"))
    return G.sum_of_parts(parts, whole, ["o_orderkey"], "x", "t").select("o_orderkey", F.col("teile").cast("double").alias("teile"), F.col("ganzes").cast("double").alias("ganzes"))


#: Wording that no published text may have.
FORBIDDEN = {"at": "@", "pfad": r"(/Users/|/home/|C:\\)", "doppelt": "  "}
_TEXT_COLUMNS = ["quelle", "abzug", "datei", "schluessel", "title", "kurzbeschreibung", "unterlagen", "gebuehren", "dienststelle", "status"]


@query(" UNION ALL ".join(f"SELECT '{c}' spalte, '{k}' muster, count(*) n FROM quellen_zeile WHERE regexp_matches({c}, '{p}') HAVING count(*) > 0" for c in _TEXT_COLUMNS for k, p in FORBIDDEN.items()))
def gate_wording_everywhere(s: SparkSession, d: str) -> DataFrame:
    """Forbidden wording in every text column of a table."""
    return G.wording(table(s, d, "quellen_zeile"), FORBIDDEN)
