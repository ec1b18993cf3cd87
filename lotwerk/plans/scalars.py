"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwerk.functions import scalars as S
from lotwerk.functions.text import norm_name
from lotwerk.operators import relational as R
from lotwerk.plans.registry import registry
from lotwerk.sources.tables import table

QUERIES, SQL, query = registry()

_LABEL = r"lower(trim(regexp_replace(regexp_replace({}, '[\s:*]+$', ''), '\s+', ' ', 'g')))"
_SPELT = r"trim(regexp_replace(replace(replace(replace(replace(lower({}), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '\s+', ' ', 'g'))"


@query(f"SELECT n, count(*) k FROM (SELECT {_LABEL.format('name')} n FROM data_field WHERE name IS NOT NULL) GROUP BY n")
def norm_label(s: SparkSession, d: str) -> DataFrame:
    """Labels in their normal form."""
    f = table(s, d, "data_field", "name").filter("name is not null")
    return f.groupBy(S.norm_label(F.col("name")).alias("n")).agg(F.count("*").alias("k"))


@query("SELECT n, count(*) k FROM (SELECT trim(regexp_replace(strip_accents(lower(bezeichnung)), '[^a-z0-9]+', ' ', 'g')) n FROM beilage WHERE bezeichnung IS NOT NULL) GROUP BY n")
def fold_accents(s: SparkSession, d: str) -> DataFrame:
    """Names without accents and punctuation."""
    return table(s, d, "beilage", "bezeichnung").filter("bezeichnung is not null").groupBy(norm_name(F.col("bezeichnung")).alias("n")).agg(F.count("*").alias("k"))


@query(f"SELECT id, substr(regexp_replace(regexp_replace({_SPELT.format('name')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) slug FROM (SELECT id, min(name) AS name FROM dvsh_organisation GROUP BY id)")
def slug(s: SparkSession, d: str) -> DataFrame:
    """Names as slugs."""
    return table(s, d, "dvsh_organisation", "id", "name").groupBy("id").agg(S.slug(F.min("name")).alias("slug"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace({_SPELT.format('heading')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 3))), ' ') words FROM (SELECT id, min(heading) heading FROM article GROUP BY id) WHERE heading IS NOT NULL")
def tokens(s: SparkSession, d: str) -> DataFrame:
    """Headings as sets of their longer words."""
    a = table(s, d, "article", "id", "heading").groupBy("id").agg(F.min("heading").alias("h")).filter("h is not null")
    return a.select("id", F.array_join(S.tokens(F.col("h")), " ").alias("words"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, 'Art\\. [0-9]+'))), '|') cites FROM documents WHERE regexp_matches(text, 'Art\\. [0-9]')")
def regex_set(s: SparkSession, d: str) -> DataFrame:
    """All citations of a text as a sorted set."""
    t = table(s, d, "documents", "doc_id", "text").filter(F.col("text").rlike(r"Art\. [0-9]"))
    return t.select("doc_id", S.matches_set(F.col("text"), r"Art\. [0-9]+").alias("cites"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) k, count(*) n FROM events GROUP BY ALL")
def json_props(s: SparkSession, d: str) -> DataFrame:
    """A JSON column read by a declared schema and counted."""
    e = table(s, d, "events", "event_type", "props").select("event_type", F.from_json("props", "k bigint").getField("k").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT kanon_id, len(a) n_names, a[1] first FROM (SELECT kanon_id, coalesce(CAST(auch AS VARCHAR[]), []) a FROM kanon_begriff)")
def json_arrays(s: SparkSession, d: str) -> DataFrame:
    """JSON lists decoded, null as the empty list."""
    k = table(s, d, "kanon_begriff", "kanon_id", "auch").select("kanon_id", S.json_list(F.col("auch")).alias("a"))
    return k.select("kanon_id", F.size("a").cast("long").alias("n_names"), F.get("a", F.lit(0)).alias("first"))


@query("""SELECT quelle, abzug, schluessel, CAST(len(CAST(unterlagen AS JSON[])) AS BIGINT) n, array_to_string(list_transform(CAST(unterlagen AS JSON[]), lambda x: json_extract_string(x, '$.label')), '|') labels FROM (SELECT quelle, abzug, schluessel, arg_max(unterlagen, (gelesen_am, unterlagen)) unterlagen FROM quellen_zeile WHERE unterlagen IS NOT NULL GROUP BY ALL)""")
def json_objects(s: SparkSession, d: str) -> DataFrame:
    """Lists of JSON objects in any spelling, decoded."""
    q = table(s, d, "quellen_zeile", "quelle", "abzug", "schluessel", "unterlagen", "gelesen_am").filter("unterlagen is not null")
    q = q.groupBy("quelle", "abzug", "schluessel").agg(F.max(F.struct("gelesen_am", "unterlagen")).alias("m"))
    u = F.from_json("m.unterlagen", "array<struct<label:string>>")
    return q.select("quelle", "abzug", "schluessel", F.size(u).cast("long").alias("n"), F.array_join(u.getField("label"), "|").alias("labels"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 42 DAY due, o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) + 42 < DATE '1998-01-01' overdue, CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 3 * 30 ELSE 2 * 365 END AS INTEGER) deletion FROM orders")
def date_due(s: SparkSession, d: str) -> DataFrame:
    """Dates due, overdue and to be deleted."""
    o = table(s, d, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    deletion = S.plus_period(F.to_date("o_orderdate"), F.when(urgent, 3).otherwise(2), F.when(urgent, "monate").otherwise("jahre"))
    overdue = (F.col("o_orderstatus") == "O") & (F.date_add(F.to_date("o_orderdate"), 42) < F.lit("1998-01-01").cast("date"))
    return o.select("o_orderkey", F.expr("o_orderdate + interval 42 day").alias("due"), overdue.alias("overdue"), deletion.alias("deletion"))


@query("WITH d AS (SELECT id, datum FROM kennung_verlauf UNION ALL SELECT -id, CAST(CAST(substr(datum, 9, 2) AS INTEGER) AS VARCHAR) || '. März ' || substr(datum, 1, 4) FROM kennung_verlauf WHERE length(datum) = 10 AND datum NOT LIKE '%.%')\nSELECT id, coalesce(TRY_CAST(try_strptime(datum, '%d.%m.%Y') AS DATE), TRY_CAST(try_strptime(datum, '%Y-%m-%d') AS DATE), TRY_CAST(try_strptime(replace(datum, '. März ', '.3.'), '%d.%m.%Y') AS DATE)) tag FROM d")
def parse_dates(s: SparkSession, d: str) -> DataFrame:
    """Dates in three spellings, null where there is no such day or another spelling."""
    v = table(s, d, "kennung_verlauf", "id", "datum")
    worded = v.filter("length(datum) = 10 and not contains(datum, '.')").select((-F.col("id")).alias("id"), F.concat(F.substring("datum", 9, 2).cast("int").cast("string"), F.lit(". März "), F.substring("datum", 1, 4)).alias("datum"))
    return v.unionByName(worded).select("id", S.german_date(F.col("datum")).alias("tag"))


@query("SELECT c_custkey, CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(lpad(CAST(c_custkey AS VARCHAR), 12, '0')[i] AS INTEGER) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS BIGINT) digit FROM customer")
def check_digit(s: SparkSession, d: str) -> DataFrame:
    """Check digits of twelve-digit numbers."""
    return table(s, d, "customer", "c_custkey").select("c_custkey", S.check_digit(F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("digit"))


@query("SELECT id, substr(sha256(CAST(id AS VARCHAR) || chr(31) || coalesce(slug, '') || chr(31) || coalesce(contact_email, '')), 1, 12) fp FROM (SELECT DISTINCT id, slug, contact_email FROM dvsh_organisation)")
def fingerprint(s: SparkSession, d: str) -> DataFrame:
    """Short fingerprints of rows."""
    o = table(s, d, "dvsh_organisation", "id", "slug", "contact_email").distinct()
    return o.select("id", S.fingerprint(F.col("id"), F.col("slug"), F.col("contact_email")).alias("fp"))


@query("WITH n AS (SELECT o_orderpriority p, count(*) n FROM orders GROUP BY ALL) SELECT p, CAST(floor((200 * n + w) / (2 * w)) AS BIGINT) pct, replace(format('{:,}', n), ',', '''') txt FROM n, (SELECT sum(n) w FROM n)")
def percent_text(s: SparkSession, d: str) -> DataFrame:
    """Shares rounded half up and counts with separators."""
    o = table(s, d, "orders", "o_orderpriority")
    n = o.groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    w = o.agg(F.count("*").alias("w")).withColumn("one", F.lit(1))
    return n.join(F.broadcast(w), "one").select("p", S.half_up_percent(F.col("n"), F.col("w")).alias("pct"), S.thousands(F.col("n")).alias("txt"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+')) > 0 mail, regexp_matches(text, 'https?://') url, CAST(len(regexp_extract_all(text, '[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}')) AS BIGINT) n_dates, regexp_matches(text, 'Seite [0-9]+ von [0-9]+') page FROM documents WHERE text IS NOT NULL")
def text_detectors(s: SparkSession, d: str) -> DataFrame:
    """Mail addresses, links, dates and page numbers in texts."""
    t = table(s, d, "documents", "doc_id", "text").filter("text is not null")
    return t.select(
        "doc_id", F.col("text").rlike("[A-Za-z0-9._-]+@[A-Za-z0-9.-]+").alias("mail"), F.col("text").rlike("https?://").alias("url"),
        F.regexp_count("text", F.lit(r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}")).cast("long").alias("n_dates"), F.col("text").rlike("Seite [0-9]+ von [0-9]+").alias("page"),
    )


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) r, count(*) OVER (PARTITION BY o_orderpriority) n FROM orders) WHERE r <= greatest(1, n // 100)")
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """A sampling operator: of every stratum the first hundredth in hash order, one at least."""
    o = table(s, d, "orders", "o_orderpriority", "o_orderkey")
    size = o.groupBy("o_orderpriority").agg(F.greatest(F.lit(1), F.expr("count(*) div 100")).alias("k"))
    return R.first_in_hash_order(o, "o_orderpriority", "o_orderkey", size)
