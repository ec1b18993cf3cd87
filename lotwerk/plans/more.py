"""Further operators of the inventory: catalogue scans, matching, structure of JSON, text checks, round trips through files."""

from __future__ import annotations

import math
import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwerk.functions import scalars as S
from lotwerk.functions.text import norm_name
from lotwerk.operators import relational as R
from lotwerk.plans.registry import registry
from lotwerk.session import cut, drop, shared_folder
from lotwerk.sources import files, sinks
from lotwerk.sources.tables import table

QUERIES, SQL, query = registry()

TABLES = ["article", "beilage", "data_field", "data_subfield", "documents", "dvsh_organisation", "ech_element", "form_outcome", "form_similarity", "formular_partei", "kennung", "kennung_verlauf", "lineitem", "orders", "quellen_zeile"]


@query("SELECT table_name tabelle, column_name spalte, CAST(ordinal_position AS BIGINT) nr FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")")
def schema_catalogue(s: SparkSession, d: str) -> DataFrame:
    """Tables and their columns, from the schemas without reading rows."""
    rows = [(t, c, i) for t in TABLES for i, c in enumerate(table(s, d, t).columns, 1)]
    return s.createDataFrame(rows, "tabelle string, spalte string, nr long")


@query("""WITH n AS (SELECT DISTINCT lower(name) n FROM dvsh_organisation WHERE name IS NOT NULL) SELECT a.n a, b.n b, CAST(levenshtein(a.n, b.n) AS INTEGER) d FROM n a JOIN n b ON a.n < b.n AND abs(length(a.n) - length(b.n)) <= 2 WHERE levenshtein(a.n, b.n) <= 2""")
def edit_pairs(s: SparkSession, d: str) -> DataFrame:
    """Names two edits apart at most, over their rarest grams."""
    return R.edit_pairs(table(s, d, "dvsh_organisation", "name").select(F.lower("name").alias("name")), 2)


def best_spelling_of(names: DataFrame, least: float = 0.88) -> DataFrame:
    """(name, best, ratio, n): for every name of names(name) the other one most like it by the ratio of their normalised
    forms without parentheses, ties by frequency n, then the first; least at least."""
    key = norm_name(F.regexp_replace("name", r"\s*\(.*?\)", ""))
    counted = names.filter("name is not null").groupBy("name").agg(F.count("*").alias("n")).withColumn("key", key).filter("key <> ''")
    keys = counted.select("key").distinct()
    pairs = R.ratio_pairs(keys.select(F.col("key").alias("name")), least).unionByName(keys.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("ratio")))
    other = counted.select(F.col("key").alias("a"), F.col("name").alias("best"), "n")
    met = counted.select(F.col("key").alias("b"), "name").join(pairs, "b").join(other, "a").filter("name <> best")
    best = F.min(F.struct((-F.col("ratio")).alias("r"), (-F.col("n")).alias("m"), "best", "ratio", "n"))
    return met.groupBy("name").agg(best.alias("x")).select("name", "x.best", "x.ratio", "x.n")


@query(None)
def best_spelling(s: SparkSession, d: str) -> DataFrame:
    """Every organisation's name with the other spelling most like it."""
    return best_spelling_of(table(s, d, "dvsh_organisation", "name"))


@query(None)
def greedy_match(s: SparkSession, d: str) -> DataFrame:
    """Forms matched one to one by their name sets, the most alike first."""
    from lotwerk.plans.joins import _name_sets

    return R.greedy_sets(_name_sets(s, d), 0.35, 4)


def follow_chains(links: DataFrame) -> DataFrame:
    """(kennung, stand, schritte, zyklus) of links(kennung, abgeloest_durch), of chains of any length: doubling until no row
    moves. What moves after more steps than there are rows is on a cycle or leads to one."""
    k = links.groupBy("kennung").agg(F.max("abgeloest_durch").alias("nach"))
    step = cut(k.select("kennung", F.coalesce("nach", "kennung").alias("stand"), F.col("nach").isNotNull().cast("long").alias("n"), F.col("nach").isNotNull().alias("moves")))
    for _ in range(max(1, math.ceil(math.log2(step.count() + 1)))):
        if step.filter("moves").isEmpty():
            break
        before = step
        ahead = step.select(F.col("kennung").alias("stand"), F.col("stand").alias("weiter"), F.col("n").alias("m"), F.col("moves").alias("on"))
        done = step.filter("not moves")
        on = step.filter("moves").join(ahead, "stand", "left").select("kennung", F.coalesce("weiter", "stand").alias("stand"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.coalesce("on", F.lit(False)).alias("moves"))
        step = cut(done.unionByName(on))
        drop(before)
    return step.select("kennung", "stand", F.col("n").alias("schritte"), F.col("moves").alias("zyklus"))


@query("""WITH RECURSIVE k AS (SELECT kennung, max(abgeloest_durch) nach FROM kennung GROUP BY kennung),
r AS (SELECT kennung, kennung AS stand, [kennung] weg, false kreis FROM k UNION ALL SELECT r.kennung, k.nach, list_append(weg, k.nach), list_contains(weg, k.nach) FROM r JOIN k ON k.kennung = r.stand WHERE k.nach IS NOT NULL AND NOT kreis)
SELECT kennung, CASE WHEN NOT kreis THEN stand END stand, CASE WHEN NOT kreis THEN CAST(len(weg) - 1 AS BIGINT) END schritte FROM r QUALIFY row_number() OVER (PARTITION BY kennung ORDER BY len(weg) DESC) = 1""")
def resolve_identifiers(s: SparkSession, d: str) -> DataFrame:
    """Every identifier followed to its last successor; one that runs into a cycle has none: stand and schritte are null."""
    ends = follow_chains(table(s, d, "kennung", "kennung", "abgeloest_durch"))
    return ends.select("kennung", F.when(~F.col("zyklus"), F.col("stand")).alias("stand"), F.when(~F.col("zyklus"), F.col("schritte")).alias("schritte"))


@query("""WITH o AS (SELECT unnest(CAST(unterlagen AS JSON[])) x FROM quellen_zeile WHERE unterlagen IS NOT NULL), k AS (SELECT unnest(json_keys(x)) pfad, x FROM o) SELECT pfad, count(*) n, count(DISTINCT json_type(x, '$.' || pfad)) typen FROM k GROUP BY pfad""")
def json_paths(s: SparkSession, d: str) -> DataFrame:
    """The structure of JSON documents: each path with its count and number of types, found by exploding variants."""
    q = table(s, d, "quellen_zeile", "unterlagen").filter("unterlagen is not null").select(F.try_parse_json("unterlagen").alias("v"))
    rows = s.sql("SELECT k.key AS pfad, schema_of_variant(k.value) AS typ FROM {docs}, LATERAL variant_explode(v) e, LATERAL variant_explode(e.value) k", docs=q)
    # both integer widths are one type of JSON; true and false are told apart there
    typ = F.when(F.col("typ") == "BOOLEAN", F.lit("BOOLEAN")).otherwise(F.col("typ"))
    return rows.groupBy("pfad").agg(F.count("*").alias("n"), F.count_distinct(typ).alias("typen"))


@query("WITH n AS (SELECT id, law_id, TRY_CAST(regexp_extract(article_no, '^([0-9]+)', 1) AS INTEGER) n FROM (SELECT id, min(law_id) law_id, min(article_no) article_no FROM article GROUP BY id)), m AS (SELECT *, max(n) OVER (PARTITION BY law_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) hoechst FROM n WHERE n IS NOT NULL) SELECT id, n, hoechst FROM m WHERE n < hoechst")
def monotone_scan(s: SparkSession, d: str) -> DataFrame:
    """Numbers that fall behind the highest before them in their law."""
    a = table(s, d, "article", "id", "law_id", "article_no").groupBy("id").agg(F.min("law_id").alias("law_id"), F.min("article_no").alias("no"))
    a = a.withColumn("n", F.expr("try_cast(regexp_extract(no, '^([0-9]+)', 1) as int)")).filter("n is not null")
    so_far = Window.partitionBy("law_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return a.withColumn("hoechst", F.max("n").over(so_far)).filter("n < hoechst").select("id", "n", "hoechst")


@query("SELECT form_id, count(*) n, count_if(lower(trim(coalesce(verdict, ''))) = '') offen, CASE WHEN count_if(trim(coalesce(verdict, '')) = '') = 0 THEN 'angewendet' WHEN count_if(trim(coalesce(verdict, '')) = '') = count(*) THEN 'offen' ELSE 'halb' END stand FROM (SELECT form_a form_id, verdict FROM form_similarity) GROUP BY form_id")
def half_applied(s: SparkSession, d: str) -> DataFrame:
    """Sets of judgements that are applied, pending or applied in part."""
    f = table(s, d, "form_similarity", "form_a", "verdict")
    pending = F.count_if(F.trim(F.coalesce("verdict", F.lit(""))) == "")
    g = f.groupBy(F.col("form_a").alias("form_id")).agg(F.count("*").alias("n"), pending.alias("offen"))
    return g.withColumn("stand", R.first_match([(F.col("offen") == 0, "angewendet"), (F.col("offen") == F.col("n"), "offen")], "halb"))


@query("WITH a AS (SELECT id, min(law_id) law_id FROM article GROUP BY id), l AS (SELECT DISTINCT a.law_id, b.halter FROM beilage b JOIN form_outcome o ON o.form_id = b.form_id JOIN a ON a.id = o.article_id WHERE b.halter IS NOT NULL), f AS (SELECT DISTINCT o.form_id, a.law_id FROM form_outcome o JOIN a ON a.id = o.article_id) SELECT halter, count(DISTINCT form_id) n_forms FROM l JOIN f USING (law_id) GROUP BY halter")
def fan_out(s: SparkSession, d: str) -> DataFrame:
    """A law's recipients passed on to all forms that cite the law."""
    a = table(s, d, "article", "id", "law_id").groupBy(F.col("id").alias("article_id")).agg(F.min("law_id").alias("law_id"))
    f = table(s, d, "form_outcome", "form_id", "article_id").join(a, "article_id").select("form_id", "law_id").distinct()
    holders = table(s, d, "beilage", "form_id", "halter").filter("halter is not null").distinct().join(f, "form_id").select("law_id", "halter").distinct()
    return holders.join(f, "law_id").groupBy("halter").agg(F.count_distinct("form_id").alias("n_forms"))


@query("SELECT DISTINCT unnest(regexp_extract_all(schluessel, 'sh:[a-z]+:[a-z0-9-]+')) kennung FROM documents WHERE schluessel IS NOT NULL")
def published_ids(s: SparkSession, d: str) -> DataFrame:
    """Identifiers read back from published text by their shape."""
    t = table(s, d, "documents", "schluessel").filter("schluessel is not null")
    return t.select(F.explode(F.regexp_extract_all("schluessel", F.lit("sh:[a-z]+:[a-z0-9-]+"), F.lit(0))).alias("kennung")).distinct()


@query("""WITH d(code, label) AS (VALUES ('zwingend', 'Pflicht'), ('fakultativ', 'freiwillig')) SELECT coalesce(d.label, '⟨' || obligatorium || '⟩') label, count(*) n FROM beilage LEFT JOIN d ON d.code = obligatorium WHERE obligatorium IS NOT NULL GROUP BY ALL""")
def code_labels(s: SparkSession, d: str) -> DataFrame:
    """Codes shown by their labels, unknown ones in brackets."""
    dim = s.createDataFrame([("zwingend", "Pflicht"), ("fakultativ", "freiwillig")], "obligatorium string, label string")
    b = table(s, d, "beilage", "obligatorium").filter("obligatorium is not null").join(F.broadcast(dim), "obligatorium", "left")
    return b.groupBy(F.coalesce("label", F.concat(F.lit("⟨"), "obligatorium", F.lit("⟩"))).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END anriss, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+amt')))[1:3] aemter FROM documents WHERE text <> ''")
def shortened(s: SparkSession, d: str) -> DataFrame:
    """Display forms: a text's beginning with an ellipsis, a list's first three distinct entries."""
    t = table(s, d, "documents", "doc_id", "text").filter("text <> ''")
    teaser = F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 39), F.lit("…"))).otherwise(F.col("text"))
    return t.select("doc_id", teaser.alias("anriss"), F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+amt"), F.lit(0)))), 1, 3).alias("aemter"))


@query("SELECT id, contains(trim(regexp_replace(regexp_replace(t, '-\n', '', 'g'), '\\s+', ' ', 'g')), 'Unterlagen online') beleg FROM (SELECT schluessel id, arg_max(kurzbeschreibung, (abzug, gelesen_am, kurzbeschreibung)) t FROM quellen_zeile WHERE kurzbeschreibung IS NOT NULL GROUP BY schluessel)")
def quote_contained(s: SparkSession, d: str) -> DataFrame:
    """Whether a quote stands in a text, white space and hyphenation aside."""
    q = table(s, d, "quellen_zeile", "schluessel", "kurzbeschreibung", "abzug", "gelesen_am").filter("kurzbeschreibung is not null")
    t = q.groupBy(F.col("schluessel").alias("id")).agg(F.max(F.struct("abzug", "gelesen_am", "kurzbeschreibung")).alias("m"))
    return t.select("id", S.flat_text(F.col("m.kurzbeschreibung")).contains("Unterlagen online").alias("beleg"))


@query("WITH w AS (SELECT item_id, regexp_replace(lower(text), '[^a-zäöüàâéèêçôî]', '', 'g') t FROM pruefaufgabe), x AS (SELECT item_id, t, unnest(range(0, 4)) k FROM w) SELECT item_id, count(*) n, count_if(contains(t, reverse(substr(reverse(t), k * 10 + 1, 8)))) hits FROM x GROUP BY item_id")
def letter_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows of letters only, and how many of them a text holds."""
    w = table(s, d, "pruefaufgabe", "item_id", "text").select("item_id", F.regexp_replace(F.lower("text"), "[^a-zäöüàâéèêçôî]", "").alias("t"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.reverse(F.substring(F.reverse("t"), k * 10 + 1, F.lit(8))))
    return w.select("item_id", F.size(parts).cast("long").alias("n"), F.size(F.filter(parts, lambda p: F.contains("t", p))).cast("long").alias("hits"))


#: Letters of a window of text evidence, and windows of a text at most.
LETTERS, WINDOWS = 40, 6


def letters_only(text: Column) -> Column:
    """The letters of a text, lower-cased and composed, ß as ss."""
    t = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    for x in "äöüéèàâêîôûç":
        t = F.replace(t, F.lit(unicodedata.normalize("NFD", x)), F.lit(x))
    return F.regexp_replace(t, r"[a-z]\p{M}+|[^a-zäöüéèàâêîôûç]", "")


def evidence(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, hits, gefunden, vollstaendig of pairs(*keys, excerpt, other): up to WINDOWS windows of LETTERS letters spread over
    the excerpt (all of it when shorter), and how many of them the other text holds; excerpts without letters have none."""
    e = F.col("e")
    step = F.greatest(F.lit(LETTERS), F.floor((F.length(e) - LETTERS) / 5)).cast("int")
    spread = F.transform(F.slice(F.sequence(F.lit(0), F.length(e) - LETTERS, step), 1, WINDOWS), lambda i: F.substring(e, i + 1, F.lit(LETTERS)))
    t = pairs.select(*keys, letters_only(F.col("excerpt")).alias("e"), letters_only(F.col("other")).alias("v")).filter("e <> ''")
    t = t.withColumn("w", F.when(F.length(e) > LETTERS, spread).otherwise(F.array(e)))
    t = t.select(*keys, F.size("w").cast("long").alias("n"), F.size(F.filter("w", lambda x: F.contains("v", x))).cast("long").alias("hits"))
    return t.withColumns({"gefunden": F.col("hits") > 0, "vollstaendig": F.col("hits") == F.col("n")})


@query("""WITH h AS (SELECT quelle, schluessel, abzug, arg_max(kurzbeschreibung, (gelesen_am, kurzbeschreibung)) t FROM quellen_zeile WHERE kurzbeschreibung IS NOT NULL GROUP BY ALL),
l AS (SELECT quelle, schluessel, abzug, regexp_replace(replace(nfc_normalize(lower(t)), 'ß', 'ss'), '[^a-zäöüéèàâêîôûç]', '', 'g') e FROM h), p AS (SELECT *, lag(e) OVER (PARTITION BY quelle, schluessel ORDER BY abzug) v FROM l),
w AS (SELECT *, CASE WHEN length(e) <= 40 THEN [e] ELSE list_transform(range(0, length(e) - 39, greatest(40, (length(e) - 40) // 5))[1:6], lambda i: substr(e, i + 1, 40)) END w FROM p WHERE v IS NOT NULL AND e <> ''),
x AS (SELECT quelle, schluessel, abzug, len(w) n, len(list_filter(w, lambda y: contains(v, y))) hits FROM w) SELECT *, hits > 0 gefunden, hits = n vollstaendig FROM x""")
def letter_evidence(s: SparkSession, d: str) -> DataFrame:
    """Each harvest's short description searched, window by window, in the one of the harvest before."""
    q = table(s, d, "quellen_zeile", "quelle", "schluessel", "abzug", "gelesen_am", "kurzbeschreibung").filter("kurzbeschreibung is not null")
    h = q.groupBy("quelle", "schluessel", "abzug").agg(F.max(F.struct("gelesen_am", "kurzbeschreibung")).getField("kurzbeschreibung").alias("excerpt"))
    before = F.lag("excerpt").over(Window.partitionBy("quelle", "schluessel").orderBy("abzug"))
    return evidence(h.withColumn("other", before).filter("other is not null"), ["quelle", "schluessel", "abzug"])


@query("SELECT DISTINCT ech_standard_code code, 'eCH-' || lpad(regexp_extract(ech_standard_code, '([0-9]+)', 1), 4, '0') kanon, ech_standard_code = 'eCH-' || lpad(regexp_extract(ech_standard_code, '([0-9]+)', 1), 4, '0') gleich FROM data_field WHERE ech_standard_code IS NOT NULL")
def code_canonical(s: SparkSession, d: str) -> DataFrame:
    """Standard codes in their canonical spelling."""
    c = table(s, d, "data_field", "ech_standard_code").filter("ech_standard_code is not null").distinct()
    canon = S.standard_code(F.col("ech_standard_code"))
    return c.select(F.col("ech_standard_code").alias("code"), canon.alias("kanon"), (canon == F.col("ech_standard_code")).alias("gleich"))


@query("SELECT id, row_number() OVER (ORDER BY trim(regexp_replace(strip_accents(lower(n)), '[^a-z0-9]+', ' ', 'g')), n, id) platz FROM (SELECT kanon_id id, bezeichnung n FROM kanon_begriff)")
def locale_order(s: SparkSession, d: str) -> DataFrame:
    """The fixed list in an order that ignores accents and case."""
    k = table(s, d, "kanon_begriff", "kanon_id", "bezeichnung").withColumnRenamed("kanon_id", "id")
    return k.select("id", F.row_number().over(Window.orderBy(norm_name(F.col("bezeichnung")), "bezeichnung", "id")).cast("long").alias("platz"))


@query("SELECT form_id, array_to_string(list_sort(list(DISTINCT rolle)), ',') rollen, count(*) n FROM (SELECT DISTINCT form_id, partei_nr, rolle, entitaet, bezeichnung FROM formular_partei) GROUP BY form_id")
def distinct_rows(s: SparkSession, d: str) -> DataFrame:
    """Exact duplicates dropped on their key columns, then distinct values gathered in order."""
    p = table(s, d, "formular_partei", "form_id", "partei_nr", "rolle", "entitaet", "bezeichnung").dropDuplicates()
    return p.groupBy("form_id").agg(F.array_join(F.array_distinct(F.sort_array(F.collect_set("rolle"))), ",").alias("rollen"), F.count("*").alias("n"))


@query("SELECT o.form_id, p.partei_nr, o.rolle a, p.rolle b FROM (SELECT form_id, partei_nr, min(rolle) rolle FROM formular_partei GROUP BY ALL) o JOIN (SELECT form_id, partei_nr, max(rolle) rolle FROM formular_partei GROUP BY ALL) p ON p.form_id = o.form_id AND p.partei_nr = o.partei_nr + 1")
def composite_join(s: SparkSession, d: str) -> DataFrame:
    """A join on two columns: each party beside the next of its form."""
    p = table(s, d, "formular_partei", "form_id", "partei_nr", "rolle")
    a = p.groupBy("form_id", (F.col("partei_nr") + 1).alias("partei_nr")).agg(F.min("rolle").alias("a"))
    return a.join(p.groupBy("form_id", "partei_nr").agg(F.max("rolle").alias("b")), ["form_id", "partei_nr"]).select("form_id", "partei_nr", "a", "b")


@query("WITH c AS (SELECT source, unnest([length(regexp_replace(text, '[^a-zA-Z]', '', 'g')), length(regexp_replace(text, '[^0-9]', '', 'g')), length(regexp_replace(text, '[^ ]', '', 'g'))]) n, unnest(['buchstabe', 'ziffer', 'blank']) art FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), g AS (SELECT source, art, CAST(sum(n) AS BIGINT) n FROM c GROUP BY ALL) SELECT source, art, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, art) platz FROM g")
def character_profile(s: SparkSession, d: str) -> DataFrame:
    """Characters by class for every source, the dominant first."""
    t = table(s, d, "documents", "source", "text").filter("text is not null and source is not null")
    count = lambda p: F.length(F.regexp_replace("text", p, ""))
    g = t.groupBy("source").agg(F.sum(count("[^a-zA-Z]")).alias("buchstabe"), F.sum(count("[^0-9]")).alias("ziffer"), F.sum(count("[^ ]")).alias("blank"))
    rows = g.unpivot("source", ["buchstabe", "ziffer", "blank"], "art", "n")
    return rows.withColumn("platz", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "art")).cast("long"))


@query("WITH v AS (SELECT law_id, last_checked, count(*) n FROM (SELECT id, min(law_id) law_id, min(last_checked) last_checked FROM article GROUP BY id) GROUP BY ALL), m AS (SELECT law_id, max(last_checked) FILTER (last_checked <> 'UNVERIFIED') neu, sum(n) total, coalesce(sum(n) FILTER (last_checked = 'UNVERIFIED'), 0) offen FROM v GROUP BY law_id) SELECT law_id, CASE WHEN neu IS NULL THEN 'stand_unbekannt' WHEN offen = 0 THEN 'aktuell' ELSE 'unklar' END stand, neu, CAST(total AS BIGINT) n FROM m")
def edition_check(s: SparkSession, d: str) -> DataFrame:
    """Each law's newest check and whether it covers all its articles."""
    a = table(s, d, "article", "id", "law_id", "last_checked").groupBy("id").agg(F.min("law_id").alias("law_id"), F.min("last_checked").alias("c"))
    g = a.groupBy("law_id").agg(F.max(F.when(F.col("c") != "UNVERIFIED", F.col("c"))).alias("neu"), F.count_if(F.col("c") == "UNVERIFIED").alias("offen"), F.count("*").alias("n"))
    return g.select("law_id", R.first_match([(F.col("neu").isNull(), "stand_unbekannt"), (F.col("offen") == 0, "aktuell")], "unklar").alias("stand"), "neu", "n")


def _scratch(s: SparkSession) -> str:
    return f"{shared_folder(s)}/lotwerk_files/{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, props FROM events")
def json_lines_round_trip(s: SparkSession, d: str) -> DataFrame:
    """A table written as JSON lines and read again by its schema."""
    e = table(s, d, "events", "event_id", "user_id", "event_type", "props")
    sinks.json_lines(e, path := _scratch(s))
    return files.json_lines(s, path, e.schema)


@query("SELECT id, form_id, bezeichnung, bedingung FROM beilage")
def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """A table written as quoted, semicolon-separated text and read again."""
    b = table(s, d, "beilage", "id", "form_id", "bezeichnung", "bedingung")
    sinks.csv_export(b, path := _scratch(s))
    return s.read.schema(b.schema).option("sep", ";").option("header", True).option("multiLine", True).option("escape", "\\").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


@query("SELECT 'erst' lauf, true geschrieben UNION ALL SELECT 'gleich', false UNION ALL SELECT 'anders', true")
def publish_if_changed(s: SparkSession, d: str) -> DataFrame:
    """A table published, published again unchanged, and changed."""
    t = table(s, d, "supplier")
    path = _scratch(s)
    runs = [("erst", sinks.publish(t, path)), ("gleich", sinks.publish(t.orderBy("s_suppkey"), path)), ("anders", sinks.publish(t.withColumn("s_acctbal", F.col("s_acctbal") + 1), path))]
    return s.createDataFrame(runs, "lauf string, geschrieben boolean")


@query("SELECT form_id, count(*) n, min(ord) erste FROM data_field WHERE geloescht_am IS NULL GROUP BY form_id")
def points_by_form(s: SparkSession, d: str) -> DataFrame:
    """The export shape {form: [points]}, given by its sizes and first entries."""
    m = sinks.nested_map(table(s, d, "data_field", "form_id", "ord", "id", "name", "geloescht_am").filter("geloescht_am is null").drop("geloescht_am"), "form_id")
    return m.select("form_id", F.size("points").cast("long").alias("n"), F.get("points", F.lit(0))["ord"].alias("erste"))


@query("SELECT coalesce(CAST(form_id AS VARCHAR), 'FEHLT') form_id, coalesce(rechtsmittel_art, 'FEHLT') rechtsmittel_art, coalesce(CAST(rechtsmittel_frist_tage AS VARCHAR), 'FEHLT') rechtsmittel_frist_tage FROM form_outcome")
def gaps_marked(s: SparkSession, d: str) -> DataFrame:
    """An extract in which gaps are written out."""
    return sinks.gaps_marked(table(s, d, "form_outcome", "form_id", "rechtsmittel_art", "rechtsmittel_frist_tage"))


@query("SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)\\b.*?</(script|style)\\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) sichtbar FROM documents WHERE contains(text, '<')")
def html_visible_text(s: SparkSession, d: str) -> DataFrame:
    """The visible text of marked-up documents."""
    t = table(s, d, "documents", "doc_id", "text").filter(F.col("text").contains("<"))
    return t.select("doc_id", S.visible_text(F.col("text")).alias("sichtbar"))


@query("SELECT doc_id, count(*) n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) z FROM documents WHERE source = 'gesetz') WHERE regexp_matches(z, '^(Art\\.|§) [0-9]+') GROUP BY doc_id")
def law_headings(s: SparkSession, d: str) -> DataFrame:
    """Article headings found line by line in the law texts."""
    t = table(s, d, "documents", "doc_id", "text", "source").filter("source = 'gesetz'").select("doc_id", F.explode(F.split("text", "\n")).alias("z"))
    return t.filter(F.col("z").rlike(r"^(Art\.|§) [0-9]+")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT DISTINCT form_id id, lower(trim(name)) token FROM data_field WHERE geloescht_am IS NULL AND trim(name) <> ''), c AS (SELECT id, count(*) n FROM m GROUP BY id HAVING count(*) >= 4),
o AS (SELECT x.id a, y.id b, count(*) o FROM m x JOIN m y ON x.token = y.token AND x.id < y.id GROUP BY ALL), p AS (SELECT a, b FROM o JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE 20 * o >= 7 * (ca.n + cb.n - o)),
v AS (SELECT least(form_a, form_b) a, greatest(form_a, form_b) b, min(lower(trim(verdict))) verdict FROM form_similarity WHERE form_a <> form_b AND verdict IS NOT NULL GROUP BY ALL)
SELECT p.a, p.b, v.verdict, v.verdict IS NOT NULL behalten FROM p LEFT JOIN v ON v.a = p.a AND v.b = p.b""")
def carry_over(s: SparkSession, d: str) -> DataFrame:
    """A table rebuilt from today's data that keeps what was judged by hand before, by key."""
    from lotwerk.plans.joins import _name_sets

    old = table(s, d, "form_similarity", "form_a", "form_b", "verdict").filter("form_a <> form_b and verdict is not null")
    old = old.groupBy(F.least("form_a", "form_b").alias("a"), F.greatest("form_a", "form_b").alias("b")).agg(F.min(F.lower(F.trim("verdict"))).alias("verdict"))
    return R.jaccard_pairs_with(_name_sets(s, d), 0.35, 4, old).withColumn("behalten", F.col("verdict").isNotNull())


@query("""WITH r(status, rang) AS (SELECT status, row_number() OVER (ORDER BY status) FROM (SELECT DISTINCT status FROM quellen_zeile WHERE status IS NOT NULL)), n AS (SELECT quelle, max(abzug) abzug FROM quellen_zeile GROUP BY quelle)
SELECT z.dienststelle, arg_min(z.status, rang) stand, count(DISTINCT z.schluessel) n, array_to_string(list_sort(list(DISTINCT z.quelle)), ',') quellen FROM quellen_zeile z JOIN n ON n.quelle = z.quelle AND n.abzug = z.abzug JOIN r ON r.status = z.status GROUP BY z.dienststelle""")
def state_precedence(s: SparkSession, d: str) -> DataFrame:
    """Of several states seen in the newest harvests the first by an order of states, with all sources."""
    z = table(s, d, "quellen_zeile", "quelle", "abzug", "schluessel", "dienststelle", "status")
    newest = z.groupBy("quelle").agg(F.max("abzug").alias("abzug"))
    rank = z.filter("status is not null").select("status").distinct().withColumn("rang", F.row_number().over(Window.orderBy("status")))
    cur = z.join(F.broadcast(newest), ["quelle", "abzug"]).join(rank, "status")
    best = F.min(F.struct("rang", "status"))
    return cur.groupBy("dienststelle").agg(best.getField("status").alias("stand"), F.count_distinct("schluessel").alias("n"), F.array_join(F.sort_array(F.collect_set("quelle")), ",").alias("quellen"))
