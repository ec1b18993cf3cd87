"""Composite operators of the catalogue, and the reader's queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwerk.operators import relational as R
from lotwerk.plans.joins import units
from lotwerk.plans.registry import registry
from lotwerk.sources.tables import table

QUERIES, SQL, query = registry()

_E = "e AS (SELECT id, min(standard) std, count(geloescht_am) > 0 weg FROM ech_element GROUP BY id)"
_STATE = "CASE WHEN e.id IS NOT NULL AND NOT e.weg THEN 'element' WHEN e.id IS NOT NULL THEN 'element_alt' WHEN f.el IS NOT NULL THEN 'element_fehlt' WHEN f.std IS NOT NULL THEN 'element_offen' ELSE 'ungeprueft' END"
_F = "f AS (SELECT id, min(form_id) form_id, min(ech_element_id) el, min(ech_standard_code) std, min(required) req, max(sensitive) sens, min(data_type) typ, min(subjekt) subj FROM data_field WHERE geloescht_am IS NULL GROUP BY id)"


def current_fields(s: SparkSession, d: str) -> DataFrame:
    """One row a field that is not withdrawn."""
    f = table(s, d, "data_field", "id", "form_id", "ech_element_id", "ech_standard_code", "required", "sensitive", "data_type", "subjekt", "geloescht_am").filter("geloescht_am is null")
    return f.groupBy("id").agg(
        F.min("form_id").alias("form_id"), F.min("ech_element_id").alias("el"), F.min("ech_standard_code").alias("std"), F.min("required").alias("req"),
        F.max("sensitive").alias("sens"), F.min("data_type").alias("typ"), F.min("subjekt").alias("subj"),
    )


def element_states(s: SparkSession, d: str) -> DataFrame:
    """current_fields() with state, the first rule of the decision table that holds."""
    e = table(s, d, "ech_element", "id", "geloescht_am").groupBy(F.col("id").alias("eid")).agg(F.max(F.col("geloescht_am").isNotNull()).alias("weg"))
    rules = [
        (F.col("eid").isNotNull() & ~F.col("weg"), "element"), (F.col("eid").isNotNull(), "element_alt"),
        (F.col("el").isNotNull(), "element_fehlt"), (F.col("std").isNotNull(), "element_offen"),
    ]
    return current_fields(s, d).join(e, F.col("el") == F.col("eid"), "left").withColumn("state", R.first_match(rules, "ungeprueft"))


@query(f"WITH {_E}, {_F} SELECT f.id, {_STATE} state FROM f LEFT JOIN e ON e.id = f.el")
def decision_table(s: SparkSession, d: str) -> DataFrame:
    """Ordered rules: each field in exactly one state."""
    return element_states(s, d).select("id", "state")


@query(f"""WITH {_E}, {_F}, z AS (SELECT f.form_id, {_STATE} state FROM f LEFT JOIN e ON e.id = f.el), t(state, tone, tier) AS (VALUES ('element', 'ok', 0), ('element_alt', 'act', 1), ('element_fehlt', 'act', 1), ('element_offen', 'open', 2), ('ungeprueft', 'open', 3))
SELECT z.form_id, count(*) n, count_if(tone = 'ok') ok, count_if(tone = 'act') act, count_if(tone = 'open') open, max(tier) worst, CAST(round_even(100.0 * count_if(tone = 'ok') / count(*), 0) AS BIGINT) pct FROM z JOIN t ON t.state = z.state GROUP BY z.form_id""")
def tone_rollup(s: SparkSession, d: str) -> DataFrame:
    """States turned into tones by a dimension table, rolled up per form."""
    dim = s.createDataFrame([("element", "ok", 0), ("element_alt", "act", 1), ("element_fehlt", "act", 1), ("element_offen", "open", 2), ("ungeprueft", "open", 3)], "state string, tone string, tier int")
    z = element_states(s, d).join(F.broadcast(dim), "state")
    of = lambda tone: F.count_if(F.col("tone") == tone)
    return z.groupBy("form_id").agg(F.count("*").alias("n"), of("ok").alias("ok"), of("act").alias("act"), of("open").alias("open"), F.max("tier").alias("worst"), F.bround(100.0 * of("ok") / F.count("*"), 0).cast("long").alias("pct"))


@query(f"""WITH {_F}, g AS (SELECT form_id, count(*) n, count(el) n_el, count_if(req = 1) n_req, count(sens) n_sens FROM f GROUP BY form_id), b AS (SELECT form_id, count(DISTINCT id) n_b FROM beilage GROUP BY form_id), o AS (SELECT form_id, count(article_id) > 0 cited FROM form_outcome GROUP BY form_id),
r AS (SELECT g.form_id, unnest(list_filter([CASE WHEN o.form_id IS NULL THEN 'ohne_ergebnis' END, CASE WHEN o.form_id IS NOT NULL AND NOT o.cited THEN 'ohne_artikel' END, CASE WHEN n_sens >= 3 OR (2 * n_sens >= n AND n_sens >= 1) THEN 'folgen_pruefen' END, CASE WHEN n_el * 2 < n THEN 'wenig_standard' END, CASE WHEN coalesce(n_b, 0) > 5 THEN 'viele_beilagen' END, CASE WHEN n_req = n THEN 'alles_pflicht' END], lambda x: x IS NOT NULL)) aufgabe
FROM g LEFT JOIN b ON b.form_id = g.form_id LEFT JOIN o ON o.form_id = g.form_id) SELECT aufgabe, count(*) n, min(form_id) erstes FROM r GROUP BY aufgabe""")
def worklist(s: SparkSession, d: str) -> DataFrame:
    """All rules that hold of a form, in one pass, as a list of tasks."""
    g = current_fields(s, d).groupBy("form_id").agg(F.count("*").alias("n"), F.count("el").alias("n_el"), F.count_if(F.col("req") == 1).alias("n_req"), F.count("sens").alias("n_sens"))
    b = table(s, d, "beilage", "form_id", "id").groupBy("form_id").agg(F.count_distinct("id").alias("n_b"))
    o = table(s, d, "form_outcome", "form_id", "article_id").groupBy("form_id").agg((F.count("article_id") > 0).alias("cited"))
    j = g.join(b, "form_id", "left").join(o, "form_id", "left")
    c = F.col
    rules = [
        (c("cited").isNull(), "ohne_ergebnis"), (~c("cited"), "ohne_artikel"), ((c("n_sens") >= 3) | ((2 * c("n_sens") >= c("n")) & (c("n_sens") >= 1)), "folgen_pruefen"),
        (c("n_el") * 2 < c("n"), "wenig_standard"), (F.coalesce("n_b", F.lit(0)) > 5, "viele_beilagen"), (c("n_req") == c("n"), "alles_pflicht"),
    ]
    return j.select("form_id", F.explode(R.all_matches(rules)).alias("aufgabe")).groupBy("aufgabe").agg(F.count("*").alias("n"), F.min("form_id").alias("erstes"))


@query(f"""WITH {_F}, k AS (SELECT el, subj, form_id, count(*) mine, count_if(req = 1) yes FROM f WHERE el IS NOT NULL AND subj IS NOT NULL GROUP BY ALL), a AS (SELECT *, sum(mine) OVER w - mine oth, sum(yes) OVER w - yes oy, count(*) OVER w - 1 forms FROM k WINDOW w AS (PARTITION BY el, subj))
SELECT el, subj, form_id, CASE WHEN 3 * oy >= 2 * oth AND yes = 0 THEN 'freiwillig_statt_pflicht' WHEN 3 * (oth - oy) >= 2 * oth AND yes = mine THEN 'pflicht_statt_freiwillig' WHEN 3 * oy < 2 * oth AND 3 * (oth - oy) < 2 * oth THEN 'uneinheitlich' END befund FROM a
WHERE forms >= 2 AND oth >= 2 AND befund IS NOT NULL""")
def requirement_divergence(s: SparkSession, d: str) -> DataFrame:
    """Forms that ask a datum otherwise than two thirds of all other forms do, exact in integers."""
    f = current_fields(s, d).filter("el is not null and subj is not null")
    o = R.leave_one_out(f, ["el", "subj"], "form_id", F.coalesce(F.col("req") == 1, F.lit(False)))
    forms = o.groupBy("el", "subj").agg((F.count("*") - 1).alias("forms"))
    c = F.col
    yes, no = 3 * c("others_yes") >= 2 * c("others"), 3 * (c("others") - c("others_yes")) >= 2 * c("others")
    rules = [(yes & (c("mine_yes") == 0), "freiwillig_statt_pflicht"), (no & (c("mine_yes") == c("mine")), "pflicht_statt_freiwillig"), (~yes & ~no, "uneinheitlich")]
    return o.join(forms, ["el", "subj"]).filter("forms >= 2 and others >= 2").select("el", "subj", "form_id", R.first_match(rules).alias("befund")).filter("befund is not null")


@query(f"""WITH {_F}, c AS (SELECT el, typ, count(*) n FROM f WHERE el IS NOT NULL AND typ IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY el) t, row_number() OVER (PARTITION BY el ORDER BY n DESC, typ) r FROM c)
SELECT f.id, f.typ, m.typ ueblich FROM f JOIN m ON m.el = f.el AND m.r = 1 WHERE m.n >= 2 AND 3 * m.n >= 2 * m.t AND f.typ <> m.typ""")
def shape_divergence(s: SparkSession, d: str) -> DataFrame:
    """Fields of another shape than two thirds of those with the same element."""
    f = current_fields(s, d).filter("el is not null and typ is not null")
    top = R.majority(f, ["el"], "typ", (2, 3)).filter("n >= 2").select("el", F.col("typ").alias("ueblich"))
    return f.join(top, "el").filter("typ <> ueblich").select("id", "typ", "ueblich")


@query(f"""WITH {_F}, c AS (SELECT std, subj, el, count(*) n FROM f WHERE el IS NOT NULL GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY std, subj) t, row_number() OVER (PARTITION BY std, subj ORDER BY n DESC, el) r FROM c)
SELECT std, subj, CASE WHEN t < 10 THEN 'zu_wenige' WHEN 3 * n >= 2 * t THEN 'vorschlag' ELSE 'keine_mehrheit' END urteil, CASE WHEN t >= 10 AND 3 * n >= 2 * t THEN el END element, CAST(t AS BIGINT) n FROM m WHERE r = 1""")
def concept_cells(s: SparkSession, d: str) -> DataFrame:
    """Concept by entity: a proposal where ten points or more agree by two thirds, else the reason why not."""
    m = R.mode_per_key(current_fields(s, d).filter("el is not null"), ["std", "subj"], "el")
    urteil = R.first_match([(F.col("total") < 10, "zu_wenige"), (3 * F.col("n") >= 2 * F.col("total"), "vorschlag")], "keine_mehrheit")
    return m.select("std", "subj", urteil.alias("urteil"), F.when(urteil == "vorschlag", F.col("el")).alias("element"), F.col("total").alias("n"))


@query("""WITH a AS (SELECT id, min(law_id) law_id FROM article GROUP BY id), o AS (SELECT DISTINCT form_id, article_id FROM form_outcome WHERE article_id IS NOT NULL), f AS (SELECT DISTINCT id, form_id FROM data_field)
SELECT a.law_id, count(DISTINCT o.article_id) n_articles, count(DISTINCT o.form_id) n_forms, count(DISTINCT f.id) n_fields FROM o JOIN a ON a.id = o.article_id LEFT JOIN f ON f.form_id = o.form_id GROUP BY a.law_id""")
def law_impact(s: SparkSession, d: str) -> DataFrame:
    """What each law's change would touch: articles cited, forms and fields, each once."""
    a = table(s, d, "article", "id", "law_id").groupBy("id").agg(F.min("law_id").alias("law_id"))
    o = table(s, d, "form_outcome", "form_id", "article_id").filter("article_id is not null").distinct().join(a, F.col("article_id") == F.col("id")).drop("id")
    per_form = table(s, d, "data_field", "id", "form_id").distinct().groupBy("form_id").agg(F.count("*").alias("fields"))
    # a field belongs to one form: distinct forms with their counts give distinct fields without a join row by row
    forms = o.select("law_id", "form_id").distinct().join(per_form, "form_id", "left").groupBy("law_id").agg(F.count("*").alias("n_forms"), F.coalesce(F.sum("fields"), F.lit(0)).alias("n_fields"))
    return o.groupBy("law_id").agg(F.count_distinct("article_id").alias("n_articles")).join(forms, "law_id")


@query("""WITH t(art, wert, einheit) AS (VALUES ('bewilligung', 10, 'jahre'), ('bestaetigung', 6, 'monate'), ('kein_entscheid', 1, 'jahre')), o AS (SELECT form_id, min(entscheid_art) art, max(CAST(geladen_am AS DATE)) tag FROM form_outcome GROUP BY form_id)
SELECT form_id, tag + CAST(coalesce(wert * CASE einheit WHEN 'jahre' THEN 365 ELSE 30 END, 3650) AS INTEGER) loeschen FROM o LEFT JOIN t USING (art)""")
def retention(s: SparkSession, d: str) -> DataFrame:
    """Deletion dates from terms in years of 365 and months of 30 days, with a default."""
    t = s.createDataFrame([("bewilligung", 10, "jahre"), ("bestaetigung", 6, "monate"), ("kein_entscheid", 1, "jahre")], "art string, wert int, einheit string")
    o = table(s, d, "form_outcome", "form_id", "entscheid_art", "geladen_am").groupBy("form_id").agg(F.min("entscheid_art").alias("art"), F.max(F.to_date("geladen_am")).alias("tag")).join(F.broadcast(t), "art", "left")
    days = F.coalesce(F.col("wert") * F.when(F.col("einheit") == "jahre", 365).otherwise(30), F.lit(3650))
    return o.select("form_id", F.date_add("tag", days.cast("int")).alias("loeschen"))


@query("""WITH x AS (SELECT 'element' typ, id, name label, coalesce(standard, '') || ' ' || coalesce(name, '') || ' ' || coalesce(context, '') txt FROM ech_element UNION ALL SELECT 'artikel', id, heading, coalesce(article_no, '') || ' ' || coalesce(heading, '') FROM article UNION ALL SELECT 'organisation', id, min(name), min(name) FROM dvsh_organisation GROUP BY id),
h AS (SELECT typ, id, label, CASE WHEN starts_with(lower(label), 'fach') THEN 2 ELSE 0 END + CASE WHEN contains(lower(label), 'fach') AND contains(lower(label), 'le') THEN 1 ELSE 0 END + CASE WHEN contains(' ' || lower(txt), ' fach') AND contains(' ' || lower(txt), ' le') THEN 3 ELSE 0 END score FROM x WHERE contains(lower(txt), 'fach') AND contains(lower(txt), 'le'))
SELECT typ, id, score, r platz FROM (SELECT *, row_number() OVER (PARTITION BY typ ORDER BY score DESC, label, id) r FROM h) WHERE r <= 10""")
def keyword_search(s: SparkSession, d: str) -> DataFrame:
    """Ranked search over several kinds of entries, the first ten of each kind: a top-k report."""
    sp = lambda *c: F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in c))
    e = table(s, d, "ech_element", "id", "name", "standard", "context").select(F.lit("element").alias("typ"), "id", F.col("name").alias("label"), sp("standard", "name", "context").alias("txt"))
    a = table(s, d, "article", "id", "heading", "article_no").select(F.lit("artikel").alias("typ"), "id", F.col("heading").alias("label"), sp("article_no", "heading").alias("txt"))
    o = table(s, d, "dvsh_organisation", "id", "name").groupBy("id").agg(F.min("name").alias("label")).select(F.lit("organisation").alias("typ"), "id", "label", F.col("label").alias("txt"))
    hits = R.keyword_search(e.unionByName(a).unionByName(o), "label", "txt", "fach le")
    return R.top_k_per_group(hits, ["typ"], [F.desc("score"), F.col("label"), F.col("id")], 10, "platz").select("typ", "id", "score", F.col("platz").cast("long").alias("platz"))


@query("""SELECT 'source' facet, source AS value, count(*) n FROM documents WHERE lang = 'de' GROUP BY ALL UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE source = 'portal' GROUP BY ALL""")
def facets(s: SparkSession, d: str) -> DataFrame:
    """Each facet's counts under the filters of the others, in one pass."""
    return R.facet_counts(table(s, d, "documents", "source", "lang"), {"source": "portal", "lang": "de"})


@query("""WITH u AS (SELECT 'teil' art, data_field_id feld FROM (SELECT id, min(data_field_id) data_field_id FROM data_subfield GROUP BY id) UNION ALL SELECT 'feld', id FROM (SELECT DISTINCT id FROM data_field) f WHERE NOT EXISTS (SELECT 1 FROM data_subfield s WHERE s.data_field_id = f.id))
SELECT form_id, count(*) n_units, count_if(art = 'teil') n_parts FROM u JOIN (SELECT id, min(form_id) form_id FROM data_field GROUP BY id) f ON f.id = u.feld GROUP BY form_id""")
def units_per_form(s: SparkSession, d: str) -> DataFrame:
    """Atomic data points of every form."""
    f = table(s, d, "data_field", "id", "form_id").groupBy(F.col("id").alias("feld")).agg(F.min("form_id").alias("form_id"))
    return units(s, d).join(f, "feld").groupBy("form_id").agg(F.count("*").alias("n_units"), F.count_if(F.col("art") == "teil").alias("n_parts"))


@query(f"""WITH {_E}, {_F}, z AS (SELECT f.form_id, e.std, e.id FROM f JOIN e ON e.id = f.el WHERE NOT e.weg), n AS (SELECT form_id, count(*) n FROM f GROUP BY form_id)
SELECT n.form_id, coalesce(k.standards, '') standards, coalesce(k.n, 0) n_matched, CASE WHEN coalesce(k.n, 0) = n.n THEN 'voll' WHEN k.n > 0 THEN 'teilweise' ELSE 'nein' END abdeckung FROM n LEFT JOIN (SELECT form_id, array_to_string(list_sort(list(DISTINCT std)), ',') standards, count(*) n FROM z GROUP BY form_id) k ON k.form_id = n.form_id""")
def exchange_schema(s: SparkSession, d: str) -> DataFrame:
    """What of a form can be exchanged by standards, and how far that covers it."""
    z = element_states(s, d)
    e = table(s, d, "ech_element", "id", "standard").groupBy(F.col("id").alias("xid")).agg(F.min("standard").alias("standard"))
    z = z.join(e, F.col("el") == F.col("xid"), "left").withColumn("ok", F.col("state") == "element")
    g = z.groupBy("form_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_matched"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("standard")))), ",").alias("standards"))
    cover = R.first_match([(F.col("n_matched") == F.col("n"), "voll"), (F.col("n_matched") > 0, "teilweise")], "nein")
    return g.select("form_id", "standards", "n_matched", cover.alias("abdeckung"))
