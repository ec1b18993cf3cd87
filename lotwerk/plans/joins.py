"""Scans, predicates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwerk.operators import relational as R
from lotwerk.plans.registry import money, registry
from lotwerk.sources.tables import table

QUERIES, SQL, query = registry()


@query("""SELECT r_name, count(DISTINCT o_orderkey) n_orders, count(DISTINCT l_partkey) n_parts, count(DISTINCT l_suppkey) n_suppliers, count(*) n_lines,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) total
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name""")
def impact_index(s: SparkSession, d: str) -> DataFrame:
    """If this changes, what is affected: distinct orders, parts, suppliers and lines under every region."""
    lines = table(s, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    orders = table(s, d, "orders", "o_orderkey", "o_custkey")
    places = table(s, d, "customer", "c_custkey", "c_nationkey").join(table(s, d, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    places = places.join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    star = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(places, F.col("o_custkey") == F.col("c_custkey"))
    return star.groupBy("r_name").agg(
        F.count_distinct("o_orderkey").alias("n_orders"),
        F.count_distinct("l_partkey").alias("n_parts"),
        F.count_distinct("l_suppkey").alias("n_suppliers"),
        F.count("*").alias("n_lines"),
        F.sum(money("l_extendedprice")).cast("double").alias("total"),
    )


@query("""SELECT f.id, f.form_id, coalesce(e.name, f.name) label, coalesce(e.standard, f.ech_standard_code) standard FROM data_field f LEFT JOIN (SELECT id, min(name) name, min(standard) standard FROM ech_element GROUP BY id) e ON e.id = f.ech_element_id
WHERE f.geloescht_am IS NULL AND (f.required = 1 OR f.data_type IS NULL)""")
def left_coalesce_join(s: SparkSession, d: str) -> DataFrame:
    """Projection, null-tolerant filter and left join with fallback values."""
    e = table(s, d, "ech_element", "id", "name", "standard").groupBy(F.col("id").alias("eid")).agg(F.min("name").alias("e_name"), F.min("standard").alias("e_std"))
    f = table(s, d, "data_field", "id", "form_id", "name", "ech_element_id", "ech_standard_code", "required", "data_type", "geloescht_am")
    f = f.filter(F.col("geloescht_am").isNull() & ((F.col("required") == 1) | F.col("data_type").isNull()))
    return f.join(e, F.col("ech_element_id") == F.col("eid"), "left").select("id", "form_id", F.coalesce("e_name", "name").alias("label"), F.coalesce("e_std", "ech_standard_code").alias("standard"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def semi_orders(s: SparkSession, d: str) -> DataFrame:
    """Customers with a large order."""
    o = table(s, d, "orders", "o_custkey", "o_totalprice").filter("o_totalprice > 150000")
    return table(s, d, "customer", "c_custkey", "c_name").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_customers(s: SparkSession, d: str) -> DataFrame:
    """Customers without orders."""
    return table(s, d, "customer", "c_custkey", "c_name").join(table(s, d, "orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT DISTINCT id FROM data_field WHERE id NOT IN (SELECT data_field_id FROM data_subfield WHERE data_field_id IS NOT NULL UNION SELECT data_field_id FROM beilage WHERE data_field_id IS NOT NULL)")
def anti_union(s: SparkSession, d: str) -> DataFrame:
    """Keys that occur in neither of two referring columns."""
    used = table(s, d, "data_subfield", "data_field_id").union(table(s, d, "beilage", "data_field_id")).withColumnRenamed("data_field_id", "id").distinct()
    return table(s, d, "data_field", "id").distinct().join(used, "id", "left_anti")


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) n_orders, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) last_order,
EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') has_final FROM customer""")
def scalar_count(s: SparkSession, d: str) -> DataFrame:
    """Correlated counts, maxima and existence flags of an outer row, by one aggregation and a left join."""
    o = table(s, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").groupBy("o_custkey")
    o = o.agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order"), F.max(F.col("o_orderstatus") == "F").alias("f"))
    c = table(s, d, "customer", "c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order", F.coalesce("f", F.lit(False)).alias("has_final"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    """Every customer's last order."""
    o = table(s, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    return R.latest_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderdate", "o_orderpriority"])


@query("""SELECT sn.n_name from_nation, cn.n_name to_nation, count(*) n_lines FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey GROUP BY ALL""")
def self_join_dim(s: SparkSession, d: str) -> DataFrame:
    """One dimension under two aliases."""
    n = table(s, d, "nation", "n_nationkey", "n_name")
    sup = table(s, d, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("from_nation"))
    cus = table(s, d, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("to_nation"))
    o = table(s, d, "orders", "o_orderkey", "o_custkey").join(cus, F.col("o_custkey") == F.col("c_custkey"))
    li = table(s, d, "lineitem", "l_orderkey", "l_suppkey").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("from_nation", "to_nation").agg(F.count("*").alias("n_lines"))


@query("""SELECT f.id, list_sort(list(s.id ORDER BY s.id))[1] first_sub, count(s.id) n_sub FROM (SELECT DISTINCT id FROM data_field) f JOIN (SELECT DISTINCT id, data_field_id FROM data_subfield) s ON s.data_field_id = f.id GROUP BY f.id""")
def multi_map_join(s: SparkSession, d: str) -> DataFrame:
    """1:n lookup: children gathered under their parent, in order."""
    sub = table(s, d, "data_subfield", "id", "data_field_id").distinct().groupBy(F.col("data_field_id").alias("id")).agg(F.sort_array(F.collect_list(F.col("id"))).alias("subs"))
    f = table(s, d, "data_field", "id").distinct().join(sub, "id")
    return f.select("id", F.get("subs", F.lit(0)).alias("first_sub"), F.size("subs").cast("long").alias("n_sub"))


@query("""WITH u AS (SELECT 'teil' art, s.id, s.data_field_id feld, s.name FROM (SELECT id, min(data_field_id) data_field_id, min(name) AS name FROM data_subfield GROUP BY id) s
UNION ALL SELECT 'feld', f.id, f.id, f.name FROM (SELECT id, min(name) AS name FROM data_field GROUP BY id) f WHERE NOT EXISTS (SELECT 1 FROM data_subfield s WHERE s.data_field_id = f.id))
SELECT art, count(*) n, count(name) n_named, count(DISTINCT feld) n_fields FROM u GROUP BY art""")
def atomic_units(s: SparkSession, d: str) -> DataFrame:
    """The grain of every figure: a field's parts, or the field itself where it has none."""
    u = units(s, d)
    return u.groupBy("art").agg(F.count("*").alias("n"), F.count("name").alias("n_named"), F.count_distinct("feld").alias("n_fields"))


def units(s: SparkSession, d: str) -> DataFrame:
    """(art, id, feld, name) of every atomic data point, one row an id."""
    sub = table(s, d, "data_subfield", "id", "data_field_id", "name").groupBy("id").agg(F.min("data_field_id").alias("feld"), F.min("name").alias("name"))
    f = table(s, d, "data_field", "id", "name").groupBy("id").agg(F.min("name").alias("name"))
    alone = f.join(sub.select(F.col("feld").alias("id")), "id", "left_anti")
    return sub.select(F.lit("teil").alias("art"), "id", "feld", "name").unionByName(alone.select(F.lit("feld").alias("art"), "id", F.col("id").alias("feld"), "name"))


@query("""SELECT kanon_id, count(DISTINCT doc_id) n_docs FROM kanon_begriff JOIN documents ON contains(lower(text), lower(bezeichnung)) GROUP BY kanon_id""")
def contains_join(s: SparkSession, d: str) -> DataFrame:
    """Terms contained in texts: one pass over the texts with an automaton of all terms, or of as many as a task holds."""
    terms = table(s, d, "kanon_begriff", "kanon_id", "bezeichnung").select("kanon_id", F.lower("bezeichnung").alias("term"))
    docs = table(s, d, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("text"))
    return R.terms_in_texts(docs, terms, "kanon_id").groupBy("kanon_id").agg(F.count_distinct("doc_id").alias("n_docs"))


_NAMES = """WITH m AS (SELECT DISTINCT form_id id, lower(trim(name)) token FROM data_field WHERE geloescht_am IS NULL AND trim(name) <> ''), c AS (SELECT id, count(*) n FROM m GROUP BY id HAVING count(*) >= 4),
o AS (SELECT x.id a, y.id b, count(*) o FROM m x JOIN m y ON x.token = y.token AND x.id < y.id GROUP BY ALL)"""


@query(_NAMES + "SELECT a, b, o, o * 1.0 / (ca.n + cb.n - o) jaccard FROM o JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE 20 * o >= 7 * (ca.n + cb.n - o)")
def jaccard_pairs(s: SparkSession, d: str) -> DataFrame:
    """The duplicate radar: pairs of forms whose name sets of four or more overlap by 0.35 or more."""
    return R.jaccard_pairs(_name_sets(s, d), 0.35, 4).withColumn("o", F.col("o").cast("long"))


def _name_sets(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "data_field", "form_id", "name", "geloescht_am").filter("geloescht_am is null and trim(name) <> ''")
    return f.select(F.col("form_id").alias("id"), F.lower(F.trim("name")).alias("token"))


@query(
    _NAMES
    + """, p AS (SELECT a, b, o * 1.0 / (ca.n + cb.n - o) j FROM o JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE 20 * o >= 7 * (ca.n + cb.n - o)), b AS (SELECT a, b, j FROM p UNION ALL SELECT b, a, j FROM p)
SELECT a AS id, b AS partner, j AS jaccard FROM b QUALIFY row_number() OVER (PARTITION BY a ORDER BY j DESC, b) = 1"""
)
def best_match(s: SparkSession, d: str) -> DataFrame:
    """Each form's best partner, of equally good ones the smallest."""
    return R.best_partners(_name_sets(s, d), 0.35, 4)


@query("""WITH r(event_type, must, must_not, lvl) AS (VALUES ('purchase', '"k": [0-9]$|"k": [0-9][^0-9]', NULL, 3), ('purchase', '"k"', '"k": 7', 1), ('view', '"k": 1', '"k": 1[0-4]', 2), ('signup', '.', NULL, 1))
SELECT e.event_id, max(lvl) lvl FROM events e JOIN r ON r.event_type = e.event_type AND regexp_matches(e.props, r.must) AND (r.must_not IS NULL OR NOT regexp_matches(e.props, r.must_not)) GROUP BY e.event_id""")
def broadcast_rules(s: SparkSession, d: str) -> DataFrame:
    """A table of rules joined on its key, with an expression that must match and one that must not, the highest level kept."""
    rules = [("purchase", '"k": [0-9]$|"k": [0-9][^0-9]', None, 3), ("purchase", '"k"', '"k": 7', 1), ("view", '"k": 1', '"k": 1[0-4]', 2), ("signup", ".", None, 1)]
    rules = s.createDataFrame(rules, "event_type string, must string, must_not string, lvl int")
    e = table(s, d, "events", "event_id", "event_type", "props").join(F.broadcast(rules), "event_type").filter(F.expr("props rlike must and (must_not is null or not props rlike must_not)"))
    return e.groupBy("event_id").agg(F.max("lvl").alias("lvl"))


@query("""SELECT e.event_id, e.user_id, e.ts, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON p.user_id = e.user_id AND p.ts <= e.ts""")
def asof_price(s: SparkSession, d: str) -> DataFrame:
    """For each click the value of the user's last purchase up to then."""
    e = table(s, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("value").alias("last_value"))
    left = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return R.as_of_join(left, right, ["user_id"], "ts", "since", "last_value", F.date_trunc("day", F.col("t")))


@query("""WITH c(label, low, high) AS (VALUES ('klein', 0.0, 50000.0), ('mittel', 50000.0, 150000.0), ('gross', 150000.0, 300000.0), ('ueber 100', 100000.0, 1000000.0))
SELECT label, count(*) n FROM orders JOIN c ON o_totalprice >= low AND o_totalprice < high GROUP BY label""")
def range_classes(s: SparkSession, d: str) -> DataFrame:
    """Points joined to overlapping ranges over buckets."""
    ranges = s.createDataFrame([("klein", 0.0, 5e4), ("mittel", 5e4, 1.5e5), ("gross", 1.5e5, 3e5), ("ueber 100", 1e5, 1e6)], "label string, low double, high double")
    return R.range_join(table(s, d, "orders", "o_totalprice"), ranges, "o_totalprice", "low", "high", 50_000.0).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT DISTINCT kennung, status FROM kennung), v AS (SELECT DISTINCT kennung FROM kennung_verlauf WHERE ereignis = 'entfallen')
SELECT coalesce(k.kennung, v.kennung) kennung, CASE WHEN v.kennung IS NULL THEN 'nur_register' ELSE 'nur_log' END seite FROM (SELECT kennung FROM k WHERE status = 'entfallen') k FULL JOIN v ON v.kennung = k.kennung WHERE k.kennung IS NULL OR v.kennung IS NULL""")
def symmetric_difference(s: SparkSession, d: str) -> DataFrame:
    """Keys that only one of two tables has."""
    k = table(s, d, "kennung", "kennung", "status").filter("status = 'entfallen'").select("kennung", F.lit(True).alias("a")).distinct()
    v = table(s, d, "kennung_verlauf", "kennung", "ereignis").filter("ereignis = 'entfallen'").select("kennung", F.lit(True).alias("b")).distinct()
    return k.join(v, "kennung", "full").filter("a is null or b is null").select("kennung", F.when(F.col("b").isNull(), "nur_register").otherwise("nur_log").alias("seite"))


@query("""SELECT l_partkey, min(l_suppkey) supplier FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1""")
def claim_one_target(s: SparkSession, d: str) -> DataFrame:
    """Keys claimed by exactly one target; those claimed by several stay out."""
    g = table(s, d, "lineitem", "l_partkey", "l_suppkey").groupBy("l_partkey").agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"))
    return g.filter("low = high").select("l_partkey", F.col("low").alias("supplier"))


@query("""WITH e AS (SELECT id, standard, name FROM ech_element WHERE geloescht_am IS NULL), n AS (SELECT standard, min(id) id FROM e GROUP BY standard),
f AS (SELECT id, min(ech_element_id) el, min(ech_standard_code) std FROM data_field GROUP BY id)
SELECT f.id, coalesce(a.id, n.id) element, CASE WHEN a.id IS NOT NULL THEN 'element' WHEN n.id IS NOT NULL THEN 'standard' ELSE 'keins' END weg FROM f LEFT JOIN e a ON a.id = f.el LEFT JOIN n ON n.standard = f.std""")
def fallback_lookup(s: SparkSession, d: str) -> DataFrame:
    """Several keys tried in turn: the element, else the first of its standard, else none."""
    e = table(s, d, "ech_element", "id", "standard", "geloescht_am").filter("geloescht_am is null")
    a = e.select(F.col("id").alias("el"), F.col("id").alias("hit"))
    n = e.groupBy(F.col("standard").alias("std")).agg(F.min("id").alias("other"))
    f = table(s, d, "data_field", "id", "ech_element_id", "ech_standard_code").groupBy("id").agg(F.min("ech_element_id").alias("el"), F.min("ech_standard_code").alias("std"))
    way = R.first_match([(F.col("hit").isNotNull(), "element"), (F.col("other").isNotNull(), "standard")], "keins")
    return f.join(a, "el", "left").join(n, "std", "left").select("id", F.coalesce("hit", "other").alias("element"), way.alias("weg"))


@query("""WITH a AS (SELECT DISTINCT id, regexp_replace(article_no, '[^0-9]', '', 'g') no FROM article), q AS (SELECT DISTINCT id, no || '7' cited FROM a WHERE no <> ''),
c AS (SELECT q.id, q.cited, unnest(range(1, length(cited) + 1)) k FROM q), h AS (SELECT DISTINCT c.id, cited, substr(cited, 1, k) hit FROM c JOIN a ON a.no = substr(cited, 1, k))
SELECT id, cited, hit FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(hit) DESC) = 1""")
def longest_prefix_join(s: SparkSession, d: str) -> DataFrame:
    """Numbers glued to a footnote digit: the longest prefix that is a known number wins."""
    a = table(s, d, "article", "id", "article_no").select("id", F.regexp_replace("article_no", "[^0-9]", "").alias("no")).distinct()
    q = a.filter("no <> ''").select("id", F.concat("no", F.lit("7")).alias("cited")).distinct()
    tried = q.select("id", "cited", F.explode(F.transform(F.sequence(F.lit(1), F.length("cited")), lambda k: F.substring("cited", F.lit(1), k))).alias("no"))
    hits = tried.join(a.select("no").distinct(), "no").groupBy("id").agg(F.max(F.struct(F.length("no").alias("n"), F.col("cited"), F.col("no"))).alias("x"))
    return hits.select("id", "x.cited", F.col("x.no").alias("hit"))


@query("""SELECT doc_id, source FROM documents WHERE text ILIKE '%gebühr%' AND text NOT LIKE '%Rekurs%' AND (lang IS NULL OR lang <> 'fr') AND source IN ('gesetz', 'portal', 'dvsh') AND n_chars BETWEEN 100 AND 2000""")
def predicates(s: SparkSession, d: str) -> DataFrame:
    """Equality, inequality with nulls, lists, ranges, and LIKE with and without case."""
    t = table(s, d, "documents", "doc_id", "text", "lang", "source", "n_chars")
    keep = F.col("text").ilike("%gebühr%") & ~F.col("text").like("%Rekurs%") & (F.col("lang").isNull() | (F.col("lang") != "fr"))
    return t.filter(keep & F.col("source").isin("gesetz", "portal", "dvsh") & F.col("n_chars").between(100, 2000)).select("doc_id", "source")


@query("""SELECT ereignis, count(*) n, count_if(vorher IS NOT DISTINCT FROM nachher) n_same, count_if((nachher IS NULL) <> (ereignis = 'entfallen')) n_iff, count_if(regexp_full_match(kennung, 'sh:[a-z]+:.*')) n_shape FROM kennung_verlauf GROUP BY ereignis""")
def null_safe_checks(s: SparkSession, d: str) -> DataFrame:
    """Null-safe equality, iff between two predicates, and a shape check."""
    t = table(s, d, "kennung_verlauf", "kennung", "ereignis", "vorher", "nachher")
    iff = F.col("nachher").isNull() != (F.col("ereignis") == "entfallen")
    return t.groupBy("ereignis").agg(F.count("*").alias("n"), F.count_if(F.col("vorher").eqNullSafe(F.col("nachher"))).alias("n_same"), F.count_if(iff).alias("n_iff"), F.count_if(F.col("kennung").rlike("^sh:[a-z]+:")).alias("n_shape"))


NEEDLE_TABLES = {
    "beilage": ["id", "form_id", "data_field_id", "bezeichnung", "obligatorium", "bedingung", "halter", "fetchable", "source", "last_checked", "geladen_am"],
    "kennung": ["kennung", "art", "ziel_tabelle", "ziel_id", "schluessel", "merkmal", "status", "abgeloest_durch", "seit", "bis", "grund", "geladen_am"],
    "form_outcome": ["form_id", "entscheid_art", "ergebnis_dokument", "rechtsmittel_art", "rechtsmittel_frist_tage", "rechtsmittel_instanz", "article_id", "last_checked", "geladen_am"],
    "article": ["id", "law_id", "article_no", "heading", "last_checked", "geladen_am", "geloescht_am"],
}


@query(" UNION ALL ".join(f"SELECT '{t}' tabelle, '{c}' spalte, count(*) n FROM {t} WHERE contains(CAST({c} AS VARCHAR), '2026') HAVING count(*) > 0" for t, cs in NEEDLE_TABLES.items() for c in cs))
def needle_search(s: SparkSession, d: str) -> DataFrame:
    """A text searched in every column of several tables, one pass a table."""
    out = None
    for name in NEEDLE_TABLES:
        t = table(s, d, name)
        hits = t.agg(*(F.count_if(F.contains(F.col(c).cast("string"), F.lit("2026"))).alias(c) for c in t.columns))
        rows = hits.select(F.explode(F.array(*(F.struct(F.lit(name).alias("tabelle"), F.lit(c).alias("spalte"), F.col(c).alias("n")) for c in t.columns))).alias("x")).select("x.*").filter("n > 0")
        out = rows if out is None else out.unionByName(rows)
    return out
