"""Aggregations, windows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwerk.operators import relational as R
from lotwerk.plans.registry import money, registry
from lotwerk.sources.tables import table

QUERIES, SQL, query = registry()


@query("""SELECT l_returnflag, l_linestatus, count(*) n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) revenue, min(l_shipdate) first, max(l_shipdate) last
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    """Counts, sums, minima and maxima of two columns' groups."""
    li = table(s, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").filter("l_shipdate <= timestamp_ntz'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(money("l_quantity")).cast("double").alias("qty"),
        F.sum(money("l_extendedprice") * (1 - money("l_discount"))).cast("double").alias("revenue"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"),
    )


@query("""SELECT count(*) n, count(DISTINCT form_id) n_forms, count(DISTINCT ech_element_id) n_elements, count_if(required = 1) n_required, count_if(sensitive IS NOT NULL) n_sensitive, count(name) n_named, max(geladen_am) last FROM data_field""")
def kpi_row(s: SparkSession, d: str) -> DataFrame:
    """One row of figures, tolerant of nulls, in one pass."""
    f = table(s, d, "data_field", "form_id", "ech_element_id", "required", "sensitive", "name", "geladen_am")
    return f.agg(
        F.count("*").alias("n"), F.count_distinct("form_id").alias("n_forms"), F.count_distinct("ech_element_id").alias("n_elements"), F.count_if(F.col("required") == 1).alias("n_required"),
        F.count_if(F.col("sensitive").isNotNull()).alias("n_sensitive"), F.count("name").alias("n_named"), F.max("geladen_am").alias("last"),
    )


@query("""SELECT l_suppkey, count(DISTINCT l_orderkey) n_orders, count(DISTINCT l_partkey) n_parts, count_if(l_returnflag = 'R') n_returned, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) n_cheap FROM lineitem GROUP BY l_suppkey""")
def count_distinct_multi(s: SparkSession, d: str) -> DataFrame:
    """Two distinct counts and conditional sums of one group."""
    li = table(s, d, "lineitem", "l_suppkey", "l_orderkey", "l_partkey", "l_returnflag", "l_discount")
    return li.groupBy("l_suppkey").agg(
        F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("n_cheap"),
    )


@query("SELECT sha256(text) fingerprint, count(*) n, min(doc_id) first_doc FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1")
def having_dups(s: SparkSession, d: str) -> DataFrame:
    """Repeated texts."""
    t = table(s, d, "documents", "doc_id", "text").filter("text <> ''").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    return t.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


_MODE = "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) n FROM orders GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) r FROM c)"


@query(_MODE + "SELECT o_custkey, o_orderpriority, n, CAST(total AS BIGINT) total FROM m WHERE r = 1")
def mode_label(s: SparkSession, d: str) -> DataFrame:
    """Each customer's most frequent priority, ties by name."""
    return R.mode_per_key(table(s, d, "orders", "o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority")


@query(_MODE + "SELECT o_custkey, o_orderpriority, n, CAST(total AS BIGINT) total FROM m WHERE r = 1 AND total >= 3 AND n * 3 >= total * 2")
def mode_threshold(s: SparkSession, d: str) -> DataFrame:
    """The same where it has two thirds, in exact fractions, of three or more."""
    return R.majority(table(s, d, "orders", "o_custkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority", (2, 3), 3)


@query("""WITH v AS (SELECT l_partkey, l_returnflag, count(DISTINCT l_suppkey) voters FROM lineitem GROUP BY ALL) SELECT l_partkey, l_returnflag, voters FROM v WHERE voters >= 2""")
def quorum(s: SparkSession, d: str) -> DataFrame:
    """Verdicts that two different voters or more agree on."""
    return table(s, d, "lineitem", "l_partkey", "l_returnflag", "l_suppkey").groupBy("l_partkey", "l_returnflag").agg(F.count_distinct("l_suppkey").alias("voters")).filter("voters >= 2")


@query("""WITH k AS (SELECT lower(trim(name)) label, min(ech_standard_code) std, count(*) n FROM data_field WHERE ech_standard_code IS NOT NULL GROUP BY ALL HAVING min(ech_standard_code) = max(ech_standard_code)),
f AS (SELECT id, lower(trim(min(name))) label, min(ech_standard_code) std FROM data_field GROUP BY id) SELECT f.id, k.std standard, k.n FROM f JOIN k ON k.label = f.label WHERE f.std IS NULL""")
def unanimous_fill(s: SparkSession, d: str) -> DataFrame:
    """A value goes to rows without one if all judged rows of the same name agree on it."""
    f = table(s, d, "data_field", "id", "name", "ech_standard_code").select("id", F.lower(F.trim("name")).alias("label"), F.col("ech_standard_code").alias("standard"))
    agreed = R.unanimous(f, "label", "standard")
    one = table(s, d, "data_field", "id", "name", "ech_standard_code").groupBy("id").agg(F.lower(F.trim(F.min("name"))).alias("label"), F.min("ech_standard_code").alias("own")).filter("own is null")
    return one.join(agreed, "label").select("id", "standard", "n")


@query("SELECT l_returnflag, part, count(*) n, any_value(total) total FROM (SELECT l_returnflag, CASE WHEN l_discount = 0 THEN 'ohne' WHEN l_discount < 0.05 THEN 'klein' ELSE 'gross' END part, count(*) OVER (PARTITION BY l_returnflag) total FROM lineitem) GROUP BY ALL")
def parts_of_total(s: SparkSession, d: str) -> DataFrame:
    """Disjoint parts beside the total they add up to."""
    part = R.first_match([(F.col("l_discount") == 0, "ohne"), (F.col("l_discount") < 0.05, "klein")], "gross")
    return R.parts_of_total(table(s, d, "lineitem", "l_returnflag", "l_discount"), part, ["l_returnflag"])


@query("SELECT l_orderkey, map_keys(m) states, map_values(m) counts FROM (SELECT l_orderkey, map_from_entries(list((l_linestatus, n) ORDER BY l_linestatus)) m FROM (SELECT l_orderkey, l_linestatus, count(*) n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey)")
def state_histogram(s: SparkSession, d: str) -> DataFrame:
    """A map from state to count for every order, given as its keys and values in order."""
    c = table(s, d, "lineitem", "l_orderkey", "l_linestatus").groupBy("l_orderkey", "l_linestatus").agg(F.count("*").alias("n"))
    m = c.groupBy("l_orderkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("l_linestatus", "n")))).alias("m"))
    return m.select("l_orderkey", F.map_keys("m").alias("states"), F.map_values("m").alias("counts"))


@query("SELECT p.prio, coalesce(n, 0) n, coalesce(customers, 0) customers FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) p(prio) LEFT JOIN (SELECT o_orderpriority, count(*) n, count(DISTINCT o_custkey) customers FROM orders GROUP BY ALL) o ON o.o_orderpriority = p.prio")
def zero_filled_categories(s: SparkSession, d: str) -> DataFrame:
    """Totals over the whole list of categories, those without rows as zero."""
    dim = s.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")], "prio string")
    o = table(s, d, "orders", "o_orderpriority", "o_custkey").groupBy(F.col("o_orderpriority").alias("prio")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return dim.join(o, "prio", "left").select("prio", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("""SELECT r_name, n_name, CAST(grouping(r_name) * 2 + grouping(n_name) AS BIGINT) lvl, count(*) n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) bal FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_levels(s: SparkSession, d: str) -> DataFrame:
    """Totals on three levels in one pass."""
    places = table(s, d, "nation", "n_nationkey", "n_name", "n_regionkey").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(s, d, "customer", "c_nationkey", "c_acctbal").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("r_name", "n_name").agg(F.grouping_id().cast("long").alias("lvl"), F.count("*").alias("n"), F.sum(money("c_acctbal")).cast("double").alias("bal"))


@query("""WITH a AS (SELECT l_partkey, l_suppkey, count(*) mine, count_if(l_returnflag = 'N') mine_yes FROM lineitem GROUP BY ALL), b AS (SELECT *, sum(mine) OVER w - mine others, sum(mine_yes) OVER w - mine_yes others_yes FROM a WINDOW w AS (PARTITION BY l_partkey))
SELECT l_partkey, l_suppkey, CASE WHEN 3 * others_yes >= 2 * others AND mine_yes = 0 THEN 'weicht_ab' WHEN 3 * others_yes < 2 * others AND 3 * (others - others_yes) < 2 * others THEN 'uneinheitlich' ELSE 'ok' END befund FROM b WHERE others >= 2""")
def leave_one_out(s: SparkSession, d: str) -> DataFrame:
    """A group against the two-thirds majority of all the others."""
    o = R.leave_one_out(table(s, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag"), ["l_partkey"], "l_suppkey", F.col("l_returnflag") == "N").filter("others >= 2")
    yes, no = 3 * F.col("others_yes") >= 2 * F.col("others"), 3 * (F.col("others") - F.col("others_yes")) >= 2 * F.col("others")
    return o.select("l_partkey", "l_suppkey", R.first_match([(yes & (F.col("mine_yes") == 0), "weicht_ab"), (~yes & ~no, "uneinheitlich")], "ok").alias("befund"))


@query("""WITH u AS (SELECT l_orderkey k, l_partkey p, false virtuell FROM lineitem UNION ALL SELECT l_orderkey, min(l_partkey), true FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 7),
c AS (SELECT *, count(*) OVER (PARTITION BY k, p) n FROM u) SELECT k, p, max(n) n FROM c WHERE n > 1 AND NOT virtuell GROUP BY k, p""")
def ambiguous_keys(s: SparkSession, d: str) -> DataFrame:
    """Members that occur more than once in their group, virtual members counted along."""
    li = table(s, d, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"))
    extra = li.groupBy("k").agg(F.min("p").alias("p"), F.count("*").alias("c")).filter("c >= 7").select("k", "p", F.lit(True).alias("virtuell"))
    both = li.withColumn("virtuell", F.lit(False)).unionByName(extra).groupBy("k", "p").agg(F.count("*").alias("n"), F.count_if(~F.col("virtuell")).alias("real"))
    return both.filter("n > 1 and real > 0").select("k", "p", "n")


@query("""WITH w AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'offen' WHEN o_totalprice < 50000 THEN 'klein' WHEN o_orderpriority = '5-LOW' THEN 'niedrig' ELSE 'bleibt' END grund FROM orders) SELECT grund, count(*) n, (SELECT count(*) FROM orders) vorher FROM w GROUP BY grund""")
def waterfall(s: SparkSession, d: str) -> DataFrame:
    """Rows excluded by their first matching reason; reasons and rest add up to the total before."""
    reason = R.first_match([(F.col("o_orderstatus") == "P", "offen"), (F.col("o_totalprice") < 50000, "klein"), (F.col("o_orderpriority") == "5-LOW", "niedrig")], "bleibt")
    return R.parts_of_total(table(s, d, "orders", "o_orderstatus", "o_totalprice", "o_orderpriority"), reason).select(F.col("part").alias("grund"), "n", F.col("total").alias("vorher"))


@query("""WITH n AS (SELECT c_custkey, count(o_orderkey) n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) SELECT CASE WHEN n >= 15 THEN '>=15' WHEN n >= 10 THEN '10-14' WHEN n >= 6 THEN '6-9' WHEN n >= 2 THEN '2-5' WHEN n = 1 THEN '1' ELSE '0' END klasse, count(*) n FROM n GROUP BY klasse""")
def class_histogram(s: SparkSession, d: str) -> DataFrame:
    """A histogram in labelled classes, rows without partners in the lowest."""
    o = table(s, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("k"))
    c = table(s, d, "customer", "c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    label = R.class_of(F.coalesce("k", F.lit(0)), [(0, "0"), (1, "1"), (2, "2-5"), (6, "6-9"), (10, "10-14"), (15, ">=15")])
    return c.select(label.alias("klasse")).groupBy("klasse").agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) AS BIGINT) jahr, count(*) n FROM orders GROUP BY ALL")
def year_calendar(s: SparkSession, d: str) -> DataFrame:
    """Rows per year."""
    return table(s, d, "orders", "o_orderdate").groupBy(F.year("o_orderdate").cast("long").alias("jahr")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) r, count(*) OVER (PARTITION BY l_suppkey) n FROM lineitem) SELECT l_suppkey, l_quantity upper_median FROM r WHERE r = n // 2 + 1")
def upper_median(s: SparkSession, d: str) -> DataFrame:
    """The upper median, an element and no interpolation, from counts of values instead of gathered lists."""
    c = table(s, d, "lineitem", "l_suppkey", "l_quantity").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("k"))
    w = Window.partitionBy("l_suppkey")
    upto = F.sum("k").over(w.orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("upto", upto).withColumn("mid", F.expr("sum(k) over (partition by l_suppkey) div 2 + 1"))
    return c.filter("upto >= mid and upto - k < mid").select("l_suppkey", F.col("l_quantity").alias("upper_median"))


@query("""SELECT sn.n_name quelle, cn.n_name ziel, l_shipmode art, count(*) gewicht, count(DISTINCT l_orderkey) n_orders, list_sort(list(DISTINCT l_linenumber))[1] erste FROM (SELECT *, l_linestatus l_shipmode FROM lineitem) l JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey GROUP BY ALL""")
def edge_graph(s: SparkSession, d: str) -> DataFrame:
    """Weighted, typed edges with distinct members."""
    n = table(s, d, "nation", "n_nationkey", "n_name")
    sup = table(s, d, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("quelle"))
    cus = table(s, d, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("ziel"))
    li = table(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_linestatus", "l_linenumber").join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    e = li.join(table(s, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(cus, F.col("o_custkey") == F.col("c_custkey"))
    return e.groupBy("quelle", "ziel", F.col("l_linestatus").alias("art")).agg(F.count("*").alias("gewicht"), F.count_distinct("l_orderkey").alias("n_orders"), F.min("l_linenumber").alias("erste"))


@query("""WITH k AS (SELECT ech_standard_code std, ech_element_id el, count(DISTINCT form_id) forms, count(*) n FROM data_field WHERE ech_element_id IS NOT NULL GROUP BY ALL) SELECT std, count(*) n_data, count_if(forms >= 2) repeated, CAST(sum(CASE WHEN forms >= 2 THEN forms - 1 ELSE 0 END) AS BIGINT) overlap FROM k GROUP BY std""")
def overlap_count(s: SparkSession, d: str) -> DataFrame:
    """How often the same datum is asked again: the forms beyond the first, summed."""
    k = table(s, d, "data_field", "ech_standard_code", "ech_element_id", "form_id").filter("ech_element_id is not null").groupBy(F.col("ech_standard_code").alias("std"), "ech_element_id").agg(F.count_distinct("form_id").alias("forms"))
    return k.groupBy("std").agg(F.count("*").alias("n_data"), F.count_if(F.col("forms") >= 2).alias("repeated"), F.sum(F.when(F.col("forms") >= 2, F.col("forms") - 1).otherwise(0)).alias("overlap"))


@query("""WITH a AS (SELECT 'element' art, CAST(ech_element_id AS VARCHAR) k, name, form_id, sensitive FROM data_field WHERE ech_element_id IS NOT NULL UNION ALL SELECT 'standard', ech_standard_code, name, form_id, sensitive FROM data_field WHERE ech_element_id IS NULL AND ech_standard_code IS NOT NULL),
lc AS (SELECT art, k, name, count(*) c FROM a GROUP BY art, k, name), l AS (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY art, k ORDER BY c DESC, name NULLS FIRST) = 1)
SELECT a.art, a.k, any_value(l.name) label, count(*) n, count(DISTINCT form_id) n_forms, coalesce(array_to_string(list_sort(list(DISTINCT sensitive)), ','), '') sensitive FROM a JOIN l ON l.art = a.art AND l.k = a.k GROUP BY a.art, a.k""")
def attribute_catalogue(s: SparkSession, d: str) -> DataFrame:
    """One row a kind and key over a union of branches: counts, distinct forms, most frequent label, set of classes."""
    f = table(s, d, "data_field", "ech_element_id", "ech_standard_code", "name", "form_id", "sensitive")
    a = f.select(F.when(F.col("ech_element_id").isNotNull(), "element").otherwise("standard").alias("art"), F.coalesce(F.col("ech_element_id").cast("string"), "ech_standard_code").alias("k"), "name", "form_id", "sensitive").filter("k is not null")
    label = R.mode_per_key(a, ["art", "k"], "name").select("art", "k", F.col("name").alias("label"))
    sums = a.groupBy("art", "k").agg(F.count("*").alias("n"), F.count_distinct("form_id").alias("n_forms"), F.array_join(F.sort_array(F.collect_set("sensitive")), ",").alias("sensitive"))
    return sums.join(label, ["art", "k"])


@query("SELECT o_custkey, o_orderkey, 'feld:' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + (o_custkey % 5)) nr FROM orders")
def serial_numbers(s: SparkSession, d: str) -> DataFrame:
    """Serial numbers per parent that go on after the highest ever given."""
    o = table(s, d, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    nr = R.numbered(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.date_trunc("year", "o_orderdate"), "nr")
    return nr.select("o_custkey", "o_orderkey", F.concat(F.lit("feld:"), (F.col("nr") + F.col("o_custkey") % 5).cast("string")).alias("nr"))


@query("WITH k AS (SELECT form_id, lower(trim(name)) n, min((ord, id)) o FROM data_field WHERE name IS NOT NULL GROUP BY ALL) SELECT form_id, n, row_number() OVER (PARTITION BY form_id ORDER BY o) ord FROM k")
def ordinal_after_dedup(s: SparkSession, d: str) -> DataFrame:
    """Ordinals within a parent after names that are alike were made one."""
    k = table(s, d, "data_field", "form_id", "name", "ord", "id").filter("name is not null").groupBy("form_id", F.lower(F.trim("name")).alias("n")).agg(F.min(F.struct("ord", "id")).alias("o"))
    return k.select("form_id", "n", F.row_number().over(Window.partitionBy("form_id").orderBy("o")).cast("long").alias("ord"))


@query("SELECT o_custkey, o_orderkey, r rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) r FROM orders) WHERE r <= 3")
def topk_per_group(s: SparkSession, d: str) -> DataFrame:
    """Each customer's three largest orders."""
    o = R.top_k_per_group(table(s, d, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return o.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_global(s: SparkSession, d: str) -> DataFrame:
    """The 25 largest orders: a top-k report."""
    return table(s, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("WITH f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) p FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_suppkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY p) nr FROM f")
def first_appearance(s: SparkSession, d: str) -> DataFrame:
    """Groups numbered by their first appearance."""
    f = table(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("p"))
    return f.select("l_orderkey", "l_suppkey", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("p")).cast("long").alias("nr"))


@query("WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') monat, o_orderpriority prio, count(*) n FROM orders GROUP BY ALL) SELECT monat, prio, n, n - lag(n) OVER (PARTITION BY prio ORDER BY monat) delta FROM m")
def lag_trend(s: SparkSession, d: str) -> DataFrame:
    """Monthly figures beside the ones before."""
    m = table(s, d, "orders", "o_orderdate", "o_orderpriority").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("monat"), F.col("o_orderpriority").alias("prio")).agg(F.count("*").alias("n"))
    return m.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("prio").orderBy("monat")))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) k FROM events) WHERE k <= 3")
def running_count(s: SparkSession, d: str) -> DataFrame:
    """Rows up to the third of their kind, later repeats suppressed."""
    e = table(s, d, "events", "event_id", "user_id", "event_type", "ts")
    return R.top_k_per_group(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], 3).select("event_id", "user_id")


@query("WITH d(prio, ord) AS (VALUES ('5-LOW', 1), ('1-URGENT', 2), ('3-MEDIUM', 3)) SELECT prio, o_orderstatus, count(*) n, row_number() OVER (ORDER BY ord, o_orderstatus) platz FROM orders JOIN d ON prio = o_orderpriority GROUP BY prio, ord, o_orderstatus")
def dim_order(s: SparkSession, d: str) -> DataFrame:
    """A sort by a dimension's own order."""
    dim = s.createDataFrame([("5-LOW", 1), ("1-URGENT", 2), ("3-MEDIUM", 3)], "prio string, ord int")
    o = table(s, d, "orders", "o_orderpriority", "o_orderstatus").groupBy(F.col("o_orderpriority").alias("prio"), "o_orderstatus").agg(F.count("*").alias("n")).join(F.broadcast(dim), "prio")
    return o.select("prio", "o_orderstatus", "n", F.row_number().over(Window.orderBy("ord", "o_orderstatus")).cast("long").alias("platz"))


@query("""WITH p AS (SELECT DISTINCT id, article_no, CAST(regexp_extract(article_no, '^([0-9]+)', 1) AS INTEGER) n, regexp_extract(article_no, '^[0-9]+(.*)$', 1) suffix FROM article WHERE regexp_matches(article_no, '^[0-9]+')),
o AS (SELECT *, CASE suffix WHEN '' THEN 0 WHEN 'bis' THEN 1002 WHEN 'ter' THEN 1003 WHEN 'quater' THEN 1004 ELSE ascii(suffix) END k FROM p) SELECT id, article_no, dense_rank() OVER (ORDER BY n, k, suffix) platz FROM o""")
def article_order(s: SparkSession, d: str) -> DataFrame:
    """Article numbers in their own order: 14 before 14a before 14bis; ranked over the distinct numbers."""
    a = table(s, d, "article", "id", "article_no").distinct().filter(F.col("article_no").rlike("^[0-9]+"))
    a = a.select("id", "article_no", F.regexp_extract("article_no", "^([0-9]+)", 1).cast("int").alias("n"), F.regexp_extract("article_no", "^[0-9]+(.*)$", 1).alias("suffix"))
    k = F.when(F.col("suffix") == "", 0).when(F.col("suffix") == "bis", 1002).when(F.col("suffix") == "ter", 1003).when(F.col("suffix") == "quater", 1004).otherwise(F.ascii("suffix"))
    numbers = a.select("n", "suffix", k.alias("k")).distinct().withColumn("platz", F.dense_rank().over(Window.orderBy("n", "k", "suffix")).cast("long"))
    return a.join(numbers, ["n", "suffix"]).select("id", "article_no", "platz")
