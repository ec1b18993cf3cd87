"""Set operations, recursion, merges and change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwerk.operators import relational as R
from lotwerk.plans.registry import registry
from lotwerk.sources.tables import table

QUERIES, SQL, query = registry()


@query("""SELECT 'intersect' op, count(*) n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'except', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'union', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 UNION SELECT p_partkey FROM part WHERE p_size > 40)
UNION ALL SELECT 'except_all', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def set_algebra(s: SparkSession, d: str) -> DataFrame:
    """Intersection, difference, union and difference of multisets."""
    li = table(s, d, "lineitem", "l_partkey", "l_returnflag", "l_discount")
    part = table(s, d, "part", "p_partkey", "p_size")
    of = lambda flag: li.filter(F.col("l_returnflag") == flag).select("l_partkey")
    results = {
        "intersect": of("R").intersect(of("A")),
        "except": part.select("p_partkey").subtract(of("R")),
        "union": li.filter("l_discount > 0.09").select("l_partkey").union(part.filter("p_size > 40").select("p_partkey")).distinct(),
        "except_all": of("N").exceptAll(of("A")),
    }
    out = None
    for op, df in results.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH RECURSIVE t(id, nachfolger) AS (SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE (n_nationkey * 3 + 1) % 25 END FROM nation),
r AS (SELECT id, id AS stand, [id] weg, false kreis FROM t UNION ALL SELECT r.id, t.nachfolger, list_append(weg, t.nachfolger), list_contains(weg, t.nachfolger) FROM r JOIN t ON t.id = r.stand WHERE t.nachfolger IS NOT NULL AND NOT kreis)
SELECT id, stand, kreis, CAST(len(weg) - 1 AS BIGINT) schritte FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(weg) DESC) = 1""")
def recursive_chain(s: SparkSession, d: str) -> DataFrame:
    """Chains of successors followed to their end, cycles noticed, by a recursive query."""
    rows = s.sql("""
WITH RECURSIVE t(id, nachfolger) AS (SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE (n_nationkey * 3 + 1) % 25 END FROM {keys}),
r(id, stand, weg, kreis) AS (
  SELECT id, id, array(id), false FROM t
  UNION ALL SELECT r.id, t.nachfolger, array_append(weg, t.nachfolger), array_contains(weg, t.nachfolger) FROM r JOIN t ON t.id = r.stand WHERE t.nachfolger IS NOT NULL AND NOT kreis)
SELECT id, stand, kreis, cast(size(weg) - 1 AS bigint) schritte FROM r""", keys=table(s, d, "nation", "n_nationkey"))
    return R.latest_per_key(rows, ["id"], [F.col("schritte")], ["stand", "kreis", "schritte"])


_V = """WITH a AS (SELECT o_orderkey k, o_orderstatus st, o_totalprice p, o_orderpriority pr FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END st, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END p, o_orderpriority pr FROM orders WHERE o_orderkey % 3 <> 0)"""


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the orders: rows missing in each, and changed values; the predicates make the versions, not the query cheap."""
    o = table(s, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").toDF("k", "st", "p", "pr")
    new = o.filter("k % 3 <> 0").withColumn("st", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("st"))).withColumn("p", F.when(F.col("k") % 11 != 0, F.col("p")))
    return o.filter("k % 7 <> 0"), new


@query(_V + """, j AS (SELECT coalesce(a.k, b.k) k, a.k ak, b.k bk, concat_ws(',', CASE WHEN a.st IS DISTINCT FROM b.st THEN 'st' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'p' END, CASE WHEN a.pr IS DISTINCT FROM b.pr THEN 'pr' END) f FROM a FULL JOIN b ON a.k = b.k)
SELECT k, CASE WHEN ak IS NULL THEN 'neu' WHEN bk IS NULL THEN 'entfernt' ELSE 'geaendert' END art, CASE WHEN ak IS NOT NULL AND bk IS NOT NULL THEN f END felder FROM j WHERE ak IS NULL OR bk IS NULL OR f <> ''""")
def full_diff(s: SparkSession, d: str) -> DataFrame:
    """Two versions of a table compared in full: new, removed and changed rows with the columns that changed."""
    return R.full_diff(*_versions(s, d), ["k"], ["st", "p", "pr"])


@query(_V + " SELECT coalesce(b.k, a.k) k, CASE WHEN b.k IS NULL THEN a.st ELSE b.st END st, CASE WHEN b.k IS NULL THEN a.p ELSE b.p END p FROM a FULL JOIN b ON a.k = b.k")
def upsert_merge(s: SparkSession, d: str) -> DataFrame:
    """A batch put into a table by key."""
    return R.upsert(*_versions(s, d), ["k"], ["st", "p"])


@query(_V + " SELECT coalesce(b.k, a.k) k, coalesce(b.p, a.p) p FROM b FULL JOIN a ON a.k = b.k")
def fill_never_clobber(s: SparkSession, d: str) -> DataFrame:
    """A batch that only fills what is null."""
    a, b = _versions(s, d)
    return R.upsert(b, a, ["k"], ["p"], fill_only=True)


@query("SELECT l_orderkey, arg_min(l_suppkey, l_linenumber) first_supplier, arg_max(l_suppkey, l_linenumber) last_supplier FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) l_suppkey FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def first_and_last_wins(s: SparkSession, d: str) -> DataFrame:
    """Lookup tables in which the first or the last row of a key stays."""
    li = table(s, d, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"))
    first = R.first_wins(li, ["l_orderkey"], "s", ["l_linenumber"]).withColumnRenamed("s", "first_supplier")
    return first.join(R.last_wins(li, ["l_orderkey"], "s", ["l_linenumber"]).withColumnRenamed("s", "last_supplier"), "l_orderkey")


@query("""SELECT id, arg_max(slug, (tag, slug)) FILTER (slug IS NOT NULL) slug, arg_max(contact_email, (tag, contact_email)) FILTER (contact_email IS NOT NULL) contact_email FROM (SELECT *, CASE WHEN updated_at LIKE '__.__.____' THEN CAST(strptime(updated_at, '%d.%m.%Y') AS DATE) ELSE CAST(substr(updated_at, 1, 10) AS DATE) END tag FROM dvsh_organisation) GROUP BY id""")
def merge_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Several deliveries of a row made one, each column from the newest that has it."""
    from lotwerk.functions.dates import day

    o = table(s, d, "dvsh_organisation", "id", "slug", "contact_email", "updated_at").withColumn("tag", day(F.col("updated_at")))
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("tag", c))).getField(c).alias(c)
    return o.groupBy("id").agg(newest("slug"), newest("contact_email"))


@query("""WITH m AS (SELECT id, min(id) OVER (PARTITION BY lower(name), coalesce(parent_id, -1)) canon FROM (SELECT id, min(name) AS name, min(parent_id) parent_id FROM dvsh_organisation GROUP BY id))
SELECT DISTINCT m.canon id, p.canon parent_id FROM (SELECT id, min(parent_id) parent_id FROM dvsh_organisation GROUP BY id) o JOIN m ON m.id = o.id LEFT JOIN m p ON p.id = o.parent_id""")
def repoint_keys(s: SparkSession, d: str) -> DataFrame:
    """References turned to the row that stays of several alike, and repeated rows dropped."""
    o = table(s, d, "dvsh_organisation", "id", "name", "parent_id").groupBy("id").agg(F.lower(F.min("name")).alias("name"), F.min("parent_id").alias("parent_id"))
    canon = o.groupBy("name", F.coalesce("parent_id", F.lit(-1)).alias("p")).agg(F.min("id").alias("canon"))
    m = o.select("id", "parent_id", "name", F.coalesce("parent_id", F.lit(-1)).alias("p")).join(canon, ["name", "p"]).select("id", "parent_id", "canon")
    up = m.select(F.col("id").alias("parent_id"), F.col("canon").alias("new_parent"))
    return m.join(up, "parent_id", "left").select(F.col("canon").alias("id"), F.col("new_parent").alias("parent_id")).distinct()


@query("""WITH b AS (SELECT id, min(bezeichnung) bezeichnung, min(form_id) form_id, min(data_field_id) data_field_id FROM beilage GROUP BY id),
k AS (SELECT DISTINCT lower(bezeichnung) n FROM kanon_begriff WHERE bereich = 'beilage'), f AS (SELECT DISTINCT id FROM data_field)
SELECT b.id, CASE WHEN bezeichnung IS NULL OR trim(bezeichnung, ' ') = '' THEN 'ohne_name' WHEN data_field_id IS NOT NULL AND f.id IS NULL THEN 'feld_fehlt' WHEN k.n IS NULL THEN 'nicht_im_katalog' ELSE 'angenommen' END urteil
FROM b LEFT JOIN k ON k.n = lower(trim(b.bezeichnung, ' ')) LEFT JOIN f ON f.id = b.data_field_id""")
def evidence_gate(s: SparkSession, d: str) -> DataFrame:
    """Rows accepted or rejected with the reason, the first that holds."""
    b = table(s, d, "beilage", "id", "bezeichnung", "data_field_id").groupBy("id").agg(F.min("bezeichnung").alias("name"), F.min("data_field_id").alias("field"))
    k = table(s, d, "kanon_begriff", "bereich", "bezeichnung").filter("bereich = 'beilage'").select(F.lower("bezeichnung").alias("n")).distinct()
    f = table(s, d, "data_field", "id").distinct().select(F.col("id").alias("fid"))
    j = b.join(k, F.lower(F.trim("name")) == F.col("n"), "left").join(f, F.col("field") == F.col("fid"), "left")
    rules = [(F.col("name").isNull() | (F.trim("name") == ""), "ohne_name"), (F.col("field").isNotNull() & F.col("fid").isNull(), "feld_fehlt"), (F.col("n").isNull(), "nicht_im_katalog")]
    return j.select("id", R.first_match(rules, "angenommen").alias("urteil"))


@query("""WITH a AS (SELECT kennung, any_value(art) art, max(schluessel) schluessel, max(merkmal) merkmal FROM kennung WHERE status = 'aktiv' GROUP BY kennung),
o AS (SELECT kennung AS obj, art, CASE WHEN length(kennung) % 6 = 0 THEN schluessel || ' neu' ELSE schluessel END schluessel, CASE WHEN length(kennung) % 5 = 0 THEN NULL ELSE merkmal END merkmal FROM a WHERE ascii(substr(kennung, -1)) % 9 <> 0),
ka AS (SELECT *, count(*) OVER (PARTITION BY art, schluessel, merkmal) c FROM a WHERE merkmal IS NOT NULL), oa AS (SELECT *, count(*) OVER (PARTITION BY art, schluessel, merkmal) c FROM o WHERE merkmal IS NOT NULL),
w1 AS (SELECT obj, kennung FROM ka JOIN oa USING (art, schluessel, merkmal) WHERE ka.c = 1 AND oa.c = 1),
k2 AS (SELECT *, count(*) OVER (PARTITION BY art, schluessel) c FROM a ANTI JOIN w1 USING (kennung)), o2 AS (SELECT *, count(*) OVER (PARTITION BY art, schluessel) c FROM o ANTI JOIN w1 USING (obj)),
w2 AS (SELECT obj, kennung FROM k2 JOIN o2 USING (art, schluessel) WHERE k2.c = 1 AND o2.c = 1),
k3 AS (SELECT * EXCLUDE (c), count(*) OVER (PARTITION BY art, merkmal) c FROM k2 ANTI JOIN w2 USING (kennung) WHERE merkmal IS NOT NULL), o3 AS (SELECT * EXCLUDE (c), count(*) OVER (PARTITION BY art, merkmal) c FROM o2 ANTI JOIN w2 USING (obj) WHERE merkmal IS NOT NULL),
w3 AS (SELECT obj, kennung FROM k3 JOIN o3 USING (art, merkmal) WHERE k3.c = 1 AND o3.c = 1), w AS (SELECT *, 'gleich' art FROM w1 UNION ALL SELECT *, 'schluessel' FROM w2 UNION ALL SELECT *, 'umbenannt' FROM w3)
SELECT art AS befund, count(*) n, count_if(obj = kennung) richtig FROM w GROUP BY art UNION ALL SELECT 'entfallen', count(*), 0 FROM a ANTI JOIN w USING (kennung) UNION ALL SELECT 'neu', count(*), 0 FROM o ANTI JOIN w USING (obj)""")
def identifier_reconcile(s: SparkSession, d: str) -> DataFrame:
    """Permanent identifiers paired with the objects of a new build, in waves of mutually unique matches."""
    k = table(s, d, "kennung", "kennung", "art", "schluessel", "merkmal", "status").filter("status = 'aktiv'").groupBy("kennung").agg(F.min("art").alias("art"), F.max("schluessel").alias("schluessel"), F.max("merkmal").alias("merkmal"))
    o = k.filter(F.ascii(F.substring("kennung", -1, 1)) % 9 != 0).select(
        F.col("kennung").alias("obj"), "art",
        F.when(F.length("kennung") % 6 == 0, F.concat("schluessel", F.lit(" neu"))).otherwise(F.col("schluessel")).alias("schluessel"),
        F.when(F.length("kennung") % 5 != 0, F.col("merkmal")).alias("merkmal"),
    )
    matched, retired, new = R.match_in_waves(k, o, "kennung", "obj", [("gleich", ["art", "schluessel", "merkmal"]), ("schluessel", ["art", "schluessel"]), ("umbenannt", ["art", "merkmal"])])
    out = matched.groupBy(F.col("wave").alias("befund")).agg(F.count("*").alias("n"), F.count_if(F.col("obj") == F.col("kennung")).alias("richtig"))
    for name, rest in (("entfallen", retired), ("neu", new)):
        out = out.unionByName(rest.agg(F.count("*").alias("n")).select(F.lit(name).alias("befund"), "n", F.lit(0).cast("long").alias("richtig")))
    return out


@query("""WITH v AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) s FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN len(s) = 1 THEN 'belegt' ELSE 'widerspruch' END stand, array_to_string(s, ',') belege FROM v UNION ALL SELECT o_orderkey, 'unbekannt', '' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def evidence_agree(s: SparkSession, d: str) -> DataFrame:
    """All evidence agrees, disagrees, or there is none."""
    li = table(s, d, "lineitem", "l_orderkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("s"))
    o = table(s, d, "orders", "o_orderkey").join(li, F.col("o_orderkey") == F.col("k"), "left")
    state = R.first_match([(F.col("s").isNull(), "unbekannt"), (F.size("s") == 1, "belegt")], "widerspruch")
    return o.select(F.col("o_orderkey").alias("l_orderkey"), state.alias("stand"), F.coalesce(F.array_join("s", ","), F.lit("")).alias("belege"))


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 'gespeichert' ELSE 'verwendet' END art, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) quelle FROM events")
def once_only(s: SparkSession, d: str) -> DataFrame:
    """The once-only ledger: the first value of a subject and attribute is stored, later uses refer to it."""
    e = table(s, d, "events", "event_id", "user_id", "event_type", "ts")
    first = e.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", "event_type", F.col("f.event_id").alias("quelle"))
    return e.join(first, ["user_id", "event_type"]).select("event_id", F.when(F.col("event_id") == F.col("quelle"), "gespeichert").otherwise("verwendet").alias("art"), "quelle")


@query("SELECT datum, n FROM (SELECT CAST(ts AS DATE) datum, event_id n, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1")
def daily_history(s: SparkSession, d: str) -> DataFrame:
    """One figure a day, the last build of the day."""
    e = table(s, d, "events", "event_id", "ts").withColumn("datum", F.to_date("ts"))
    return R.latest_per_key(e, ["datum"], [F.col("ts"), F.col("event_id")], ["event_id"]).withColumnRenamed("event_id", "n")


