"""Problem 2: the history of changing attributes, kept by rebuilding affected chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwerk.functions.dates import day, day_text
from lotwerk.session import cut, shared_folder
from lotwerk.sources import versions
from lotwerk.sources.tables import table

FOREVER = "9999-12-31"
#: What an event does to the status; umbenannt leaves it and sets the key.
STATUS_AFTER = {"entfallen": "entfallen", "abgeloest": "abgeloest", "reaktiviert": "aktiv"}
CHAIN = ["kennung", "ab", "bis", "status", "schluessel"]


def day_facts(events: DataFrame) -> DataFrame:
    """Raw events(id, kennung, datum, ereignis, vorher, nachher) condensed to what each day of an entity settles.

    Events alike in kennung, day, ereignis, vorher and nachher count once, at the lowest id. (kennung, tag, named,
    status, first): named is the last renaming, status the last event that sets one, first the first non-null vorher.
    Both steps combine before the shuffle, so an entity with a third of all events is never gathered in one task: what
    remains of it is one row a day.
    """
    once = (
        events.select("kennung", day(F.col("datum")).alias("tag"), "ereignis", "vorher", "nachher", "id")
        .filter("kennung is not null and tag is not null")
        .groupBy("kennung", "tag", "ereignis", "vorher", "nachher")
        .agg(F.min("id").alias("id"))
    )
    status = F.lit(None).cast("string")
    for event, after in STATUS_AFTER.items():
        status = F.when(F.col("ereignis") == event, after).otherwise(status)
    last = lambda value, cond: F.max(F.when(cond, F.struct("id", value)))
    return once.groupBy("kennung", "tag").agg(
        last(F.col("nachher").alias("v"), F.col("ereignis") == "umbenannt").alias("named"),
        last(status.alias("v"), status.isNotNull()).alias("status"),
        F.min(F.when(F.col("vorher").isNotNull(), F.struct("id", F.col("vorher").alias("v")))).alias("first"),
    )


def build_chains(facts: DataFrame, starts: DataFrame) -> DataFrame:
    """Versions (CHAIN) of every entity of starts(kennung, seit, schluessel; one row a kennung) from its day facts.

    A window holds one row a day of an entity at most, however many events it has.
    """
    original = facts.filter("first is not null").groupBy("kennung").agg(F.min(F.struct("tag", F.col("first.id").alias("id"), F.col("first.v").alias("v"))).alias("o"))
    begin = starts.join(original, "kennung", "left").select(
        "kennung", F.col("seit").alias("tag"), F.coalesce("o.v", "schluessel").alias("key"), F.lit(0).alias("rank")
    )
    days = begin.select("kennung", "tag", "rank", F.struct(F.col("key").alias("v")).alias("key"), F.lit("aktiv").alias("status")).unionByName(
        facts.join(starts.select("kennung"), "kennung", "left_semi").select(
            "kennung", "tag", F.lit(1).alias("rank"), F.when(F.col("named").isNotNull(), F.struct(F.col("named.v").alias("v"))).alias("key"), F.col("status.v").alias("status")
        )
    )
    order = Window.partitionBy("kennung").orderBy(F.col("tag").asc_nulls_first(), "rank")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    state = days.select(
        "kennung",
        "tag",
        F.last("key", ignorenulls=True).over(so_far).alias("key"),
        F.last("status", ignorenulls=True).over(so_far).alias("status"),
        F.lead("tag").over(order).alias("next"),
        F.lead("rank").over(order).alias("next_rank"),
    )
    # the last row of a day holds for the day
    state = state.filter("next_rank is null or not (next <=> tag)").select("kennung", "tag", F.struct("key.v", "status").alias("s"))
    state = state.withColumn("before", F.lag("s").over(Window.partitionBy("kennung").orderBy(F.col("tag").asc_nulls_first())))
    changed = state.filter("before is null or not (before <=> s)")
    bis = F.lead("tag").over(Window.partitionBy("kennung").orderBy(F.col("tag").asc_nulls_first()))
    return changed.select(
        "kennung",
        day_text(F.col("tag")).alias("ab"),
        F.coalesce(day_text(bis), F.lit(FOREVER)).alias("bis"),
        F.col("s.status").alias("status"),
        F.col("s.v").alias("schluessel"),
    )


def _rebuilt(batch: DataFrame, events: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touched(kennung), rebuilt): the entities of batch, and their chains made anew from their raw events only."""
    touched = cut(batch.filter("kennung is not null").select("kennung").distinct())
    facts = day_facts(events.join(touched, "kennung", "left_semi"))
    return touched, build_chains(facts, starts.join(touched, "kennung", "left_semi"))


def rebuild_affected(chains: DataFrame, batch: DataFrame, events: DataFrame, starts: DataFrame) -> DataFrame:
    """chains after the late, corrected or new events of batch.

    Only entities that batch touches are rebuilt: their raw changes (batch's among them) are taken from events, all
    their intervals are made anew, and the new chains stand in place of the old ones; all other chains stay as they
    are. The result does not depend on how the log was cut into batches.
    """
    touched, rebuilt = _rebuilt(batch, events, starts)
    return chains.join(touched, "kennung", "left_anti").select(*CHAIN).unionByName(rebuilt)


def chains_at(spark: SparkSession, name: str) -> str:
    """Where the published chains called name lie in the shared folder."""
    return f"{shared_folder(spark)}/lotwerk_tables/{name}"


def publish(chains: DataFrame, name: str) -> None:
    """Publish chains, all of them, in buckets of entities."""
    versions.publish(chains.select(*CHAIN), chains_at(chains.sparkSession, name), "kennung")


def published(spark: SparkSession, name: str) -> DataFrame:
    """The chains that hold; none if nothing was published."""
    found = versions.published(spark, chains_at(spark, name))
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in CHAIN)) if found is None else found


def replace_affected(name: str, batch: DataFrame, events: DataFrame, starts: DataFrame) -> None:
    """rebuild_affected() on the published chains: those of the entities batch touches are replaced in one step.

    Only the buckets with a touched entity are read and written; a reader sees the old chains or the new ones, never a
    mixture, and a job that dies leaves the old ones in place.
    """
    touched, rebuilt = _rebuilt(batch, events, starts)
    versions.replace_keys(cut(rebuilt), touched, chains_at(batch.sparkSession, name), "kennung")


def starts_of(registry: DataFrame) -> DataFrame:
    """(kennung, seit, schluessel) of the registry's rows: the one delivered last, ties by the greater seit and key."""
    newest = F.max(F.struct("geladen_am", day(F.col("seit")).alias("seit"), "schluessel"))
    return registry.filter("kennung is not null").groupBy("kennung").agg(newest.alias("r")).select("kennung", "r.seit", "r.schluessel")


def identifier_history(events: DataFrame, registry: DataFrame, cursor: int) -> DataFrame:
    """Every identifier's versions: chains of the events up to arrival cursor, then brought up to date with the rest.

    Null or unreadable event days and null identifiers are left out; an identifier without events has one version; one
    without a readable seit starts at null; null keys compare equal to each other. Empty log: one version each; empty
    registry: none.
    """
    starts = starts_of(registry)
    base = build_chains(day_facts(events.filter(F.col("id") <= cursor)), starts)
    return rebuild_affected(base, events.filter(F.col("id") > cursor), events, starts)


#: Share of the log's arrivals that p2_found takes as a batch of updates on top of the chains built before.
BATCH_SHARE = 0.05


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "kennung_verlauf", "id", "kennung", "datum", "ereignis", "vorher", "nachher")
    registry = table(spark, folder, "kennung", "kennung", "seit", "schluessel", "geladen_am")
    low, high = events.agg(F.min("id"), F.max("id")).first()
    cursor = int(high - (high - low) * BATCH_SHARE) if high is not None else 0
    name, starts = f"p2_{uuid.uuid4().hex}", cut(starts_of(registry))
    publish(build_chains(day_facts(events.filter(F.col("id") <= cursor)), starts), name)
    replace_affected(name, events.filter(F.col("id") > cursor), events, starts)
    return published(spark, name)


def versions_on(chains: DataFrame, moments: DataFrame) -> DataFrame:
    """moments(kennung, tag as YYYY-MM-DD, ...) with the version that held on that day."""
    hit = chains.withColumnRenamed("kennung", "__k")
    return moments.join(hit, (F.col("kennung") == F.col("__k")) & (F.col("tag") >= F.col("ab")) & (F.col("tag") < F.col("bis"))).drop("__k")


def _day_sql(c: str) -> str:
    return f"CASE WHEN {c} LIKE '__.__.____' THEN CAST(strptime({c}, '%d.%m.%Y') AS DATE) ELSE CAST(substr({c}, 1, 10) AS DATE) END"


SQL = {
    "p2_found": f"""
WITH ev AS (SELECT kennung, {_day_sql('datum')} tag, ereignis, vorher, nachher, min(id) id FROM kennung_verlauf GROUP BY ALL),
st AS (SELECT kennung, min({_day_sql('seit')}) seit, min(schluessel) schluessel FROM kennung GROUP BY kennung),
org AS (SELECT kennung, arg_min(vorher, (tag, id)) v FROM ev WHERE vorher IS NOT NULL GROUP BY kennung),
al AS (
  SELECT st.kennung, seit tag, -1 id, coalesce(v, schluessel) key, 'aktiv' status FROM st LEFT JOIN org USING (kennung)
  UNION ALL
  SELECT kennung, tag, id, CASE WHEN ereignis = 'umbenannt' THEN nachher END,
    CASE ereignis WHEN 'entfallen' THEN 'entfallen' WHEN 'abgeloest' THEN 'abgeloest' WHEN 'reaktiviert' THEN 'aktiv' END
  FROM ev SEMI JOIN st USING (kennung)),
s AS (SELECT kennung, tag, id, last_value(key IGNORE NULLS) OVER w key, last_value(status IGNORE NULLS) OVER w status,
    lead(tag) OVER (PARTITION BY kennung ORDER BY tag, id) nx
  FROM al WINDOW w AS (PARTITION BY kennung ORDER BY tag, id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, lag(key) OVER w pk, lag(status) OVER w ps FROM s WHERE nx IS DISTINCT FROM tag WINDOW w AS (PARTITION BY kennung ORDER BY tag)),
c AS (SELECT * FROM d WHERE ps IS NULL OR pk IS DISTINCT FROM key OR ps <> status)
SELECT kennung, strftime(tag, '%Y-%m-%d') ab, coalesce(strftime(lead(tag) OVER (PARTITION BY kennung ORDER BY tag), '%Y-%m-%d'), '9999-12-31') bis,
  status, key schluessel FROM c
"""
}
QUERIES = {"p2_found": p2_found}
