"""Problem 9: mixing sources to target weights along a curriculum that changes with time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwerk.operators.skew import checked_join
from lotwerk.session import cut
from lotwerk.sources.tables import table

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.json"
#: Sources up to which their targets are broadcast.
MAX_SOURCES = 10_000
#: Documents of a source that one window may hold.
BLOCK = 16_384
#: How strongly, at most, a source's weight rises or falls from start to end in the default curriculum.
TILT = 0.5


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of documents(doc_id, source, text), one row a doc_id, whole texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(f"{folder}/{name}")
        tok.encode_special_tokens = True
        for b in batches:
            n = []
            for i in range(0, len(b), 64):
                n += [len(e) for e in tok.encode_batch_fast(list(b["text"][i : i + 64]), add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": n})

    ok = documents.filter("doc_id is not null and source is not null and text is not null and text <> ''").select("doc_id", "source", "text")
    counted = ok.mapInPandas(count, "doc_id long, source string, tokens long")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens").filter("tokens > 0")


def plan(available: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, share, repeats, available, usable, demand): what each source with a target gives, any number of them.

    available(source, tokens): sums. targets(source, anteil, max_wiederholung). A source without text or repeats cannot
    give anything; the other shares are scaled up to 1. Without total, the set is as large as it can be with every
    usable source at its share and none repeated more often than allowed; a larger total leaves scarce sources short.
    """
    asked = targets.filter("source is not null and anteil > 0").groupBy("source").agg(F.sum("anteil").alias("share"), F.max("max_wiederholung").alias("repeats"))
    rows = asked.join(available.withColumnRenamed("tokens", "available"), "source", "left")
    rows = cut(rows.select("source", "share", F.greatest(F.coalesce("repeats", F.lit(0)), F.lit(0)).alias("repeats"), F.coalesce("available", F.lit(0)).alias("available")))
    there = (F.col("available") > 0) & (F.col("repeats") > 0)
    most = F.col("available") * F.col("repeats")
    whole, scarcest = rows.filter(there).agg(F.sum("share"), F.min(most / F.col("share"))).first()
    size = float(total) if total is not None else (scarcest or 0.0) * (whole or 0.0)
    rows = rows.withColumn("usable", F.when(there, F.col("share") / F.lit(whole or 1.0)).otherwise(0.0))
    return rows.withColumn("demand", F.least(F.lit(size) * F.col("usable"), most.cast("double")))


def default_schedule(rows: DataFrame) -> DataFrame:
    """(source, pieces) of rows of plan(): sources that may be repeated more often gain weight with time, the others lose it.

    Weights are linear, add up to 1 at every time, and every source's mean weight is its share of demand.
    """
    used = rows.filter("demand > 0")
    low, high, whole = used.agg(F.min("repeats"), F.max("repeats"), F.sum("demand")).first()
    raw = F.lit(TILT) * (F.col("repeats") - F.lit(low or 0)) / F.lit((high or 0) - (low or 0) or 1)
    mean = used.agg(F.sum(F.col("demand") / F.lit(whole or 1.0) * raw)).first()[0] or 0.0
    zero, one = F.lit(0.0), F.lit(1.0)
    piece = F.struct(zero.alias("c0"), one.alias("c1"), zero.alias("t0"), one.alias("t1"), (1 - (raw - F.lit(mean))).alias("w0"), (1 + (raw - F.lit(mean))).alias("w1"))
    return used.select("source", F.array(piece).alias("pieces"))


def segments(schedule: dict[str, list[tuple[float, float]]]) -> list[tuple]:
    """(source, t0, t1, w0, w1, c0, c1): the schedule's pieces with the share of the source's demand due before and after."""
    out = []
    for source, knots in schedule.items():
        knots = sorted((float(t), float(w)) for t, w in knots)
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        whole, done = sum(areas), 0.0
        for (a, b), area in zip(zip(knots, knots[1:]), areas):
            if whole and area:
                out.append((source, a[0], b[0], a[1] / whole, b[1] / whole, done / whole, (done + area) / whole))
            done += area
    return out


def mix(counts: DataFrame, targets: DataFrame, total: int | None = None, schedule: dict[str, list[tuple[float, float]]] | None = None) -> DataFrame:
    """(position, doc_id, kopie, source, tokens): the training order, sorted by position in range partitions.

    counts(doc_id, source, tokens), targets as in plan(). A source's documents stand in hash order, pass after pass; the
    cumulative tokens before the middle of a copy are its demand, and the time at which the integral of the source's
    weight schedule reaches that demand is its position in [0, 1]. Copies whose middle lies beyond the source's demand
    are not used, so that it is met to half a document. kopie counts from 1 to max_wiederholung at most.

    Cumulative sums are taken in blocks of hash order and then over the blocks, so that a source of any size is never in
    one window. Sources without a target, or null, give nothing; a target without text gives nothing; empty: no rows.
    """
    spark = counts.sparkSession
    counts = cut(counts.select("doc_id", "source", "tokens"))
    rows = plan(counts.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets, total)
    if schedule is None:
        pieces = default_schedule(rows)
    else:
        parts = spark.createDataFrame(segments(schedule), "source string, t0 double, t1 double, w0 double, w1 double, c0 double, c1 double")
        pieces = parts.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("c0", "c1", "t0", "t1", "w0", "w1"))).alias("pieces"))
    # no source is passed through more often than its demand asks for
    passes = F.least(F.col("repeats"), F.ceil(F.col("demand") / F.col("available"))).cast("int")
    want = rows.filter("demand > 0").select("source", "demand", "available", passes.alias("passes")).join(pieces, "source")
    bits = max(0, (counts.count() // BLOCK).bit_length())
    docs = counts.withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    docs = docs.withColumn("block", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    # block sums of a source, then what comes before each block; at most 2**bits rows a source
    sums = docs.groupBy("source", "block").agg(F.sum("tokens").alias("sum"))
    base = sums.select("source", "block", (F.sum("sum").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).alias("base"))
    inside = Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("within", F.sum("tokens").over(inside) - F.col("tokens")).join(base, ["source", "block"])
    placed = checked_join(placed, want, ["source"], most=MAX_SOURCES)
    copies = placed.withColumn("kopie", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    middle = (F.col("kopie") - 1) * F.col("available") + F.col("base") + F.col("within") + F.col("tokens") / 2
    used = copies.withColumn("due", middle / F.col("demand")).filter("due < 1")
    p = used.withColumn("p", F.get(F.filter("pieces", lambda x: (x["c0"] <= F.col("due")) & (F.col("due") < x["c1"] + 1e-12)), F.lit(0)))
    rise = (F.col("p.w1") - F.col("p.w0")) / (F.col("p.t1") - F.col("p.t0"))
    rest = F.col("due") - F.col("p.c0")
    # w0 * x + rise / 2 * x**2 = rest, in the form that is stable for a rise near 0
    x = 2 * rest / (F.col("p.w0") + F.sqrt(F.greatest(F.col("p.w0") * F.col("p.w0") + 2 * rise * rest, F.lit(0.0))))
    out = p.select((F.col("p.t0") + F.coalesce(x, F.lit(0.0))).alias("position"), "doc_id", F.col("kopie").cast("int").alias("kopie"), "source", "tokens")
    return out.repartitionByRange("position", "doc_id", "kopie").sortWithinPartitions("position", "doc_id", "kopie")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(token_counts(table(spark, folder, "documents", "doc_id", "source", "text")), table(spark, folder, "mischziel", "source", "anteil", "max_wiederholung"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For each target: its share, the tokens there are and those in the set, the share reached, and the most uses of a document."""
    targets = table(spark, folder, "mischziel", "source", "anteil", "max_wiederholung")
    counts = cut(token_counts(table(spark, folder, "documents", "doc_id", "source", "text")))
    mixed = mix(counts, targets).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("kopie").alias("uses"))
    there = counts.groupBy("source").agg(F.sum("tokens").alias("available"))
    whole = mixed.agg(F.sum("tokens").alias("whole")).withColumn("one", F.lit(1))
    return (
        targets.join(there, "source", "left")
        .join(mixed, "source", "left")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(whole), "one")  # one row
        .select(
            "source",
            "anteil",
            F.coalesce("available", F.lit(0)).alias("available"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("reached"),
            F.coalesce("uses", F.lit(0)).alias("uses"),
            "max_wiederholung",
        )
    )


SQL: dict[str, str] = {}
QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
