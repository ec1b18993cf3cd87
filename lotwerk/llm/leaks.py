"""Problem 8: evaluation passages in training text, by a positional inverted index."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwerk.operators.skew import MAX_LOOKUP, checked_join, salted_join
from lotwerk.session import cut
from lotwerk.sources.tables import table

#: Words of an item that must stand in a text one after the other.
PASSAGE = 12
#: Rarest terms of a window that are looked up before the rest is verified (less than PASSAGE).
RAREST = 5
#: Rows of what is made of the items up to which they go to every task; beyond, postings are joined to them.
MAX_WORDS = 200_000
#: Words of a part of an item that must stand in a text in their distances before the rest is looked at.
NEED = 3
#: Folders of the index.
BUCKETS = 32
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile("[-‐­]\r?\n\\s*")
_SPELT = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"))


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFC and lower-casing, ä, ö, ü as ae, oe, ue, words broken at a line end whole."""
    if "\n" in text:
        text = _BREAK.sub("", text)
    if text.isascii():
        return _WORD.findall(text.lower())
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower())
    for x, y in _SPELT:
        if x in t:
            t = t.replace(x, y)
    return _WORD.findall(t)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, at, term) of items(item_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, at, w) for i, text in zip(b["item_id"], b["text"]) for at, w in enumerate(words(text))]
            yield pd.DataFrame(rows, columns=["item_id", "at", "term"]).astype({"item_id": "int64", "at": "int32", "term": "object"})

    ok = items.filter("item_id is not null and text is not null").select("item_id", "text")
    return ok.mapInPandas(run, "item_id long, at int, term string")


def build_index(documents: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """The positional index (term, doc_id, n, positions, bucket) of documents(doc_id, text), written to the shared folder.

    It lies there in folders by the hash of the term, each sorted by term, so that a lookup reads the folders and row groups
    of the terms it asks for; a term that holds a large share of all postings is spread over several files. Once written
    the index is never shuffled. vocabulary(term): only its terms are stored; no other term can be asked for by the items
    it comes from. Every word of every text is read.
    """
    sent = None
    if vocabulary is not None:
        few = cut(vocabulary.distinct())
        if few.count() <= MAX_WORDS:
            sent = documents.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in few.collect()))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = sent.value if sent else None
        for b in batches:
            terms: list[str] = []
            docs: list[int] = []
            places: list[int] = []
            counts: list[int] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                at: dict[str, list[int]] = {}
                for i, w in enumerate(words(text)):
                    if keep is None or w in keep:
                        if w in at:
                            at[w].append(i)
                        else:
                            at[w] = [i]
                terms += at
                docs += [doc] * len(at)
                for p in at.values():
                    places += p
                    counts.append(len(p))
            offsets = pa.array([0, *accumulate(counts)], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(docs, pa.int64()), pa.array(counts, pa.int32()), lists], ["term", "doc_id", "n", "positions"])

    ok = documents.filter("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    index = ok.mapInArrow(post, "term string, doc_id long, n int, positions array<int>").withColumn("bucket", _bucket(F.col("term")))
    if vocabulary is not None and sent is None:
        index = index.join(few, "term", "left_semi")
    return cut(index.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), partition_by="bucket")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def look_up(index: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """The postings of asked(term, ...) with asked's columns: by broadcast if asked is known to be few rows, else by a salted join."""
    if not few:
        return salted_join(index, asked, ["term"]).drop("bucket")
    return index.join(F.broadcast(asked.withColumn("bucket", _bucket(F.col("term")))), ["bucket", "term"]).drop("bucket")


def meet(rows: DataFrame, of: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """rows joined to of, several rows a key: by broadcast if of is known to be few rows, else salted."""
    return rows.join(F.broadcast(of), keys) if few else salted_join(rows, of, keys)


def postings_of(index: DataFrame, docs: DataFrame) -> DataFrame:
    """The part of the index with the documents docs(doc_id), as a table of its own."""
    docs = cut(docs.select("doc_id").distinct())
    return cut(index.join(F.broadcast(docs) if docs.count() <= MAX_LOOKUP else docs, "doc_id", "left_semi").select("term", "doc_id", "positions"))


def passages(index: DataFrame, wanted: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, item_id, longest): every text that has passage or more consecutive words of an item, and the most it has.

    index: see build_index; wanted(item_id, at, term). Each window of passage words of an item is looked up by its two
    rarest terms: their postings, less their offsets in the window, must agree; then the next rarest must stand at their
    places too, and what is left is verified word by word. Both look at the postings of the texts that the first step
    left, taken from the index once. Items are looked up whole, in any number of places of any number of texts.
    """
    if passage < 3:
        raise ValueError("a passage has three words at least")
    frequency = index.groupBy("term").agg(F.sum("n").alias("df"))
    known = checked_join(wanted, frequency, ["term"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    known = cut(known)
    few_words = known.count() <= MAX_WORDS
    # windows with a term that no text has cannot occur
    ahead = Window.partitionBy("item_id").orderBy("at").rowsBetween(0, passage - 1)
    rare = F.slice(F.array_sort(F.collect_list(F.struct("df", "term", "at")).over(ahead)), 1, RAREST)
    windows = known.select("item_id", F.count("*").over(ahead).alias("n"), rare.alias("rare")).filter((F.col("n") == passage) & (F.col("rare")[0]["df"] > 0))
    others = F.transform(F.slice("rare", 3, RAREST), lambda x: F.struct(x["term"].alias("term"), x["at"].alias("at")))
    look = cut(
        windows.select("item_id", *(F.col("rare")[i][c].alias(f"{n}{i + 1}") for i in (0, 1) for c, n in (("term", "t"), ("at", "p"))), others.alias("others")).distinct()
    )
    few = look.count() <= MAX_WORDS
    sides = []
    for t, p in (("t1", "p1"), ("t2", "p2")):
        hit = look_up(index, look.select(F.col(t).alias("term"), "item_id", F.col(p).alias(p)).distinct(), few)
        hit = hit.select("doc_id", "item_id", p, F.explode("positions").alias("at"))
        sides.append(hit.select("doc_id", "item_id", p, (F.col("at") - F.col(p)).alias("shift")))
    pairs = look.select("item_id", "p1", "p2").distinct()
    both = cut(meet(sides[0], pairs, ["item_id", "p1"], few).join(sides[1], ["doc_id", "item_id", "shift", "p2"]))
    near = postings_of(index, both)
    # the next rarest terms of the same windows, at their places
    more = meet(both, look.select("item_id", "p1", "p2", "others", F.xxhash64("others").alias("w")), ["item_id", "p1", "p2"], few)
    more = more.select("doc_id", "item_id", "shift", "w", F.size("others").alias("need"), F.explode("others").alias("o")).select("doc_id", "item_id", "shift", "w", "need", "o.term", "o.at").distinct()
    stood = more.join(near, ["doc_id", "term"]).filter(F.array_contains("positions", F.col("shift") + F.col("at")))
    left = stood.groupBy("doc_id", "item_id", "shift", "w").agg(F.count_distinct("at").alias("k"), F.first("need").alias("need")).filter("k = need").select("doc_id", "item_id", "shift").distinct()
    expected = meet(left, known.filter("df > 0").select("item_id", "at", "term"), ["item_id"], few_words)
    met = expected.join(near, ["doc_id", "term"]).filter(F.array_contains("positions", F.col("shift") + F.col("at"))).select("doc_id", "item_id", "shift", "at").distinct()
    order = Window.partitionBy("doc_id", "item_id", "shift").orderBy("at")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(order)).groupBy("doc_id", "item_id", "shift", "run").agg(F.count("*").alias("n"))
    return runs.filter(F.col("n") >= passage).groupBy("doc_id", "item_id").agg(F.max("n").cast("int").alias("longest"))


def near_matches(index: DataFrame, wanted: DataFrame, rarest: int = 8, least: int = 6, slack: int = 5, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, item_id, n_terms): texts where least or more of the rarest words of a part of an item stand about as far
    apart as in it, and the most that do. The parts are every window of passage words, and the whole item by the words it
    has once.

    A word's place in the text less its place in the item is its shift; words whose shifts lie within slack of each
    other count together, so that inserted, left out or changed words between them do no harm. A word of the text counts
    once. Parts are looked up by the words of which NEED must stand if least of all do; the rest is fetched for what is left.
    """
    frequency = index.groupBy("term").agg(F.sum("n").alias("df"))
    known = cut(checked_join(wanted, frequency, ["term"], "left"))
    item = Window.partitionBy("item_id")
    ahead = item.orderBy("at").rangeBetween(0, passage - 1)
    # words that no text has are left out of a window
    word = F.when(F.col("df").isNotNull(), F.struct("df", "term", "at"))
    spans = known.select("item_id", "at", F.max("at").over(item).alias("last"), F.collect_list(word).over(ahead).alias("words"))
    spans = spans.filter((F.col("at") + passage - 1 <= F.col("last")) | (F.col("at") == 0)).select("item_id", F.col("at").alias("start"), "words")
    once = known.groupBy("item_id", "term").agg(F.min("at").alias("at"), F.min("df").alias("df"), F.count("*").alias("k")).filter("k = 1")
    whole = once.groupBy("item_id").agg(F.lit(-1).alias("start"), F.collect_list(word).alias("words"))
    parts = spans.unionByName(whole).select("item_id", "start", F.slice(F.array_sort("words"), 1, rarest).alias("rare")).filter(F.size("rare") >= least)
    parts = cut(parts.groupBy("item_id", "rare").agg(F.min("start").alias("start")).withColumn("part", F.monotonically_increasing_id()))
    # a window lies in the stretch of two passages that begins with the block it begins in; -1: the whole item
    stretch = F.floor(F.col("start") / passage).cast("int").alias("stretch")
    terms = cut(parts.select("part", "item_id", stretch, F.posexplode("rare").alias("r", "x")).select("part", "item_id", "stretch", "r", "x.term", "x.at"))
    few = terms.count() <= MAX_WORDS
    # least of rarest words stand only if NEED of the rarest of them do
    need = min(NEED, least)
    early = terms.filter(F.col("r") < rarest - least + need).select("item_id", "term", "at").distinct()
    hits = look_up(index, early, few).select("doc_id", "item_id", "at", F.explode("positions").alias("p"))
    # neighbouring bins overlap, so that any span of slack lies whole in one of them
    bin_ = F.floor((F.col("p") - F.col("at")) / slack)
    binned = hits.select("doc_id", "item_id", "at", F.explode(F.array(bin_, bin_ - 1)).alias("bin")).distinct()
    begun = cut(binned.groupBy("doc_id", "item_id", "bin").agg(F.count("*").alias("k")).filter(F.col("k") >= need).drop("k"))
    near = postings_of(index, begun)
    far = meet(begun, terms.select("item_id", "term", "at").distinct(), ["item_id"], few).join(near, ["doc_id", "term"])
    stood = far.select("doc_id", "item_id", "bin", "term", "at", F.explode("positions").alias("p")).filter(F.floor((F.col("p") - F.col("at")) / slack).between(F.col("bin"), F.col("bin") + 1))
    # stretch by stretch, then part by part: a term counts as often as it stands in the part and in the text
    placed = cut(meet(stood, terms.select("item_id", "stretch", "term", "at").distinct(), ["item_id", "term", "at"], few))
    dense = placed.select("doc_id", "item_id", "bin", "stretch", "at").distinct().groupBy("doc_id", "item_id", "bin", "stretch").agg(F.count("*").alias("k")).filter(F.col("k") >= least).drop("k")
    some = placed.join(dense, ["doc_id", "item_id", "bin", "stretch"], "left_semi")
    mine = meet(some, terms.drop("r"), ["item_id", "stretch", "term", "at"], few)
    counted = mine.groupBy("doc_id", "item_id", "part", "bin", "term").agg(F.count_distinct("at").alias("a"), F.count_distinct("p").alias("b"))
    scored = counted.groupBy("doc_id", "item_id", "part", "bin").agg(F.sum(F.least("a", "b")).alias("n")).filter(F.col("n") >= least)
    return scored.groupBy("doc_id", "item_id").agg(F.max("n").cast("int").alias("n_terms"))


def leaks(documents: DataFrame, items: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, item_id, longest) of documents(doc_id, text) and items(item_id, text).

    Null ids and texts and empty texts have no words; an item of fewer than passage words is never found; repeated rows
    of a text or an item change nothing; empty tables give no rows; texts may be of any length.
    """
    wanted = cut(item_words(items).distinct())
    return passages(build_index(documents, wanted.select("term")), wanted, passage)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "pruefaufgabe", "item_id", "text")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every item that leaked, in how many texts, and its longest passage in words."""
    found = leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "pruefaufgabe", "item_id", "text"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("longest").alias("longest"))


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with most of the rarest words of an item, or of any PASSAGE-word window of it, in about their distances."""
    wanted = cut(item_words(table(spark, folder, "pruefaufgabe", "item_id", "text")).distinct())
    return near_matches(build_index(table(spark, folder, "documents", "doc_id", "text"), wanted.select("term")), wanted)


_SQL_WORDS = r"regexp_extract_all(replace(replace(replace(nfc_normalize(lower(nfc_normalize(regexp_replace(text, '[-‐­]\r?\n\s*', '', 'g')))), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '[\p{L}\p{N}]+')"
_SQL_RUNS = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} w FROM documents WHERE text IS NOT NULL), q AS (SELECT item_id, {_SQL_WORDS} w FROM pruefaufgabe WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, array_to_string(w[i:i + {PASSAGE - 1}], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {PASSAGE - 2})) i FROM d WHERE len(w) >= {PASSAGE})),
qg AS (SELECT item_id, j, array_to_string(w[j:j + {PASSAGE - 1}], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - {PASSAGE - 2})) j FROM q WHERE len(w) >= {PASSAGE})),
m AS (SELECT DISTINCT doc_id, item_id, i - j shift, i FROM dg JOIN qg USING (g)),
r AS (SELECT doc_id, item_id, shift, i - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) k FROM m),
l AS (SELECT doc_id, item_id, max(n) longest FROM (SELECT doc_id, item_id, shift, k, count(*) + {PASSAGE - 1} n FROM r GROUP BY ALL) GROUP BY ALL)
"""
# every part of an item against every place of its words: least of its rarest words within a span of slack
_SQL_NEAR = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} w FROM documents WHERE text IS NOT NULL), q AS (SELECT item_id, {_SQL_WORDS} w FROM pruefaufgabe WHERE text IS NOT NULL),
dw AS (SELECT doc_id, i - 1 p, w[i] term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) i FROM d)),
qw AS (SELECT item_id, i - 1 o, w[i] term, len(w) n FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) i FROM q)),
f AS (SELECT term, count(*) df FROM dw SEMI JOIN qw USING (term) GROUP BY term),
k AS (SELECT qw.*, df FROM qw JOIN f USING (term)),
win AS (SELECT s.item_id, s.o part, k.df, k.term, k.o FROM qw s JOIN k ON k.item_id = s.item_id AND k.o BETWEEN s.o AND s.o + {PASSAGE - 1} WHERE s.o + {PASSAGE - 1} <= s.n - 1 OR s.o = 0),
one AS (SELECT item_id, -1 part, min(df) df, term, min(o) o FROM k GROUP BY item_id, term HAVING count(*) = 1),
pt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, part ORDER BY df, term, o) r FROM (SELECT * FROM win UNION ALL SELECT * FROM one)) WHERE r <= 8),
pk AS (SELECT pt.* FROM pt SEMI JOIN (SELECT item_id, part FROM pt GROUP BY ALL HAVING count(*) >= 6) USING (item_id, part)),
h AS (SELECT doc_id, item_id, part, pk.term, o, p, CAST(floor((p - o) / 5.0) AS INTEGER) b FROM pk JOIN dw ON dw.term = pk.term),
c AS (SELECT doc_id, item_id, part, bin, term, least(count(DISTINCT o), count(DISTINCT p)) n FROM (SELECT *, unnest([b, b - 1]) bin FROM h) GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) n_terms FROM (SELECT doc_id, item_id, part, bin, sum(n) n FROM c GROUP BY ALL HAVING sum(n) >= 6) GROUP BY ALL
"""
SQL = {
    "p8_found": _SQL_RUNS + "SELECT doc_id, item_id FROM l",
    "p8_near": _SQL_NEAR,
    "p8_items": _SQL_RUNS + "SELECT item_id, count(*) n_documents, CAST(max(longest) AS INTEGER) longest FROM l GROUP BY item_id",
}
QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p8_near": p8_near}
