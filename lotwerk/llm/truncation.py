"""Problem 10: text cut off by field limits or in transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwerk.functions.text import fold
from lotwerk.operators.skew import checked_join
from lotwerk.session import cut
from lotwerk.sources.tables import table

#: A length is a spike of its source and column if it has so many values at least, and more than the mean of the 2 * NEAR
#: lengths about it by SIGMAS standard deviations of a Poisson count.
LEAST, NEAR, SIGMAS = 5, 10, 6
#: Bytes that a cut at a byte limit may leave free because the next character does not fit.
BYTE_SLACK = 3
#: Words at the end of a text that must stand in a quoted text for the end to be a quotation, and pieces between white space
#: at its end in which they are looked for: words broken at line ends and signs take several.
QUOTED, PIECES = 4, 12
#: A line opening is known if lines of SEEN texts have it at least, and is one of notes, not of sentences, if so small a share
#: of these lines ends in a full stop.
SEEN, SENTENCE_SHARE = 5, 0.1
#: White space, what is put behind a cut, remarks that close a text, abbreviations no sentence ends with.
WHITE = " \t\n\r\f ​﻿�"
CUT_MARK = r"</?[A-Za-z][^<>]{0,40}>|…|(?<!\.)\.{3,}|\[\s?(?:…|\.{3})\s?\]|\(\s?(?:…|\.{3}|mehr|weiter|suite|more|continua|segue)\s?\)"
CLOSING = r"(?i)(?:\((?:ende|schluss|fin|fine|end|usw|etc)\.?\)|(?:^|[.!?»)]\s+)(?:ende|schluss|fin|fine|end|usw|etc))$"
AFTER_SENTENCE = r"[.!?»]\s+\([^()]{1,40}\)$"
ABBREVIATION = r"(?:^|[\s(])(?:Art|Abs|Ziff|lit|Nr|Fr|CHF|vgl|bzw|ca|z|z\.\s?B|d|d\.\s?h|p|p\.\s?ex|ch|no|al|let|n|cpv|cfr|cf|e\.g|i\.e)\.$"
OPEN_DATE = r"(?:^|\s)(?:(?:0?[1-9]|[12]\d|3[01])\.(?:0?[1-9]|1[0-2])\.|(?:am|dem|vom|zum|den|le|il|dal)\s\d{1,2}\.)$"
TERMINAL = r"[.!?][\"'»”“’)\]]*$|[\p{L}\p{N},;]\s?[»”]$"
NOTE_LINE = r"^\s*(?:[-•*–—»>]|\[[ xX]?\]|\d+\)\s|[a-z]\)\s|\||[-=_*]{3,}$)|^\s*[A-ZÄÖÜÉÈÀ][\w.\- ]{0,30}:\s|\|\s*$|^\s*(?:Seite|Page|Pagina) \d|^\s*Tel\."
DATE_LINE = r"^[^.!?]{1,40}\d{1,2}\.\d{1,2}\.\d{4}$"
#: A number at the end of a text, its digits told apart from its signs, and a day, which is whole in any number of digits.
END_NUMBER = r"((?:\d[\d .,:'’/+–-]{0,30})?\d)$"
SEVERAL = r"[.!?][\"'»”)]*\s+\p{Lu}"
END_DAY = r"(?:^|[^\d.])\d{1,2}\.\d{1,2}\.\d{4}$"


def spikes(lengths: DataFrame) -> DataFrame:
    """(source, spalte, n, k, mean) of lengths(source, spalte, n), a row a value: the lengths at which the histogram of the
    source's column has a spike. A window has one row a length."""
    count = lengths.groupBy("source", "spalte", "n").agg(F.count("*").alias("k"))
    about = Window.partitionBy("source", "spalte").orderBy("n").rangeBetween(-NEAR, NEAR)
    mean = (F.sum("k").over(about) - F.col("k")) / (2 * NEAR)
    return count.withColumn("mean", mean).filter((F.col("k") >= LEAST) & (F.col("k") > F.col("mean") + SIGMAS * F.sqrt(F.col("mean") + 0.1)))


def length_spikes(values: DataFrame) -> DataFrame:
    """values(id, source, spalte, chars, bytes, ...), a row a text value, with grenze: zeichen, bytes or null, the unit in
    which the value's length is a limit.

    A field that holds at most n characters leaves the texts cut by it at exactly n, the greatest length it has, so the
    histogram of a source and column has a spike there: one for each field that the column was filled from, as a source
    may deliver several. Lengths in characters are tested first; of the values at no spike of characters the lengths in
    bytes are, where a cut may fall up to BYTE_SLACK bytes short of the limit.
    """
    key = ["s", "spalte"]
    v = values.withColumn("s", F.coalesce("source", F.lit("")))
    found = lambda rows, unit: spikes(rows.select(F.col("s").alias("source"), "spalte", F.col(unit).alias("n"))).select(F.col("source").alias("s"), "spalte", "n")
    at_chars = found(v, "chars").select(*key, F.col("n").alias("chars"), F.lit(True).alias("__c"))
    v = checked_join(v, at_chars, [*key, "chars"], how="left")
    slack = F.explode(F.sequence(F.col("n") - BYTE_SLACK, F.col("n")))
    at_bytes = found(v.filter("__c is null"), "bytes").select(*key, slack.alias("bytes")).distinct().withColumn("__b", F.lit(True))
    v = checked_join(v, at_bytes, [*key, "bytes"], how="left")
    return v.withColumn("grenze", F.when(F.col("__c"), "zeichen").when(F.col("__b"), "bytes")).drop("s", "__c", "__b")


def _last_word(line: Column) -> Column:
    """A line's last word; of a line that ends in a digit the shape of its number."""
    number = F.regexp_replace(F.regexp_extract(line, END_NUMBER, 1), r"\d", "0")
    return F.when(line.rlike(r"\d$"), number).otherwise(F.regexp_extract(line, r"(\p{L}+)[^\p{L}\p{N}]*$", 1))


def _first_word(line: Column) -> Column:
    return F.regexp_extract(line, r"^[^\p{L}]*(\p{L}+)", 1)


def endings(documents: DataFrame) -> DataFrame:
    """What the ends of documents(doc_id, source, text) show, one narrow row a text, from the whole text.

    The end is what stands before white space and marks put behind a cut; any says whether there is something. What only
    unfinished endings are asked for is null for the others.
    """
    behind = f"(?:(?<![{WHITE}])[{WHITE}]++|{CUT_MARK})+$"
    t = F.rtrim("text", F.lit(WHITE))
    docs = documents.select("doc_id", "source", "text", t.alias("t"))
    # only a text that ends like a mark can have one behind it
    marked = F.col("t").endswith("...") | F.right("t", F.lit(1)).isin(">", "…", "]", ")")
    docs = docs.withColumn("behind", F.when(marked, F.regexp_extract("t", behind, 0)).otherwise(""))
    docs = docs.withColumn("bare", F.rtrim(F.left("t", F.length("t") - F.length("behind")), F.lit(WHITE)))
    last = F.substring_index("bare", "\n", -1)
    ended = last.rlike(TERMINAL) & ~last.rlike(ABBREVIATION) & ~last.rlike(OPEN_DATE)
    nth = lambda n: F.when(F.regexp_count("bare", F.lit("\n")) >= n - 1, F.rtrim(F.substring_index(F.substring_index("bare", "\n", -n), "\n", 1), F.lit(WHITE)))
    before, above = nth(2), nth(3)
    open_ = lambda c: F.when(~ended, c)
    return docs.select(
        "doc_id",
        "source",
        F.lit("text").alias("spalte"),
        (F.col("bare") != "").alias("any"),
        F.length("text").cast("long").alias("chars"),
        F.octet_length("text").cast("long").alias("bytes"),
        (F.rtrim("behind", F.lit(WHITE)) != "").alias("marked"),
        ended.alias("ended"),
        open_(last.rlike(NOTE_LINE)).alias("note_line"),
        open_(last.rlike(DATE_LINE)).alias("date_line"),
        open_(last.rlike(SEVERAL) & ~last.startswith("|")).alias("several"),
        open_(last.rlike(r"\S\s+\S")).alias("words"),
        open_(last.rlike(CLOSING)).alias("closed"),
        open_(last.rlike(AFTER_SENTENCE)).alias("aside"),
        open_(last.rlike(END_DAY)).alias("end_day"),
        # a line of a block of short lines, as of an address
        open_(
            F.coalesce(F.length(before).between(1, 30) & (F.length(last) <= 40) & ~before.rlike(TERMINAL + r"|[\d§]") & ((F.trim(above) == "") | above.rlike(TERMINAL)), F.lit(False))
        ).alias("block"),
        open_(_first_word(last)).alias("word"),
        open_(_last_word(last)).alias("end_word"),
        open_(F.reverse(F.regexp_extract(F.reverse("bare"), rf"^\S+(?:\s+\S+){{0,{PIECES - 1}}}", 0))).alias("end"),
    )


def line_words(documents: DataFrame) -> DataFrame:
    """(opens, word, seen, full): words that open lines of all texts, how many lines have them and how many of these end in
    a full stop; and words and shapes of numbers that end lines. A text's last line shows no ends: it may be cut itself;
    neither does a line that breaks a word."""
    split = documents.select(F.split(F.rtrim("text", F.lit(WHITE)), "\n").alias("l")).select(F.size("l").alias("of"), F.posexplode("l").alias("i", "line"))
    lines = split.select(F.rtrim("line", F.lit(WHITE)).alias("line"), (F.col("i") + 1 == F.col("of")).alias("is_last")).filter("line <> ''")
    no_end = F.col("is_last") | F.col("line").rlike("[-‐­]$")
    sides = F.array(F.struct(F.lit(True).alias("opens"), _first_word(F.col("line")).alias("word")), F.struct(F.lit(False).alias("opens"), F.when(~no_end, _last_word(F.col("line"))).alias("word")))
    words = lines.select(F.explode(sides).alias("x"), F.col("line").rlike(TERMINAL).alias("full")).filter("x.word <> ''")
    return words.groupBy("x.opens", "x.word").agg(F.count("*").alias("seen"), F.count_if("full").alias("full"))


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, weg, end) of documents(doc_id, source, text) with a text.

    1. Length spikes (see length_spikes): a value at a limit's length without terminal punctuation is cut (weg grenze). A
       check follows: if its last line is a note (below) whose last word, or the shape of whose last number, ends lines
       elsewhere in the corpus, nothing is broken off.
    2. Cuts in transfer have any length, so no histogram shows them: of the other texts one is cut if a mark of a cut
       stands behind its end (weg marke), or if it ends without terminal punctuation, or in an abbreviation or an
       unfinished date (weg ende), unless its last line is a note: a list item, table row, labelled or dated line, a line
       of a block of short lines, or one that opens like lines that hardly ever end a sentence in the whole corpus; or
       it ends in parentheses after a finished sentence. A fixed closing remark, as (Schluss), is never cut.

    Every test looks at the whole text and at whole lines, of any length. Null and empty texts, and those of white space
    only, are not judged; a null source is a source; repeated rows are judged each; an empty table gives no rows.
    """
    facts = cut(length_spikes(cut(endings(documents)).filter("any").drop("any")))
    words = cut(line_words(documents).filter(f"not opens or seen >= {SEEN}"))
    rest = facts.filter("not ended")
    rest = checked_join(rest, words.filter("opens").select("word", (F.col("full") <= SENTENCE_SHARE * F.col("seen")).alias("notes"), (F.col("full") > 0).alias("sentences")), ["word"], how="left")
    rest = checked_join(rest, words.filter("not opens").select(F.col("word").alias("end_word"), F.lit(True).alias("whole")), ["end_word"], how="left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    note = (F.col("note_line") | F.col("block") | (sure(F.col("notes")) & F.col("words")) | (F.col("date_line") & ~sure(F.col("sentences")))) & ~F.col("several")
    whole_word = (F.col("end_word") == "") | sure(F.col("whole")) | F.col("end_day")
    way = F.when(F.col("closed"), F.lit(None)).when(F.col("grenze").isNotNull() & ~(note & whole_word), "grenze").when(F.col("marked"), "marke").when(~(note | F.col("aside")), "ende")
    out = rest.select("doc_id", "source", way.alias("weg"), "end")
    out = facts.filter("ended").select("doc_id", "source", F.lit(None).cast("string").alias("weg"), "end").unionByName(out)
    return out.select("doc_id", "source", F.col("weg").isNotNull().alias("cut"), "weg", "end")


def _spelt(text: Column) -> Column:
    """The words of a text without accents, umlauts in any spelling alike, words broken at a line end whole."""
    t = fold(F.regexp_replace(text, r"-\r?\n\s*", ""))
    for x in ("ae", "oe", "ue"):
        t = F.replace(t, F.lit(x), F.lit(x[0]))
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def not_quoted(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """rows of judged() without the verdict ende where the text ends on a whole word of a quotation from quotes(text): the
    quotation was broken off by whoever quotes, the text is all there. Limits and marks stay."""
    words = quotes.select(_spelt(F.col("text")).alias("w")).filter(F.size("w") >= QUOTED)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - QUOTED + 1), lambda i: F.array_join(F.slice("w", i, QUOTED), " "))
    known = words.select(F.explode(runs).alias("q")).distinct().withColumn("quoted", F.lit(True))
    w = _spelt(F.col("end"))
    asked = F.when(F.col("weg") == "ende", F.array_join(F.slice(w, F.greatest(F.size(w) - QUOTED + 1, F.lit(1)), QUOTED), " "))
    out = checked_join(rows.withColumn("q", asked), known, ["q"], how="left")
    weg = F.when(F.col("quoted").isNull(), F.col("weg"))
    return out.select("doc_id", "source", weg.isNotNull().alias("cut"), weg.alias("weg"), "end")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return not_quoted(judged(table(spark, folder, "documents", "doc_id", "source", "text")), table(spark, folder, "pruefaufgabe", "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).filter("cut").select("doc_id")


def p10_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Texts, cut texts and their share for each source, and how many of them a limit, a mark or the ending showed."""
    by = [F.count_if(F.col("weg") == w).alias(f"n_{w}") for w in ("grenze", "marke", "ende")]
    return _rows(spark, folder).groupBy("source").agg(F.count("*").alias("n"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("rate"), *by)


def p10_limits(spark: SparkSession, folder: str) -> DataFrame:
    """(source, spalte, einheit, n, k): the lengths that are limits of a source's column, and how many values have them.

    Texts of white space only show no limit."""
    docs = table(spark, folder, "documents", "doc_id", "source", "text").filter(F.rtrim("text", F.lit(WHITE)) != "")
    v = docs.select("source", F.lit("text").alias("spalte"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))
    v = cut(length_spikes(v))
    by_chars = spikes(v.select("source", "spalte", F.col("chars").alias("n"))).withColumn("einheit", F.lit("zeichen"))
    by_bytes = spikes(v.filter("grenze is null or grenze <> 'zeichen'").select("source", "spalte", F.col("bytes").alias("n"))).withColumn("einheit", F.lit("bytes"))
    return by_chars.unionByName(by_bytes).select("source", "spalte", "einheit", "n", "k")


def _spike_sql(name: str, rows: str) -> str:
    return f"""{name} AS (SELECT source, n, k FROM (SELECT *, (sum(k) OVER (PARTITION BY source ORDER BY n RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) - k) / {2 * NEAR}.0 m FROM (SELECT source, n, count(*) k FROM {rows} GROUP BY ALL)) WHERE k >= {LEAST} AND k > m + {SIGMAS} * sqrt(m + 0.1))"""


SQL: dict[str, str] = {
    "p10_limits": f"""WITH d AS (SELECT source, length(text) c, strlen(text) b FROM documents WHERE rtrim(text, '{WHITE}') <> ''),
{_spike_sql('c', '(SELECT source, c n FROM d)')},
r AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.n = d.c)),
{_spike_sql('b', '(SELECT source, b n FROM r)')}
SELECT source, 'text' spalte, 'zeichen' einheit, n, k FROM c UNION ALL SELECT source, 'text', 'bytes', n, k FROM b"""
}
QUERIES = {"p10_found": p10_found, "p10_rate": p10_rate, "p10_limits": p10_limits}
