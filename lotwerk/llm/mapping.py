"""Problem 3: mapping freely typed names to the entries of a canonical list."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwerk.operators.skew import checked_join
from lotwerk.session import cut
from lotwerk.sources.tables import table

#: Entries of the reference list that are sent to the tasks at a time.
MAX_CANON = 50_000
#: Share of the letters of two sets of words that they must have in common.
SIMILAR = 0.7
#: What must be left of that share when the share of letters that are spelt wrong is taken off.
CLOSE = 0.5
#: Distinct names that one task judges.
NAMES_A_TASK = 4_000
_UMLAUTS = str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "ss", "à": "a", "â": "a", "é": "e", "è": "e", "ê": "e", "ç": "c", "ô": "o", "î": "i"})


def normal(text: str) -> str:
    """Lower-case words: mis-decoded UTF-8 mended, umlauts in any spelling alike, digits that stand for letters in words
    turned back, a hyphenated line or word break closed."""
    if "Ã" in text or "Â" in text:
        for codec in ("cp1252", "latin-1"):
            try:
                text = text.encode(codec).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    text = re.sub(r"(?<=[a-zäöü])(?=[A-ZÄÖÜ][a-zäöü])", " ", text)
    text = text.lower().translate(_UMLAUTS)
    text = re.sub(r"(?<=[a-z])0|0(?=[a-z]{2})", "o", text)
    text = re.sub(r"(?<=[a-z])1(?=[a-z])|(?<![0-9])\b1(?=[a-z]{2})", "i", text)
    text = text.replace("ae", "a").replace("oe", "o").replace("ue", "u")
    return re.sub(r"[^a-z0-9?�]+", " ", text).strip()


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours from a to b; most + 1 if it takes more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        low = i
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y and x not in "?�"))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row[j] = v
            low = min(low, v)
        if low > most:
            return most + 1
    return row[-1]


def _allowed(length: int) -> int:
    """Edits that a word of so many letters may have."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 10 else 3 if length < 16 else 4


def _telling(words: Sequence[str]) -> tuple[str, ...]:
    """words without single letters and numbers, unless there are no others."""
    return tuple(w for w in words if len(w) > 1 and not w.isdigit()) or tuple(words)


class Matcher:
    """One area's entries: an automaton of their names and aliases, and an index of the same names by their words.

    Entry names are sets of words. A word of a value is the same as a word of a name if it takes few edits by its length
    (see _allowed), and neighbouring words of the value may be one word that was split. Two sets are compared by letters:
    those of the words they share, of all letters of both.
    """

    def __init__(self, entries: list[tuple[int, str]]):
        import ahocorasick

        known: dict[tuple[str, ...], int] = {}
        for id_, name in entries:
            if n := normal(name):
                known.setdefault(tuple(n.split()), id_)
        self.entries = [(_telling(words), id_) for words, id_ in known.items()]
        self.entries += [(("".join(words),), id_) for words, id_ in known.items() if len(words) > 1]
        self.automaton = ahocorasick.Automaton()
        for words, id_ in known.items():
            joined = "".join(words)
            if not self.automaton.exists(joined):
                self.automaton.add_word(joined, (len(joined), id_))
        if known:
            self.automaton.make_automaton()
        self.begun = sorted(("".join(words), id_) for words, id_ in known.items())
        seen = Counter(w for words, _ in self.entries for w in set(words))
        self.vocabulary: list[str] = sorted(seen)
        at = {w: i for i, w in enumerate(self.vocabulary)}
        self.grams: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.vocabulary):
            for g in set(self._grams(w)):
                self.grams[g].append(i)
        # a name is posted under its rarest words, as many as one of must be shared when SIMILAR of its letters are
        self.posted: dict[int, list[int]] = defaultdict(list)
        for k, (words, _) in enumerate(self.entries):
            rest = whole = sum(map(len, words))
            for w in sorted(set(words), key=lambda w: (seen[w], -len(w), w)):
                if rest < SIMILAR * whole:
                    break
                self.posted[at[w]].append(k)
                rest -= len(w)
        self._same: dict[str, dict[str, int]] = {}

    @staticmethod
    def _grams(t: str) -> list[str]:
        t = f"^{t}$"
        return [t[i : i + 2] for i in range(len(t) - 1)]

    def same(self, word: str) -> dict[str, int]:
        """The words of entry names that word may be, with the edits it takes."""
        if word not in self._same:
            if len(self._same) > 50_000:
                self._same.clear()
            found: dict[str, int] = {}
            if len(word) <= 2 * self.longest():
                shared = Counter(i for g in set(self._grams(word)) for i in self.grams.get(g, ()))
                for i, n in shared.items():
                    w = self.vocabulary[i]
                    most = max(_allowed(len(w)), len(w) == 3)
                    if n >= len(set(self._grams(w))) - 3 * most - 1 and (d := edits(word, w, most)) <= most:
                        found[w] = d
            self._same[word] = found
        return self._same[word]

    def longest(self) -> int:
        return max(map(len, self.vocabulary), default=0)

    def mention(self, value: str) -> tuple[int, int]:
        """(letters, entry) of the longest name that stands in value as whole words, blanks aside; (0, 0) if none does."""
        best = (0, 0, 0)
        if self.entries:
            begins, ends, at = set(), set(), 0
            for w in value.split():
                begins.add(at)
                at += len(w)
                ends.add(at)
            for end, (length, id_) in self.automaton.iter(value.replace(" ", "")):
                if end + 1 in ends and end + 1 - length in begins:
                    best = max(best, (length, -end, id_))
        return best[0], best[2]

    def similar(self, value: str) -> tuple[int, float, int]:
        """(kind, score, entry) of the name whose set of words is most like value's.

        Kind 2: the sets share SIMILAR of their letters. Kind 1: all of the name's words stand in value among others, spelt
        closer than would do otherwise. (0, 0, 0): neither.
        """
        words = _telling(value.split())
        letters = sum(map(len, words))
        units = [(i, i + k, "".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
        if 3 < len(words) <= 8:
            units.append((0, len(words), "".join(words)))
        places: dict[str, list[tuple[int, int, int, int]]] = defaultdict(list)
        for i, j, u in units:
            for w, d in self.same(u).items():
                places[w].append((d, i - j, i, j))
        best = (0, 0.0, 0)
        for k in {k for w in places for k in self.posted.get(bisect_left(self.vocabulary, w), ())}:
            name, id_ = self.entries[k]
            used: set[int] = set()
            common = wrong = 0
            for w in sorted(name, key=len, reverse=True):
                if len(w) == 3 and len(name) == 1:
                    continue
                for d, _, i, j in sorted(places.get(w, ())):
                    if used.isdisjoint(range(i, j)):
                        used.update(range(i, j))
                        common += len(w)
                        wrong += d
                        break
            whole = sum(map(len, name))
            share = common / (whole + letters - sum(len(words[i]) for i in used))
            if share >= SIMILAR and share - wrong / whole >= CLOSE:
                best = max(best, (2, share - wrong / whole, -id_))
            elif common == whole >= 5 and wrong < max(1, _allowed(whole)):
                best = max(best, (1, whole - wrong, -id_))
        return best[0], best[1], -best[2]

    def cut_off(self, piece: str) -> int:
        """The entry whose name begins with piece, a name cut off by a short field; of several the first. A longer piece
        may have one edit in its second half."""
        if len(piece) < 4:
            return 0
        for most, head in ((0, piece), (1, piece[: (len(piece) + 1) // 2])) if len(piece) >= 7 else ((0, piece),):
            found = set()
            for name, id_ in self.begun[bisect_left(self.begun, (head,)) :]:
                if not name.startswith(head):
                    break
                if len(name) > len(piece) and edits(piece, name[: len(piece)], most) <= most:
                    found.add(id_)
            if found:
                return min(found)
        return 0

    def judge(self, value: str) -> tuple[int, float, int]:
        """(kind, score, entry): 3 a mention, 2 and 1 by similar(), 0 a name cut off or, with entry 0, nothing. Of two
        reference lists the greater result holds."""
        if not (v := normal(value)):
            return 0, 0.0, 0
        letters, id_ = self.mention(v)
        if id_:
            return 3, float(letters), id_
        kind, score, id_ = self.similar(v)
        if kind:
            return kind, score, id_
        return 0, 0.0, self.cut_off(v.replace(" ", ""))

    def __call__(self, value: str) -> int:
        return self.judge(value)[2]


def _lists(canon: DataFrame) -> Iterator[dict[str, list[tuple[int, str]]]]:
    """The names and aliases of canon(kanon_id, bereich, bezeichnung, auch) by area, in lists of about MAX_CANON entries."""
    canon = canon.select("kanon_id", "bereich", "bezeichnung", "auch").filter("kanon_id is not null and bereich is not null")
    lists = max(1, -(-canon.count() // MAX_CANON))
    for k in range(lists):
        areas: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for r in canon.filter(F.pmod(F.xxhash64("kanon_id"), F.lit(lists)) == k).orderBy("kanon_id").collect():
            also = json.loads(r.auch) if r.auch else []
            areas[r.bereich] += [(r.kanon_id, n) for n in [r.bezeichnung, *also] if n]
        yield areas


def map_names(rows: DataFrame, canon: DataFrame) -> DataFrame:
    """rows(bereich, name, ...) with kanon_id, the entry of canon of that area that name means, 0 if none fits.

    Every distinct name is judged once, whatever number of rows has it: an automaton over all names and aliases finds
    whole names embedded in it, the longest one winning; what has no mention is compared as a set of words with the names
    that share one of their rarest words (see Matcher), and at last as the beginning of a name cut off. A reference list
    beyond MAX_CANON entries is taken in several lists, each sent to the tasks in turn; the best result of all holds. Null
    and blank names and those of an area without entries: 0. A name may be of any length; empty tables give no rows; other
    columns stay, but a kanon_id of rows is replaced.
    """
    spark = rows.sparkSession
    names = cut(rows.filter("bereich is not null and name is not null").groupBy("bereich", "name").agg(F.count("*").alias("__n")))
    # names are few beside rows, judging them is the work: a fixed number of them a task, and each judged once
    spread = names.repartition(max(1, -(-names.count() // NAMES_A_TASK)), "bereich", "name")
    judged = None
    for areas in _lists(canon):
        sent = spark.sparkContext.broadcast(areas)

        def judge(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own: dict[str, Matcher] = {}
            for b in batches:
                out = []
                for area, name in zip(b["bereich"], b["name"]):
                    if area not in own:
                        own[area] = Matcher(sent.value.get(area, []))
                    out.append((area, name, *own[area].judge(name)))
                yield pd.DataFrame(out, columns=["bereich", "name", "kind", "score", "kanon_id"])

        one = spread.mapInPandas(judge, "bereich string, name string, kind int, score double, kanon_id long")
        judged = one if judged is None else judged.unionByName(one)
    best = F.max(F.struct("kind", (F.col("kanon_id") > 0).alias("any"), "score", (-F.col("kanon_id")).alias("minus")))
    judged = judged.groupBy("bereich", "name").agg(best.alias("b")).select("bereich", "name", (-F.col("b.minus")).alias("kanon_id"))
    return checked_join(rows.drop("kanon_id"), judged, ["bereich", "name"], "left").withColumn("kanon_id", F.coalesce("kanon_id", F.lit(0)))


def typed_names(spark: SparkSession, folder: str) -> DataFrame:
    """(tabelle, satz, bereich, name) of the three columns of free names, one row a record: that of its newest row, ties by name."""
    at = F.col("geladen_am")
    parts = [
        ("data_subfield", "teilfeld", "name", at, ["id"], F.col("id").cast("string")),
        ("beilage", "beilage", "bezeichnung", at, ["id"], F.col("id").cast("string")),
        ("formular_partei", "partei", "bezeichnung", None, ["form_id", "partei_nr"], F.concat_ws("-", F.col("form_id").cast("string"), F.col("partei_nr").cast("string"))),
    ]
    rows = None
    for name, area, column, when, key, satz in parts:
        t = table(spark, folder, name, *key, column, *["geladen_am"] * (when is not None))
        part = t.select(F.lit(name).alias("tabelle"), satz.alias("satz"), F.lit(area).alias("bereich"), F.col(column).alias("name"), (F.lit(None) if when is None else when).cast("timestamp_ntz").alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("tabelle", "satz", "bereich").agg(F.max(F.struct("at", "name")).getField("name").alias("name"))


def unmatched_input(rows: DataFrame, canon: DataFrame) -> DataFrame:
    """rows whose name is neither blank nor, character for character, an entry's name of its area."""
    exact = canon.select("bereich", F.col("bezeichnung").alias("name")).distinct().withColumn("exact", F.lit(True))
    some = rows.filter(F.col("name").isNotNull() & (F.regexp_replace("name", r"[\s\u00a0]+", "") != ""))
    return checked_join(some, exact, ["bereich", "name"], "left").filter("exact is null").drop("exact")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    canon = table(spark, folder, "kanon_begriff")
    rows = cut(unmatched_input(typed_names(spark, folder), canon))
    return map_names(rows, canon).select("tabelle", "satz", "kanon_id")


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Names that fit no entry, with the number of records that have them."""
    canon = table(spark, folder, "kanon_begriff")
    rows = map_names(unmatched_input(typed_names(spark, folder), canon), canon)
    return rows.filter("kanon_id = 0").groupBy("tabelle", "name").agg(F.count("*").alias("n"))


SQL: dict[str, str] = {}
QUERIES = {"p3_found": p3_found, "p3_unmatched": p3_unmatched}
