"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months as written in dates.
MONTHS = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"]
#: Fixed value: divisor days of a retention period's unit.
DAYS_OF = {"jahre": 365, "monate": 30}


def norm_label(c: Column) -> Column:
    """A label without trailing colons and asterisks, white space made one, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[\s:*]+$", ""), r"\s+", " ")))


def spelt_out(c: Column) -> Column:
    """Lower case with ß, ä, ö, ü as ss, ae, oe, ue, dashes alike and white space made one."""
    low = F.lower(c)
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.translate(low, "‐‑–—", "----"), r"\s+", " "))


def slug(c: Column, most: int = 80) -> Column:
    """spelt_out() with everything but a-z and 0-9 as single hyphens, none at the ends, most characters long."""
    return F.substring(F.regexp_replace(F.regexp_replace(spelt_out(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def tokens(c: Column, longer_than: int = 3) -> Column:
    """The sorted set of words longer than so many letters."""
    words = F.split(F.regexp_replace(spelt_out(c), "[^a-z0-9]+", " "), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > longer_than)))


def matches_set(c: Column, pattern: str, sep: str = "|") -> Column:
    """All matches of pattern, sorted, each once, joined by sep."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))), sep)


def thousands(c: Column) -> Column:
    """1234567 as 1'234'567."""
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("'"))


def half_up_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded half up."""
    return F.floor((200 * part + whole) / (2 * whole)).cast("long")


def german_date(c: Column) -> Column:
    """1. Januar 2026, 1.1.2026 or 2026-01-01 as a date, null if there is no such day."""
    t = F.lower(F.trim(c))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(t, r"^\d{1,2}\.\s*([a-zä]+)\s+\d{4}$", 1))
    worded = F.concat_ws("-", F.regexp_extract(t, r"(\d{4})$", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, r"^(\d{1,2})\.", 1), 2, "0"))
    return F.coalesce(F.when(month > 0, F.try_to_date(worded, "yyyy-MM-dd")), F.try_to_date(t, "d.M.yyyy"), F.try_to_date(t, "yyyy-MM-dd"))


def plus_period(start: Column, value: Column, unit: Column) -> Column:
    """start plus value units of 365 (jahre) or 30 (monate) days."""
    return F.date_add(start, (value * F.when(unit == "jahre", DAYS_OF["jahre"]).otherwise(DAYS_OF["monate"])).cast("int"))


def check_digit(digits: Column) -> Column:
    """The check digit of a text of digits, weights 1 and 3 in turn from the left."""
    each = F.transform(F.split(digits, ""), lambda x, i: x.cast("int") * F.when(i % 2 == 0, 1).otherwise(3))
    return ((10 - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("long")


def fingerprint(*columns: Column, length: int = 12) -> Column:
    """The first characters of the SHA-256 of the columns' texts, null as empty, joined by a separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256), 1, length)


def json_list(c: Column) -> Column:
    """A JSON list of texts as an array; also one that was encoded twice; null, empty and other text: an empty array."""
    of = lambda x: F.from_json(x, "array<string>")
    inner = F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x")
    return F.coalesce(F.when(c.rlike(r"^\s*\["), of(c)), F.when(c.rlike(r'^\s*"'), of(inner)), F.array().cast("array<string>"))


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts are the same value, whatever their spacing and order of keys; null only equals null."""
    canon = lambda c: F.coalesce(F.to_json(F.try_parse_json(c)), c)
    return canon(a).eqNullSafe(canon(b))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def visible_text(html: Column) -> Column:
    """Markup's visible text: scripts, styles, comments and tags out, the common entities decoded, white space one."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def hex_rgb(c: Column) -> Column:
    """(r, g, b) of a colour as rrggbb."""
    return F.struct(*(F.conv(F.substring(c, 1 + 2 * i, 2), 16, 10).cast("int").alias(n) for i, n in enumerate("rgb")))


def encrypt(c: Column, key: Column) -> Column:
    """AES-GCM in hexadecimal, the nonce in front."""
    return F.hex(F.aes_encrypt(c, key, F.lit("GCM")))


def decrypt(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unhex(c), key, F.lit("GCM")).cast("string")


def flat_text(c: Column) -> Column:
    """A text in one line: words broken at a line end whole, white space made one."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "-\n", ""), r"\s+", " "))


def standard_code(c: Column) -> Column:
    """44, eCH44 or eCH-0044 as eCH-0044."""
    return F.concat(F.lit("eCH-"), F.lpad(F.regexp_extract(c, "([0-9]+)", 1), 4, "0"))


def mend_encoding(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, where it shows signs of that, read as UTF-8."""
    return F.when(c.rlike("[ÃÂ][\u0080-¿]"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)


def luminance(c: Column) -> Column:
    """Relative luminance of a colour as rrggbb."""
    rgb = hex_rgb(c)
    part = lambda n: F.when(rgb[n] / 255 <= 0.03928, rgb[n] / 255 / 12.92).otherwise(F.pow((rgb[n] / 255 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * part("r") + 0.7152 * part("g") + 0.0722 * part("b")


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colours, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
