"""Text normal forms as Column expressions, JVM-side."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def _folding() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is an ASCII letter or digit and marks, and those letters."""
    src, dst = [], []
    for code in range(0x80, min(0x10000, sys.maxunicode)):
        d = unicodedata.normalize("NFD", chr(code))
        if len(d) > 1 and d[0].isascii() and d[0].isalnum() and all(unicodedata.combining(x) for x in d[1:]):
            src.append(chr(code))
            dst.append(d[0].lower())
    return "".join(src), "".join(dst)


def fold(text: Column) -> Column:
    """Lower case without accents and combining marks."""
    src, dst = _folding()
    return F.regexp_replace(F.translate(F.lower(text), src, dst), r"\p{M}+", "")


def norm_name(text: Column) -> Column:
    """fold(), every run of characters other than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))
