"""Dates written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(text: Column) -> Column:
    """YYYY-MM-DD, the same with a time after T, or DD.MM.YYYY as a date; null when it is no real day."""
    t = F.trim(text)
    head = F.substring(t, 1, 10)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ])"), F.try_to_date(head, "yyyy-MM-dd")).when(
        t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(t, "d.M.yyyy")
    )


def day_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")
