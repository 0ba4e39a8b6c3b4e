"""Column functions on label texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_form(c: Column) -> Column:
    """Lower case, trimmed, blanks and hyphens read as underscores; blank texts become null."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s\-]", "_"), F.lit(""))


def millis(c: Column) -> Column:
    """Seconds as whole milliseconds; NaN counts as missing."""
    return F.round(F.nanvl(c, F.lit(None).cast("double")) * 1000).cast("bigint")


def stop_time(start: Column, end: Column, duration: Column) -> Column:
    """``end``, or start plus duration where it is missing."""
    return F.coalesce(end, start + duration)
