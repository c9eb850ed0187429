"""String helpers: URL repair, emptiness, missing-field defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults for absent fields - "None" in the hit table,
# "Unknown" for an absent non-base category in context rows.
MISSING = "None"
UNKNOWN = "Unknown"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repair_url(url: str | Column) -> Column:
    """Prefix ``https://`` unless the URL already starts with ``http://`` or
    ``https://`` (case-sensitive, as a link renderer needs)."""
    u = _col(url)
    ok = u.startswith("http://") | u.startswith("https://")
    return F.when(u.isNull(), F.lit(None).cast("string")).when(ok, u).otherwise(F.concat(F.lit("https://"), u))


def is_blank(c: str | Column) -> Column:
    """NULL or empty string."""
    return F.coalesce(_col(c).cast("string"), F.lit("")) == ""


def or_missing(c: str | Column, default: str = MISSING) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(default))
