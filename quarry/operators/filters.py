"""Compound post filter: date window, term sets, issue-score ranges, type exclusion.

A :class:`FilterSpec` is the user's selection; :func:`predicate` turns it into a
single Spark ``Column`` (omitting empty parts), so Catalyst can push the whole
conjunction into the scan.  Apply it *before* ranking (pre-filtered search).
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.dates import day_range

# The selection sentinel meaning "no filter on this field" and
# the post type excluded from searches.
ANY = "Any"
COMMENT = "comment"

TWO_LEVEL = "two_level"
ONE_LEVEL = "one_level"
BASE = "base"

CATEGORY = "category"
CATEGORY_ONE = "misc.category_one"
CATEGORY_TWO = "misc.category_two"
LANGUAGE = "language_text"
COUNTRY = "country"
DATE = "date_ts"
TYPE = "type"


def terms(selected: Sequence[str] | None) -> list[str]:
    """Selection -> term list; ``None``, ``[]`` or any list containing "Any" -> no terms."""
    if selected is None or ANY in selected:
        return []
    return list(selected)


def parse_range(spec: str) -> tuple[float, float]:
    lo, hi = spec.split(":")
    return float(lo), float(hi)


def active_thresholds(thresholds: Mapping[str, str | tuple[float, float]] | None) -> dict[str, tuple[float, float]]:
    """Keep fields whose range is not the inactive (0.0, 0.0)."""
    out: dict[str, tuple[float, float]] = {}
    for f, r in (thresholds or {}).items():
        lo, hi = parse_range(r) if isinstance(r, str) else (float(r[0]), float(r[1]))
        if (lo, hi) != (0.0, 0.0):
            out[f] = (lo, hi)
    return out


@dataclass(frozen=True)
class SchemeRules:
    """Which category scheme an index uses, by substring of its name."""

    two_level: tuple[str, ...] = ()
    one_level: tuple[str, ...] = ()

    def for_name(self, name: str) -> str:
        if any(m in name for m in self.two_level):
            return TWO_LEVEL
        if any(m in name for m in self.one_level):
            return ONE_LEVEL
        return BASE

    def leveled(self, index_col: str = "index_name") -> Column:
        """Whether a post's own index uses the one- or two-level scheme."""
        c = F.coalesce(F.col(index_col), F.lit(""))
        marks = [c.contains(m) for m in (*self.two_level, *self.one_level)]
        return functools.reduce(operator.or_, marks) if marks else F.lit(False)

    def column(self, index_col: str = "index_name") -> Column:
        """Per-row scheme of each post's own index (JVM-side CASE)."""
        c = F.col(index_col)
        expr = F.lit(BASE)
        for scheme, markers in ((ONE_LEVEL, self.one_level), (TWO_LEVEL, self.two_level)):
            for m in markers:
                expr = F.when(c.contains(m), F.lit(scheme)).otherwise(expr)
        return expr


def category_value(scheme: str | Column) -> Column:
    """First-level category of a post under a scheme (fixed string or per-row Column)."""
    if isinstance(scheme, str):
        return F.col(CATEGORY) if scheme == BASE else F.col(CATEGORY_ONE)
    return F.when(scheme == BASE, F.col(CATEGORY)).otherwise(F.col(CATEGORY_ONE))


@dataclass(frozen=True)
class FilterSpec:
    start_date: object = None
    end_date: object = None
    category_one: Sequence[str] | None = None
    category_two: Sequence[str] | None = None
    language: Sequence[str] | None = None
    country: Sequence[str] | None = None
    thresholds: Mapping[str, str] | None = None
    exclude_comments: bool = True
    # Category routing: a fixed scheme for the whole selection (the selection
    # string decides), or ``None`` to route per post by its own index name.
    scheme: str | None = None
    rules: SchemeRules = field(default_factory=SchemeRules)


def _in(c: Column, values: list[str]) -> Column:
    return c.isin(values)


def issue_predicate(thresholds: Mapping[str, str] | None) -> Column | None:
    """OR of inclusive ranges over the active issue fields; a missing score never matches."""
    act = active_thresholds(thresholds)
    if not act:
        return None
    ors = [F.col(f).between(lo, hi) for f, (lo, hi) in act.items()]
    return functools.reduce(operator.or_, ors)  # NULL drops in a filter; plain ranges reach the scan


def predicate(spec: FilterSpec, schema: T.StructType | None = None) -> Column:
    parts: list[Column] = []
    if spec.start_date is not None and spec.end_date is not None:
        dtype = schema[DATE].dataType if schema is not None and DATE in schema.names else None
        parts.append(day_range(DATE, spec.start_date, spec.end_date, dtype))
    one = terms(spec.category_one)
    if one:
        if spec.scheme is not None:
            parts.append(_in(category_value(spec.scheme), one))
        else:
            # spelled out rather than CASE, so that the scan gets the conditions
            leveled = spec.rules.leveled()
            parts.append((leveled & _in(F.col(CATEGORY_ONE), one)) | (~leveled & _in(F.col(CATEGORY), one)))
    two = terms(spec.category_two)
    if two:
        parts.append(_in(F.col(CATEGORY_TWO), two))
    lang = terms(spec.language)
    if lang:
        parts.append(_in(F.col(LANGUAGE), lang))
    ctry = terms(spec.country)
    if ctry:
        parts.append(_in(F.col(COUNTRY), ctry))
    iss = issue_predicate(spec.thresholds)
    if iss is not None:
        parts.append(iss)
    if spec.exclude_comments:
        parts.append(~F.col(TYPE).eqNullSafe(COMMENT))
    if not parts:
        return F.lit(True)
    return functools.reduce(operator.and_, parts)


def apply_filter(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.where(predicate(spec, df.schema))


def exclude_comments(df: DataFrame) -> DataFrame:
    """Drop posts typed ``comment``; posts without a type are kept."""
    return df.where(~F.col(TYPE).eqNullSafe(COMMENT))


def select_indexes(df: DataFrame, names: Sequence[str], index_col: str = "index_name") -> DataFrame:
    """Restrict to an index selection (partition pruning when partitioned by index)."""
    return df.where(F.col(index_col).isin(list(names)))


def compare_mode(df: DataFrame, value: Column) -> DataFrame:
    """Compare-categories mode: keep posts with a real category, however many
    there are.  Uncategorised posts and "Any" drop out, unlike under "Any"."""
    return df.where(value.isNotNull() & ~value.isin("", ANY))
