"""Posts whose fields are known only at run time: a VARIANT column in place of a mapping.

Indexes differ in their fields, and documents may lack any. ``mapping`` finds each
index's fields in one aggregation (``schema_of_variant_agg``, partial on the map side), as
a ``StructType`` that the schema walk of :mod:`quarry.sources.schema` reads; ranges and
coverage then take values by path. A path that a document lacks, or whose value is not of the
asked type, is null: it never matches a range and is not covered.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.filters import active_thresholds
from quarry.sources.schema import prefixed_fields


def schema_of(described: str | None) -> T.StructType:
    """``OBJECT<a: BIGINT, ...>``, what Spark says of a variant, as a ``StructType``. Anything
    but an object has no fields."""
    parts = re.split(r"(`(?:[^`]|``)*`)", described or "")  # quoted names stay as they are
    text = "".join(p if p.startswith("`") else p.replace("OBJECT<", "STRUCT<") for p in parts)
    if not text.startswith("STRUCT<"):
        return T.StructType([])
    return T.DataType.fromDDL(text)


def mapping(df: DataFrame, column: str, by: str = "index_name") -> dict[str, T.StructType]:
    """Fields of the variants of each index. One row per index reaches the driver."""
    rows = df.groupBy(by).agg(F.expr(f"schema_of_variant_agg(`{column}`)").alias("s")).collect()
    return {r[0]: schema_of(r["s"]) for r in rows}


def value(column: str, path: str, dtype: str = "double") -> Column:
    """The value at a dotted path, null where there is none of the type. A name in the path must
    hold no dot."""
    steps = "".join("['{}']".format(p.replace("\\", "\\\\").replace("'", "\\'")) for p in path.split("."))
    return F.try_variant_get(F.col(column), "$" + steps, dtype)


def fields(found: Mapping[str, T.StructType], prefix: str) -> list[tuple[str, str]]:
    """``(index, path)`` of all fields under a prefix, sorted."""
    return sorted((index, p) for index, s in found.items() for p in prefixed_fields(s, prefix))


def coverage(df: DataFrame, column: str, paths: Sequence[tuple[str, str]], by: str = "index_name",
             dtype: str = "double") -> DataFrame:
    """``<by>, field, n_present`` of the ``(index, path)`` pairs, one scan for all."""
    names = sorted({p for _, p in paths})
    if not names:
        return df.select(by).limit(0).withColumns({"field": F.lit(""), "n_present": F.lit(0).cast("long")})
    counts = df.groupBy(by).agg(*[F.count(value(column, p, dtype)).alias(f"c{i}") for i, p in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(p).alias("field"), F.col(f"c{i}").alias("n_present")) for i, p in enumerate(names)])
    known = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in paths])
    out = counts.select(by, F.inline(rows))
    return out.where(F.array_contains(known, F.struct(F.col(by).alias("i"), F.col("field").alias("p"))))


def thresholds_predicate(column: str, thresholds: Mapping[str, str], known: Iterable[str]) -> Column | None:
    """OR of the active ranges over fields that some index has. None: no range is active;
    ranges of unknown fields alone match nothing."""
    act = active_thresholds(thresholds)
    if not act:
        return None
    found = set(known)
    ors = [value(column, f).between(lo, hi) for f, (lo, hi) in act.items() if f in found]
    return functools.reduce(operator.or_, ors) if ors else F.lit(False)
