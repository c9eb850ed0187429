"""Schema discovery: dotted field paths under a prefix, and their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_paths(dtype: T.DataType, path: str = "") -> list[str]:
    """Every node path (objects and leaves), depth-first, in schema order.
    Arrays of structs are walked through their element type."""
    out: list[str] = []
    if isinstance(dtype, T.ArrayType):
        return field_paths(dtype.elementType, path)
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            p = f"{path}.{f.name}" if path else f.name
            out.append(p)
            out.extend(field_paths(f.dataType, p))
    return out


def prefixed_fields(schema: T.StructType, prefix: str) -> list[str]:
    """Paths starting with ``prefix``; the walk continues below non-matching
    nodes, so ``issues.`` matches ``issues.x`` but not ``issues`` itself."""
    return [p for p in field_paths(schema) if p.startswith(prefix)]


def union_fields(schemas: list[T.StructType], prefix: str) -> list[str]:
    """Distinct union of prefixed paths over several index schemas (sorted)."""
    return sorted({p for s in schemas for p in prefixed_fields(s, prefix)})


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, n_present``: non-null count of each field, one scan for all."""
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, n_present bigint")
    aggs = [F.count(F.col(f)).alias(f"c{i}") for i, f in enumerate(fields)]
    row = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("n_present")) for i, f in enumerate(fields)])
    return row.select(F.inline(pairs)).select("field", F.col("n_present").cast("long"))


def map_key_fields(df: DataFrame, col: str) -> DataFrame:
    """Field discovery for a map-typed score column (``MAP<STRING, DOUBLE>``):
    the distinct keys present in the data, as ``col.key`` paths (one scan,
    partial aggregation)."""
    keys = df.select(F.explode(F.map_keys(F.col(col))).alias("k")).distinct()
    return keys.select(F.concat(F.lit(col + "."), F.col("k")).alias("field"))
