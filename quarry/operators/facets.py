"""Facet values and value distributions, several fields in one pass."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import shuffle_levels, top_per_group
from quarry.operators.filters import ANY, BASE, CATEGORY, CATEGORY_ONE, CATEGORY_TWO, COUNTRY, LANGUAGE, TWO_LEVEL

BUCKET_CAP = 10000  # fixed value: buckets per facet field


def agg_name(field: str) -> str:
    return "unique_" + field.replace(".", "_")


def _pairs(items: Sequence[tuple[str, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in items])


def facets(df: DataFrame, fields: Sequence[str], size: int = BUCKET_CAP) -> DataFrame:
    """``field, agg_name, bucket, value, count`` for every field in one scan.

    Each row is fanned out to ``(field, value)`` pairs and counted with one
    partial+final hash aggregate; NULLs make no bucket.  Buckets per field are
    ordered by count desc, value asc and capped at ``size`` (a partial
    ``WindowGroupLimit`` runs before the shuffle; with many shuffle partitions
    a first level by value-hash bucket keeps a wide field off one task).
    """
    pairs = df.select(F.inline(_pairs([(f, F.col(f)) for f in fields])))
    counts = pairs.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    order = [("count", False), ("value", True)]
    ranked = top_per_group(counts, ["field"], order, size, "value", "bucket", shuffle_levels(counts))
    name = F.concat(F.lit("unique_"), F.regexp_replace("field", r"\.", "_"))
    return ranked.select("field", name.alias("agg_name"), "bucket", "value", F.col("count").cast("long"))


def approx_terms(df: DataFrame, fields: Sequence[str], k: int = BUCKET_CAP) -> DataFrame:
    """Heavy hitters per field with a mergeable frequent-items sketch
    (``approx_top_k``), for fields too wide for exact buckets."""
    pairs = df.select(F.inline(_pairs([(f, F.col(f)) for f in fields]))).where(F.col("value").isNotNull())
    top = pairs.groupBy("field").agg(F.expr(f"approx_top_k(value, {int(k)})").alias("top"))
    return top.select("field", F.inline("top")).select(
        "field", F.col("item").alias("value"), F.col("count").cast("long").alias("count")
    )


def scheme_fields(scheme: str | Column) -> list[tuple[str, Column]]:
    """Facet fields of a category scheme: first level, second level (two-level
    only), language, country."""
    if isinstance(scheme, str):
        one = F.col(CATEGORY) if scheme == BASE else F.col(CATEGORY_ONE)
        two = F.col(CATEGORY_TWO) if scheme == TWO_LEVEL else F.lit(None).cast("string")
    else:
        one = F.when(scheme == BASE, F.col(CATEGORY)).otherwise(F.col(CATEGORY_ONE))
        two = F.when(scheme == TWO_LEVEL, F.col(CATEGORY_TWO))
    return [("category_one", one), ("category_two", two), ("language", F.col(LANGUAGE)), ("country", F.col(COUNTRY))]


def facet_lists(df: DataFrame, scheme: str | Column, by: Sequence[str] = (), size: int = BUCKET_CAP) -> DataFrame:
    """Selector lists: the top ``size`` values per field (by count) plus "Any"
    (always for first level, language and country; for the second level only
    when it has values), with their lexicographic position ``pos``.

    One scan: each row fans out to its real ``(field, value)`` pairs and the
    "Any" markers, one aggregate dedups and counts them (markers collapse
    map-side), and both windows share the ``(by, field)`` partitioning.
    """
    by = list(by)
    fields = scheme_fields(scheme)
    two = dict(fields)["category_two"]
    markers = [(f, F.lit(ANY)) for f in ("category_one", "language", "country")]
    markers.append(("category_two", F.when(two.isNotNull(), F.lit(ANY))))
    counts = (
        df.select(*by, F.inline(_pairs(fields + markers)))
        .where(F.col("value").isNotNull())
        .groupBy(*by, "field", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    is_any = F.col("value") == F.lit(ANY)
    order = [(is_any, False), ("count", False), ("value", True)]
    capped = top_per_group(counts, [*by, "field"], order, size + 1, "value", "_r", shuffle_levels(counts))
    w = Window.partitionBy(*by, "field").orderBy("value")
    return capped.select(*by, "field", F.row_number().over(w).cast("long").alias("pos"), "value")


def distribution_dims(scheme: str) -> list[str]:
    """Layout: two-level selections show four distributions, others three."""
    if scheme == TWO_LEVEL:
        return ["category_one", "category_two", "language", "country"]
    return ["category", "language", "country"]


def distributions(table: DataFrame, dims: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Value counts per dimension (one pass): ``by.., dimension, value, count``."""
    pairs = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]
    exploded = table.select(*by, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    return exploded.groupBy(*by, "dimension", "value").agg(F.count(F.lit(1)).cast("long").alias("count"))


def shares(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each value within its dimension (what a donut chart shows).

    Per-group shares (``by`` = question) use a window over groups of at most
    k hits.  Corpus-wide shares compute one total per dimension with an
    aggregate and broadcast it (one row per dimension), so no task has to
    hold every value of a wide dimension.
    """
    if by:
        w = Window.partitionBy(*by, "dimension")
        return dist.withColumn("share", F.col("count") / F.sum("count").over(w))
    totals = dist.groupBy("dimension").agg(F.sum("count").alias("_total"))
    return dist.join(F.broadcast(totals), "dimension").withColumn(
        "share", F.col("count") / F.col("_total")
    ).drop("_total")


def sketch_terms(df: DataFrame, fields: Sequence[str], by: Sequence[str] = ("index_name",), max_items: int = 1000) -> DataFrame:
    """``<by>, field, sketch, n``: a frequent-items sketch of every field's values per group,
    small and mergeable, to be stored beside the corpus. ``n`` counts the values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    rows = df.select(*by, F.inline(pairs)).where(F.col("value").isNotNull())
    return rows.groupBy(*by, "field").agg(
        F.expr(f"approx_top_k_accumulate(value, {max_items})").alias("sketch"), F.count("*").alias("n")
    )


def sketched_terms(sketches: DataFrame, k: int, max_items: int = 1000) -> DataFrame:
    """``field, value, count, error`` of the ``k`` most frequent values over a selection of
    sketches: the posts are not read. An estimate is off by ``error`` at most, 3.5 / size
    of the sketch's table of all values counted; 0 where no value had to give way."""
    size = 1 << max(0, math.ceil(math.log2(max_items / 0.75)))
    merged = sketches.groupBy("field").agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {max_items}), {k})").alias("top"), F.sum("n").alias("n")
    )
    error = F.when(F.col("exact"), F.lit(0).cast("long")).otherwise(F.ceil(F.col("n") * F.lit(3.5 / size)).cast("long"))
    counted = F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    # fewer values than asked for, and their counts are all there are: nothing gave way
    merged = merged.withColumn("exact", (F.size("top") < k) & (counted == F.col("n")))
    return merged.select("field", error.alias("error"), F.inline("top")).select("field", F.col("item").alias("value"), "count", "error")
