"""Hit projections: the user-facing hit table, context rows, context packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import MISSING, UNKNOWN, or_missing, repair_url
from quarry.operators.filters import BASE, CATEGORY, CATEGORY_ONE


def has_path(schema: T.StructType, path: str) -> bool:
    dtype: T.DataType = schema
    for part in path.split("."):
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            return False
        dtype = dtype[part].dataType
    return True


def field(df: DataFrame, path: str) -> Column:
    """Column at a dotted path, or NULL when the corpus has no such field
    (a missing parent object behaves like a missing field)."""
    return F.col(path) if has_path(df.schema, path) else F.lit(None).cast("string")


# Hit-table columns and their source paths.
HIT_FIELDS = (
    ("text", "text"),
    ("url", "url"),
    ("country", "country"),
    ("language", "language_text"),
    ("category", "category"),
    ("source", "source"),
    ("_domain", "_domain"),
    ("category_one", "misc.category_one"),
    ("category_two", "misc.category_two"),
    ("id", "id"),
)


def hit_table(hits: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The hit table: calendar ``date`` plus ten string columns where a missing
    value reads "None".  The URL is kept raw here (repair is for links)."""
    date = F.to_date(field(hits, "date_ts")) if has_path(hits.schema, "date_ts") else F.lit(None).cast("date")
    cols = [F.col(k) for k in keep] + [date.alias("date")]
    cols += [or_missing(field(hits, src), MISSING).alias(name) for name, src in HIT_FIELDS]
    return hits.select(*cols)


def context_category(df: DataFrame, scheme: str | Column) -> Column:
    """Category shown with a context row: base scheme -> ``category`` (may be
    NULL); other schemes -> ``misc.category_one`` defaulting to "Unknown"."""
    base = field(df, CATEGORY)
    misc = F.coalesce(field(df, CATEGORY_ONE), F.lit(UNKNOWN))
    if isinstance(scheme, str):
        return base if scheme == BASE else misc
    return F.when(scheme == BASE, base).otherwise(misc)


def context_rows(hits: DataFrame, scheme: str | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(translated_text, url, category)`` per hit with the URL repaired."""
    return hits.select(
        *[F.col(k) for k in keep],
        F.col("translated_text").alias("text"),
        repair_url("url").alias("url"),
        context_category(hits, scheme).alias("category"),
    )


def pack_context(ctx: DataFrame, group: str = "question_id", order: str = "rank",
                 fields: tuple[str, ...] = ("text", "url", "category")) -> DataFrame:
    """One row per question with its context as an ordered array of structs.
    Each group holds at most k hits (the search already bounded it)."""
    item = F.struct(F.col(order).alias("pos"), *[F.col(f) for f in fields])
    return ctx.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("context"))


def context_json(packed: DataFrame, col: str = "context") -> Column:
    """Stringified context for copying (JSON array of ``[text, url, category]``)."""
    return F.to_json(F.transform(F.col(col), lambda x: F.array(x["text"], x["url"], x["category"])))


def context_text(col: str = "context") -> Column:
    """Numbered plain-text context: ``[pos] text (url) [category]`` lines, one per
    hit; a missing text or URL is empty, its line stays."""
    return F.array_join(
        F.transform(
            F.col(col),
            lambda x: F.concat(
                F.lit("["), x["pos"].cast("string"), F.lit("] "), F.coalesce(x["text"], F.lit("")),
                F.lit(" ("), F.coalesce(x["url"], F.lit("")), F.lit(") ["), F.coalesce(x["category"], F.lit(MISSING)), F.lit("]"),
            ),
        ),
        "\n",
    )
