"""Top-n rows per group, merged in one or two window levels.

``row_number() <= n`` over a window makes Spark plan a partial
``WindowGroupLimit`` before the exchange, so each upstream partition sends at
most ``n`` rows per group.  With many upstream partitions one group's final
task would still receive ``partitions x n`` rows; a first level keyed by
``(group, hash bucket of the tiebreak column)`` with ~sqrt(partitions) buckets
keeps both levels at ~sqrt(partitions) x n rows per task.  Catalyst adds the
partial limit only for ``n`` below ``spark.sql.optimizer.windowGroupLimitThreshold``
(default 1000); above it a narrow per-partition top-n step takes its place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MERGE_FANIN = 64  # upstream partitions merged directly per group before a second level


def merge_levels(nparts: int) -> int:
    """Buckets of the first level: none for few partitions, else ~sqrt(partitions)."""
    return 1 if nparts <= MERGE_FANIN else max(2, math.isqrt(nparts))


OrderKey = tuple[str | Column, bool]  # (column, ascending); order values must be non-null


def _limit_inferred(spark, n: int) -> bool:
    """Whether Catalyst plans a partial ``WindowGroupLimit`` for ``row_number() <= n``
    (it does only below ``spark.sql.optimizer.windowGroupLimitThreshold``)."""
    return n < int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def _partial_top(df: DataFrame, group: Sequence[str], names: Sequence[str], ascending: Sequence[bool],
                 n: int) -> DataFrame:
    """Per-partition top-``n`` per group (narrow, no shuffle): what a partial
    ``WindowGroupLimit`` does, for limits above the optimizer's threshold.
    Each task keeps a running top-n per group over its Arrow batches."""
    import pandas as pd

    from quarry.session import ship_package

    ship_package()

    def run(batches):
        state = None
        for pdf in batches:
            both = pdf if state is None else pd.concat([state, pdf], ignore_index=True)
            both = both.sort_values(list(names), ascending=list(ascending), kind="mergesort")
            state = both.groupby(list(group), sort=False, dropna=False).head(n)
        if state is not None and len(state):
            yield state

    return df.mapInPandas(run, df.schema)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[OrderKey], n: int, spread_col: str,
                  rank_col: str = "rank", levels: int = 1) -> DataFrame:
    """Rows ranked ``1..n`` within each group by ``order`` (pairs of column and
    ascending flag, ending in a unique tiebreak); ``spread_col`` spreads the
    first level when ``levels > 1``.  When the optimizer would not add a
    partial limit (``n`` above its threshold), a per-partition top-n step
    bounds what each upstream task sends instead."""
    names, extra = [], {}
    for i, (c, _) in enumerate(order):
        if isinstance(c, str):
            names.append(c)
        else:
            names.append(f"_o{i}")
            extra[f"_o{i}"] = c
    if extra:
        df = df.withColumns(extra)
    asc = [a for _, a in order]
    sort = [F.col(nm).asc() if a else F.col(nm).desc() for nm, a in zip(names, asc)]
    if not _limit_inferred(df.sparkSession, n):
        df = _partial_top(df, group, names, asc, n)
    if levels > 1:
        df = df.withColumn("_b", F.pmod(F.xxhash64(F.col(spread_col)), F.lit(levels)))
        w1 = Window.partitionBy(*group, "_b").orderBy(*sort)
        df = df.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n).drop("_r", "_b")
    w = Window.partitionBy(*group).orderBy(*sort)
    out = df.withColumn(rank_col, F.row_number().over(w).cast("long")).where(F.col(rank_col) <= n)
    return out.drop(*extra) if extra else out


def shuffle_levels(df: DataFrame) -> int:
    """Merge levels for a window fed by a shuffle (aggregate output)."""
    return merge_levels(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranked(counts: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``counts`` with ``rank`` from 1 in each group: falling ``count``, then ``value``.

    For groups of bounded size, such as the values among one question's hits."""
    w = Window.partitionBy(*group).orderBy(F.desc("count"), F.col(value))
    return counts.withColumn("rank", F.row_number().over(w).cast("long"))
