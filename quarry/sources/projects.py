"""Project configuration -> index selections, and index discovery by base name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.indexes import base_index


def project_indexes(projects: DataFrame, project: str | None = None) -> DataFrame:
    """``project, index_name, scheme`` rows: one project ("All Project Indexes")
    or every project flattened ("Specific Indexes" choices)."""
    p = projects if project is None else projects.where(F.col("project") == project)
    return p.select("project", F.explode("indexes").alias("index_name"), "scheme")


def project_posts(stored: DataFrame, projects: DataFrame, project: str) -> DataFrame:
    """Posts of a project from a corpus stored by index. The project's rows are
    configuration, so they are broadcast; Spark hands their index names to the scan as
    a run-time partition filter, and directories of other indexes are not read."""
    chosen = project_indexes(projects, project).select("project", "index_name")
    return stored.join(F.broadcast(chosen), "index_name")


def discover_indexes(index_names: DataFrame, selection: DataFrame, col: str = "index_name") -> DataFrame:
    """Indexes sharing a base (first two name parts) with any selected index,
    i.e. matching the wildcard ``<base>*``.

    Both inputs are index-name lists (one row per index); bases are compared
    per selected index, so a mixed selection discovers every family.  The
    wildcard is an equi-join: each name's prefixes (as many as its length)
    against the distinct bases (one per selected index, a bounded broadcast)."""
    bases = selection.select(base_index(col).alias("_p")).distinct()
    name = F.col(col)
    prefixes = index_names.select(col, F.explode(F.sequence(F.lit(1), F.length(name))).alias("_n")).select(
        col, name.substr(F.lit(1), F.col("_n")).alias("_p")
    )
    return prefixes.join(F.broadcast(bases), "_p", "left_semi").select(col).distinct()
