"""Index-name algebra as Column expressions.

An index name is ``<project parts>-<platform>[-<platform>...]``; topic tables are
named ``topics-<prefix>`` where the prefix drops every platform part.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Platform name parts removed from an index name to get its prefix
# (order as given; membership is all that matters).
PLATFORM_SUFFIXES = (
    "tiktok",
    "facebook",
    "twitter",
    "whisper",
    "instagram",
    "telegram",
    "odnoklassniki",
    "vkontakte",
    "web",
    "youtube",
    "comments",
)

TOPIC_INDEX_PREFIX = "topics-"  # fixed value: topic-table name = prefix + index prefix


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def index_prefix(name: str | Column, suffixes: Iterable[str] = PLATFORM_SUFFIXES) -> Column:
    """Drop every ``-`` part that is a platform name, wherever it occurs.

    ``filter`` keeps repeated non-platform parts (``array_except`` would
    de-duplicate them, e.g. ``a-a-tiktok`` must give ``a-a``).
    """
    stop = F.array(*[F.lit(s) for s in suffixes])
    parts = F.split(_col(name), "-")
    return F.array_join(F.filter(parts, lambda p: ~F.array_contains(stop, p)), "-")


def topic_index_name(name: str | Column, suffixes: Iterable[str] = PLATFORM_SUFFIXES) -> Column:
    return F.concat(F.lit(TOPIC_INDEX_PREFIX), index_prefix(name, suffixes))


def base_index(name: str | Column) -> Column:
    """First two ``-`` parts of a name (the wildcard base used for index discovery)."""
    return F.array_join(F.slice(F.split(_col(name), "-"), 1, 2), "-")


def selection_topic_indexes(selection: str | Column) -> Column:
    """Comma-joined selection string -> distinct array of topic index names."""
    names = F.split(_col(selection), ",")
    return F.array_distinct(
        F.transform(names, lambda n: F.concat(F.lit(TOPIC_INDEX_PREFIX), index_prefix(n)))
    )


# Driver-side twins for configuration strings (selection lists are config-sized).
def py_index_prefix(name: str, suffixes: Iterable[str] = PLATFORM_SUFFIXES) -> str:
    stop = set(suffixes)
    return "-".join(p for p in name.split("-") if p not in stop)


def py_topic_indexes(names: Iterable[str]) -> list[str]:
    return sorted({TOPIC_INDEX_PREFIX + py_index_prefix(n) for n in names})
