"""What ``__spark_entry__.py`` registers of this package: the operators' queries
and the pipeline."""

from __future__ import annotations

import corpus_pipeline

from . import oracles
from . import queries as Q


def queries():
    return {**Q.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql():
    found = dict(oracles.SQL)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
