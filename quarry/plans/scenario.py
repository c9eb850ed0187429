"""The fixed user selection the registered queries run with (parameters, not data)."""

from __future__ import annotations

from quarry.operators.filters import FilterSpec, SchemeRules
from quarry.sources import testdata as td

RULES = SchemeRules(two_level=td.TWO_LEVEL_MARKERS, one_level=td.ONE_LEVEL_MARKERS)

# Flagship search: a week of English/French posts, comments excluded, issue
# filter (spread in [0.05, 0.5] OR toxic == 1), top 30 by L2 to one question.
SEARCH = FilterSpec(
    start_date="2024-01-03",
    end_date="2024-01-10",
    language=["en", "fr"],
    country=["Any"],
    thresholds={"issues.spread": "0.05:0.5", "issues.toxic": "1.0:1.0", "issues.quality": "0.0:0.0"},
    exclude_comments=True,
    rules=RULES,
)
K = 30
QUESTION_VEC_ID = 0  # the question: stored vector 0 ("posts like this one")

BATCH_K = 10
SCORE_THRESHOLD = 0.40  # the variant's default is 0.7; 0.40 keeps some hits on these tables
VARIANT_K = 100  # fixed value: k of the variant search
VARIANT_SIZE = 10000  # fixed value: result size of the variant search
ALL_INDEXES = td.INDEX_NAMES
SELECTION = ",".join(ALL_INDEXES)
