"""Mixing sources to target weights by iterative proportional fitting (operator 1).

Token counts by (source, language, topic) are raked until each margin has its target
share. The ratio of raked to present tokens is a cell's weight. Sampling probabilities
are raked as well, to the same shares of the token budget: a probability is the product
of one factor per value, at most 1, so a cell that is drawn whole leaves the rest of
its margins to the others. Each document is drawn by a hash of its id, so a draw repeats
itself on every run.

The cell table is raked on the driver up to ``MAX_CELLS`` rows and on Spark beyond, by
the same steps: sums by value with map-side partial sums, and a join of the factors.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS = ("source", "lang", "topic")
KEEP = 0.5  # share of the tokens to draw
TEMPER = 0.7  # default targets: present shares to this power
ROUNDS = 200
TOLERANCE = 1e-9  # of a margin, as a share of all tokens
MAX_CELLS = 500_000  # rows of the cell table that the driver rakes (about 50 MB); larger ones stay on Spark
_HIGH = 1e12  # a factor that no margin can meet grows no further


def token_count(text: str = "text") -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+')"), F.lit(0)).cast("long")


def topic(text: str = "text") -> Column:
    """A coarse register of a text, by its form: what stands for a topic where the
    documents carry none."""
    n = F.coalesce(F.length(text), F.lit(0))
    return (
        F.when(n < 200, "note").when(n < 1500, "short").when(n < 6000, "article").otherwise("long")
    )


def tempered(shares: Mapping[str, float], power: float = TEMPER) -> dict[str, float]:
    """Shares raised to a power and normalised: flatter than what is there."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in sorted(raised.items())}


def _reachable(goal: np.ndarray, capacity: np.ndarray, total: float) -> np.ndarray:
    """Shares ``goal`` of ``total``, at most what each value holds: what one value cannot
    give, the others give in proportion to their shares."""
    want, left = np.zeros(len(goal)), total
    open_ = (goal > 0) & (capacity > 0)
    while left > 0 and open_.any():
        each = np.where(open_, goal / goal[open_].sum() * left, 0.0)
        full = open_ & (each >= capacity)
        if not full.any():
            return want + each
        want[full] = capacity[full]
        left -= capacity[full].sum()
        open_ &= ~full
    return want


def _fit(codes: Mapping, wanted: Mapping, tokens: np.ndarray, q: np.ndarray, most: float, rounds: int | None, tolerance: float | None):
    """Factors ``q`` of the cells raked so that ``tokens * min(q, most)`` has the margins
    ``wanted``. One step for a value: what its capped cells leave of its target goes to
    the others."""
    total = max(tokens.sum(), 1.0)
    tolerance = TOLERANCE if tolerance is None else tolerance
    for _ in range(ROUNDS if rounds is None else rounds):
        worst = 0.0
        for name, code in codes.items():
            want, top = wanted[name], q >= most
            capped = np.bincount(code, np.where(top, tokens * min(most, _HIGH), 0.0), len(want))
            free = np.bincount(code, np.where(top, 0.0, tokens * q), len(want))
            worst = max(worst, np.abs(capped + free - want).max(initial=0.0) / total)
            room, have = want - capped, capped + free
            shrink = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            factor = np.divide(room, free, out=np.where(room > 0, 1.0, shrink), where=(free > 0) & (room > 0))
            q = np.minimum(q * factor[code], _HIGH)
        if worst < tolerance:
            break
    return q


def _margins(cells: pd.DataFrame, targets: Mapping[str, Mapping[str, float]]):
    """Each row's value by dimension as a code; shares and tokens of the values."""
    codes, goals, capacity = {}, {}, {}
    for name, shares in targets.items():
        codes[name], values = pd.factorize(cells[name], sort=True)
        capacity[name] = np.bincount(codes[name], cells["tokens"].to_numpy(float), len(values))
        goals[name] = np.array([float(shares.get(v, 0.0)) for v in values]) * (capacity[name] > 0)
    return codes, goals, capacity


def rake(
    cells: pd.DataFrame,
    targets: Mapping[str, Mapping[str, float]],
    rounds: int | None = None,
    tolerance: float | None = None,
) -> np.ndarray:
    """Token counts of ``cells`` (columns of ``targets``, and ``tokens``) raked so that
    every margin has its target share. A value without a target has share 0; targets
    without tokens are left out and the others scaled up."""
    tokens = cells["tokens"].to_numpy(float)
    codes, goals, _ = _margins(cells, targets)
    wanted = {n: g / g.sum() * tokens.sum() if g.sum() else g for n, g in goals.items()}
    return tokens * _fit(codes, wanted, tokens, np.ones(len(tokens)), np.inf, rounds, tolerance)


def probabilities(
    cells: pd.DataFrame,
    targets: Mapping[str, Mapping[str, float]],
    budget: float,
    rounds: int | None = None,
    tolerance: float | None = None,
) -> np.ndarray:
    """Sampling probabilities of ``cells``, at most 1, whose expected tokens have the
    target shares of ``budget`` in every margin, as far as the values hold them
    (``_reachable``). Margins that no probabilities meet together are left near, and the
    budget is met: one last multiplier settles it. All cells with weight are drawn whole
    where they hold less than the budget."""
    tokens = cells["tokens"].to_numpy(float)
    codes, goals, capacity = _margins(cells, targets)
    drawn = np.logical_and.reduce([goals[n][codes[n]] > 0 for n in codes]) & (tokens > 0)
    if tokens[drawn].sum() <= budget or budget <= 0:
        return (drawn & (budget > 0)).astype(float)
    wanted = {n: _reachable(goals[n], capacity[n], budget) for n in codes}
    start = np.where(drawn, budget / tokens[drawn].sum(), 0.0)
    q = _fit(codes, wanted, tokens, start, 1.0, rounds, tolerance)
    for _ in range(ROUNDS):
        q, miss = _settle(q, budget, tokens[q >= 1].sum(), (tokens * q)[q < 1].sum(), np.minimum)
        if miss < TOLERANCE:
            break
    return np.minimum(q, 1.0)


def _settle(q, budget: float, capped: float, free: float, least):
    """One step of the last multiplier; and how far the budget was missed, as a share."""
    factor = (budget - capped) / free if free > 0 and budget > capped else budget / max(capped + free, 1e-300)
    return least(q * factor, _HIGH), abs(capped + free - budget) / budget


class _SparkCells:
    """The steps of ``rake`` and ``probabilities`` over a cell table of any size: factors
    live in a column ``q``; only single numbers reach the driver."""

    def __init__(self, cells: DataFrame, names: list[str], targets: Mapping[str, Mapping[str, float] | None]):
        self.cells, self.names = cells, names
        self.total = float(cells.agg(F.sum("tokens")).first()[0] or 0.0)
        self.goals = {}
        for name in names:
            own = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("capacity"))
            if targets.get(name):
                given = cells.sparkSession.createDataFrame(
                    [(str(v), float(g)) for v, g in targets[name].items()], f"{name} string, goal double"
                )
                own = own.join(given, name, "left")
            else:
                own = own.withColumn("goal", F.pow("capacity", F.lit(TEMPER)))
            own = own.withColumn("goal", F.when(F.col("capacity") > 0, F.coalesce("goal", F.lit(0.0))).otherwise(0.0))
            self.goals[name] = written(own)

    def wanted(self, name: str, amount: float, capped: bool) -> DataFrame:
        """``(value, want)``: shares of ``amount``; ``capped`` at what each value holds."""
        goals = self.goals[name].where("goal > 0")
        per_goal, full = 0.0, -1
        while True:  # the multiplier of the shares; every step finds more values that give all they have
            at = F.col("goal") * F.lit(per_goal) >= F.col("capacity")
            is_full = at if capped and full >= 0 else F.lit(False)
            row = goals.agg(
                F.sum(F.when(is_full, F.col("capacity")).otherwise(0.0)).alias("held"),
                F.sum(F.when(is_full, 0.0).otherwise(F.col("goal"))).alias("open"),
                F.count(F.when(is_full, 1)).alias("full"),
            ).first()
            if row["full"] == full or not row["open"]:
                break
            full, per_goal = row["full"], max(0.0, (amount - row["held"]) / row["open"])
            if not capped:
                break
        want = F.col("goal") * F.lit(per_goal)
        if capped:
            want = F.least(want, F.col("capacity")) if row["open"] else F.col("capacity")
        return written(goals.select(name, want.alias("want")))

    def fit(self, cells: DataFrame, wanted: Mapping[str, DataFrame], most: float | None, rounds: int | None, tolerance: float | None):
        """``cells`` with ``q`` raked, as ``_fit`` does it."""
        top = F.lit(False) if most is None else F.col("q") >= most
        tolerance = TOLERANCE if tolerance is None else tolerance
        for _ in range(ROUNDS if rounds is None else rounds):
            misses = []
            for name in self.names:
                sums = cells.groupBy(name).agg(
                    F.sum(F.when(top, F.col("tokens") * (most or 0.0)).otherwise(0.0)).alias("capped"),
                    F.sum(F.when(top, 0.0).otherwise(F.col("tokens") * F.col("q"))).alias("free"),
                )
                sums = written(sums.join(wanted[name], name, "left").fillna(0.0, ["want"]).withColumn("have", F.expr("capped + free")))
                misses.append(sums.agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0)
                factor = F.expr(
                    "case when free > 0 and want > capped then (want - capped) / free"
                    " when want > capped then 1.0D when have > 0 then want / have else 1.0D end"
                )
                factors = sums.select(name, factor.alias("factor"))
                cells = cells.join(factors, name).withColumn("q", F.least(F.col("q") * F.col("factor"), F.lit(_HIGH))).drop("factor")
            cells = written(cells)
            if max(misses) / max(self.total, 1.0) < tolerance:
                break
        return cells

    def table(self, keep: float, budget: float | None, rounds: int | None = None, tolerance: float | None = None) -> DataFrame:
        """The cells with ``weight`` and ``probability``."""
        weights = self.fit(
            self.cells.withColumn("q", F.lit(1.0)),
            {n: self.wanted(n, self.total, False) for n in self.names}, None, rounds, tolerance,
        ).withColumnRenamed("q", "weight").withColumn("weight", F.when(F.col("tokens") > 0, F.col("weight")).otherwise(0.0))
        for name in self.names:
            weights = weights.join(self.goals[name].select(name, F.col("goal").alias(f"{name}_goal")), name)
        drawn = F.expr(" and ".join([f"{n}_goal > 0" for n in self.names] + ["tokens > 0"]))
        weights = written(weights.withColumn("drawn", drawn).drop(*[f"{n}_goal" for n in self.names]))
        goal = keep * self.total if budget is None else budget
        held = float(weights.where("drawn").agg(F.sum("tokens")).first()[0] or 0.0)
        if held <= goal or goal <= 0:
            whole = F.col("drawn").cast("double") if goal > 0 else F.lit(0.0)
            return weights.withColumn("probability", whole).drop("drawn")
        q = F.when(F.col("drawn"), F.lit(goal / held)).otherwise(0.0)
        cells = self.fit(
            weights.withColumn("q", q), {n: self.wanted(n, goal, True) for n in self.names}, 1.0, rounds, tolerance
        )
        scale = 1.0
        for _ in range(ROUNDS):
            x = F.least(F.col("q") * F.lit(scale), F.lit(_HIGH))
            row = cells.agg(
                F.sum(F.when(x >= 1, F.col("tokens")).otherwise(0.0)).alias("capped"),
                F.sum(F.when(x >= 1, 0.0).otherwise(F.col("tokens") * x)).alias("free"),
            ).first()
            scale, miss = _settle(scale, goal, row["capped"], row["free"], min)
            if miss < TOLERANCE:
                break
        return cells.withColumn("probability", F.least(F.col("q") * F.lit(scale), F.lit(1.0))).drop("q", "drawn")


def _driver_cells(docs: DataFrame, table: pd.DataFrame, names, targets, keep, budget) -> DataFrame:
    """The cells with ``weight`` and ``probability``, raked on the driver."""
    tokens = table["tokens"].to_numpy(float)
    wanted = {}
    for d, name in zip(DIMENSIONS, names):
        own = table.groupby(name)["tokens"].sum()
        wanted[name] = (targets or {}).get(d) or tempered((own / max(own.sum(), 1)).to_dict())
    fitted = rake(table, wanted)
    table["weight"] = np.divide(fitted, tokens, out=np.zeros_like(fitted), where=tokens > 0)
    table["probability"] = probabilities(table, wanted, keep * tokens.sum() if budget is None else budget)
    return docs.sparkSession.createDataFrame(
        table[[*names, "weight", "probability"]],
        ", ".join(f"{n} string" for n in names) + ", weight double, probability double",
    )


def mixed(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    keep: float = KEEP,
    budget: float | None = None,
) -> DataFrame:
    """``docs`` with ``topic`` and ``tokens``, each row's ``weight`` (raked to present
    tokens of its cell), ``probability`` and whether it is ``sampled``.

    ``targets`` gives shares by value for ``source``, ``lang`` and ``topic``; a
    dimension without targets gets its own shares tempered, so hot values shrink.
    ``budget`` counts tokens; without one it is ``keep`` of all.

    * a null source, lang or text counts under ``(none)``, 0 tokens and its length's
      topic; a row without tokens has its cell's probability;
    * a cell whose tokens are 0, or whose value has target 0: probability 0;
    * a null doc_id draws by the text; repeated rows draw alike;
    * an empty table gives no rows; columns named like the added ones are replaced,
      others stay;
    * a value that holds fewer tokens than its share of the budget is drawn whole, and
      the others make up for it; ``margins`` reports what was reached.
    """
    docs = docs.drop("topic", "tokens", "weight", "probability", "sampled")
    names = [f"_{d}" for d in DIMENSIONS]
    rows = docs.withColumns({"topic": topic(), "tokens": token_count()}).withColumns(
        {f"_{d}": F.coalesce(F.col(d).cast("string"), F.lit("(none)")) for d in DIMENSIONS}
    )
    cells = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    table = cells.limit(MAX_CELLS + 1).toPandas().sort_values(names, ignore_index=True)
    if len(table) > MAX_CELLS:
        weights = _SparkCells(
            written(cells), names, {name: (targets or {}).get(d) for d, name in zip(DIMENSIONS, names)}
        ).table(keep, budget).drop("tokens")
    else:
        weights = F.broadcast(_driver_cells(docs, table, names, targets, keep, budget))  # at most MAX_CELLS rows
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit("mix/"), key)), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return (
        rows.join(weights, names)
        .drop(*names)
        .withColumn("sampled", draw < F.col("probability"))
    )


def margins(rows: DataFrame) -> DataFrame:
    """What ``mixed`` rows reach: by dimension and value the share of tokens present, the
    ``target`` share, the share ``expected`` of a draw, and the one ``drawn``."""
    names = [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias("value"))
             for d in DIMENSIONS]
    sums = written(
        rows.select(F.inline(F.array(*names)), "tokens", "weight", "probability", "sampled")
        .groupBy("dimension", "value")
        .agg(
            F.sum("tokens").cast("double").alias("present"),
            F.sum(F.col("tokens") * F.col("weight")).alias("target"),
            F.sum(F.col("tokens") * F.col("probability")).alias("expected"),
            F.sum(F.when(F.col("sampled"), F.col("tokens")).otherwise(0)).cast("double").alias("drawn"),
        )
    )
    shares = ("present", "target", "expected", "drawn")
    totals = sums.groupBy("dimension").agg(*[F.sum(c).alias(f"all_{c}") for c in shares])  # three rows
    return sums.join(F.broadcast(totals), "dimension").select(
        "dimension", "value", *[F.expr(f"if(all_{c} > 0, {c} / all_{c}, 0.0D)").alias(c) for c in shares]
    )
