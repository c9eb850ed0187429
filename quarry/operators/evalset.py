"""Batch evaluation tables: side-by-side model pairs and filled prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fallback prompt used when a task has no template.
DEFAULT_SYSTEM = "You are a helpful assistant that summarizes information."
DEFAULT_HUMAN = "Please summarize the following information:\n\n{texts}\n\nQuestion: {question}"


def model_pairs(questions: DataFrame, models: Sequence[str], seed: str = "0",
                n: int = 2, qid: str = "question_id") -> DataFrame:
    """``question_id, slot, model``: ``n`` distinct models per question, chosen
    by a seeded hash order (reproducible, uniform over models).  Computed
    row-locally from the configured model list - no join, no shuffle."""
    names = list(dict.fromkeys(models))
    if len(names) < n:
        raise ValueError(f"need at least {n} models, got {len(names)}")
    arr = F.array(*[F.lit(m) for m in names])
    keyed = F.transform(
        arr,
        lambda m: F.struct(
            F.md5(F.concat_ws(":", F.col(qid).cast("string"), m, F.lit(seed))).alias("h"), m.alias("model")
        ),
    )
    chosen = F.slice(F.array_sort(keyed), 1, n)
    return questions.select(qid, F.posexplode(chosen).alias("pos", "c")).select(
        qid, (F.col("pos") + 1).cast("long").alias("slot"), F.col("c.model").alias("model")
    )


def template_for(tasks: Mapping[str, str | None], task: str) -> tuple[str, str]:
    """(system, human) template of a task; missing or empty -> the fallback."""
    t = tasks.get(task)
    return (DEFAULT_SYSTEM, DEFAULT_HUMAN) if not t else (DEFAULT_SYSTEM, t)


def task_of(labels: Mapping[str, str], label: str) -> str:
    """The task shown under ``label`` (``labels``: task -> label); empty, so without a
    template of its own, for a label that no task has."""
    return next((task for task, shown in labels.items() if shown == label), "")


def fill(template: str, question: Column, texts: Column) -> Column:
    """Substitute ``{question}`` and ``{texts}`` in one pass (text inserted for
    one placeholder is never re-scanned for the other)."""
    parts = F.split(F.lit(template), r"\{texts\}")
    filled = F.transform(parts, lambda p: F.replace(p, F.lit("{question}"), question))
    return F.reduce(
        F.slice(filled, 2, F.greatest(F.size(filled) - 1, F.lit(0))),
        F.element_at(filled, 1),
        lambda acc, p: F.concat(acc, texts, p),
    )


def prompt_table(questions: DataFrame, packed: DataFrame, template: tuple[str, str],
                 qid: str = "question_id", question_text: str = "text", context: str = "context_text") -> DataFrame:
    """``question_id, system, prompt`` for every question; one without hits gets an
    empty context."""
    system, human = template
    j = questions.join(packed, qid, "left")
    return j.select(qid, F.lit(system).alias("system"),
                    fill(human, F.coalesce(F.col(question_text), F.lit("")), F.coalesce(F.col(context), F.lit(""))).alias("prompt"))


def task_prompts(questions: DataFrame, packed: DataFrame, tasks: Mapping[str, str | None], labels: Mapping[str, str],
                 chosen: Sequence[str], qid: str = "question_id", question_text: str = "text",
                 context: str = "context_text") -> DataFrame:
    """``question_id, label, system, prompt`` for every question and chosen label, from
    one join of questions and contexts; a question without hits gets an empty context."""
    asked = F.coalesce(F.col(question_text), F.lit(""))
    texts = F.coalesce(F.col(context), F.lit(""))
    filled = []
    for label in chosen:
        system, human = template_for(tasks, task_of(labels, label))
        filled.append(F.struct(F.lit(label).alias("label"), F.lit(system).alias("system"),
                               fill(human, asked, texts).alias("prompt")))
    return questions.join(packed, qid, "left").select(qid, F.inline(F.array(*filled)))
