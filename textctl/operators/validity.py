"""Control validity (E1-E11, E14): four predicates per generated text.

Shape of the plan: the per-text work that needs no constraint (blank
deletion and edge comparison for format, the length for char_count) is done
in a projection *before* the join, and only the keyword/prohibited-word rows
keep their text into the join. The join on ``(task, prompt_id)`` takes the
constraint columns only, never ``base_text``; the constraint side is
broadcast when its measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_valid, is_sentinel
from ..plans.joins import join_small
from ..schemas import SENTINEL

CONSTRAINT_COLS = ["task", "prompt_id", "min_chars", "max_chars", "keyword_answer", "prohibited_word_answer"]


def constraints(master: DataFrame) -> DataFrame:
    """The columns the predicates need, projected before the join.

    Accepts a master with ``char_count_answer`` (array ``[min, max]``) or
    with ``min_chars``/``max_chars`` already split.
    """
    cols = set(master.columns)
    if "min_chars" not in cols:
        master = master.withColumns(
            {
                "min_chars": F.get(F.col("char_count_answer"), 0).cast("int"),
                "max_chars": F.get(F.col("char_count_answer"), 1).cast("int"),
            }
        )
    return master.select(*CONSTRAINT_COLS)


def text_features(results: DataFrame, keep=()) -> DataFrame:
    """Per-text work that needs no constraint; only the aspect's own
    branch is evaluated for each row (``CASE`` branches are lazy)."""
    a = F.col("aspect")
    keys = [c for c in ["task", "model_path", "model", "prompt_id", "aspect", "iter"] if c in results.columns]
    return results.select(
        *keys,
        *keep,
        is_sentinel("clean_text").alias("_sentinel"),
        F.when(a == "format", format_valid("raw_text", "clean_text")).alias("_format_ok"),
        F.when(a == "char_count", F.length("clean_text")).alias("_n_chars"),
        F.when(a.isin("keyword", "prohibited_word"), F.col("clean_text")).alias("_probe"),
    )


def with_validity(results: DataFrame, master: DataFrame, keep=()) -> DataFrame:
    """Inner join with the constraints and one ``is_valid`` per row.

    ``is_valid`` is NULL only for an undecidable format (cleaned text of 10
    characters or fewer without blanks). Results whose prompt is not in the
    master leave the output, as in the benchmark's inner merge; see
    ``coverage`` for the rows that did.
    """
    feats = text_features(results, keep)
    joined = join_small(feats, constraints(master), ["task", "prompt_id"], "inner")
    a = F.col("aspect")
    ok = ~F.col("_sentinel")
    is_valid = (
        F.when(a == "format", F.col("_format_ok"))
        .when(a == "char_count", ok & F.col("_n_chars").between(F.col("min_chars"), F.col("max_chars")))
        .when(a == "keyword", ok & F.col("_probe").contains(F.col("keyword_answer")))
        .when(a == "prohibited_word", ok & ~F.col("_probe").contains(F.col("prohibited_word_answer")))
    )
    out = [c for c in feats.columns if not c.startswith("_")]
    return joined.select(*out, is_valid.alias("is_valid"))


def coverage(results: DataFrame, master: DataFrame) -> DataFrame:
    """Prompts without any result and results without a prompt,
    per task and model, as counts.

    No prompt x model pairs are formed: for each model with results in a
    task, the prompts it misses are the task's prompt rows minus the prompt
    rows it covers (an inner join of keys counted per task and model). A
    prompt row with a NULL key is never covered, as in a join."""
    keys = results.select("task", "model", "prompt_id").distinct()
    prompts = master.select("task", "prompt_id")
    orphan = keys.join(prompts, ["task", "prompt_id"], "left_anti").groupBy("task", "model").agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("kind", F.lit("result_without_prompt"))
    models = keys.select("task", "model").distinct()
    covered = keys.join(prompts, ["task", "prompt_id"], "inner").groupBy("task", "model").agg(F.count(F.lit(1)).alias("_covered"))
    per_task = prompts.groupBy("task").agg(F.count(F.lit(1)).alias("_prompts"))
    # one row per task and model on each side: bounded by the models
    counted = join_small(join_small(models, per_task, "task", "inner"), covered, ["task", "model"], "left")
    missing = (
        counted.select("task", "model", (F.col("_prompts") - F.coalesce(F.col("_covered"), F.lit(0))).alias("n"))
        .where(F.col("n") > 0)
        .withColumn("kind", F.lit("prompt_without_result"))
    )
    return orphan.unionByName(missing).select("task", "model", "kind", "n")


def master_key_issues(master: DataFrame) -> DataFrame:
    """Q14: prompt keys that a join would treat wrongly: a NULL
    ``prompt_id`` (never matches) or a ``(task, prompt_id)`` given more than
    once (would multiply result rows). One aggregate on the keys."""
    g = master.groupBy("task", "prompt_id").agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("prompt_id").isNull() | F.col("task").isNull() | (F.col("n") > 1)).withColumn(
        "issue", F.when(F.col("prompt_id").isNull() | F.col("task").isNull(), F.lit("null_key")).otherwise(F.lit("duplicate_key"))
    )


__all__ = ["constraints", "text_features", "with_validity", "coverage", "master_key_issues", "SENTINEL"]
