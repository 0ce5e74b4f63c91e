"""Control scores (E7, E10, E13, G1): counts per group, ratios from counts.

Every aggregate is a ``groupBy`` with partial (map-side) aggregation, so a
hot ``(task, model)`` holding a third of the rows only adds rows to the
partial step; what crosses the shuffle is one row per group and partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fmt3, round3
from ..schemas import ASPECTS, CTG_REPORT_LABELS

GROUP = ["task", "model", "aspect", "iter"]


def ctg_scores(valid: DataFrame) -> DataFrame:
    """``n`` joined rows, ``n_valid``, ``n_undecided`` (format NULL) and
    ``score = n_valid / n``; an undecided row stays in the denominator."""
    return (
        valid.groupBy(*GROUP)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("is_valid")).alias("n_valid"),
            F.count_if(F.col("is_valid").isNull()).alias("n_undecided"),
        )
        .withColumn("score", F.try_divide(F.col("n_valid"), F.col("n")))
    )


def iter_pivot(df: DataFrame, value: str, keys=("task", "model", "aspect"), iters: int = 3, prefix: str = "i") -> DataFrame:
    """One column per iteration (``i0, i1, ...``) for the given value."""
    return (
        df.groupBy(*keys)
        .pivot("iter", list(range(iters)))
        .agg(F.first(value))
        .withColumnsRenamed({str(i): f"{prefix}{i}" for i in range(iters)})
    )


def ctg_mean_rounded(scores: DataFrame, iters: int = 3) -> DataFrame:
    """G1 (Q9): each iteration's score as written with 3 decimals, read
    back, summed in iteration order and divided by ``iters``."""
    rounded = scores.withColumn("r", round3("score"))
    p = iter_pivot(rounded, "r", iters=iters)
    total = F.col("i0")
    for i in range(1, iters):
        total = total + F.col(f"i{i}")
    return p.select("task", "model", "aspect", (total / F.lit(iters)).alias("ctg_mean"))


def ctg_report_lines(scores: DataFrame) -> DataFrame:
    """The four ``Label: 0.000`` lines per task, model and iteration,
    with ``line_no`` giving their order in the file."""
    order = F.create_map(*[x for i, a in enumerate(ASPECTS) for x in (F.lit(a), F.lit(i))])
    label = F.create_map(*[x for a in ASPECTS for x in (F.lit(a), F.lit(CTG_REPORT_LABELS[a]))])
    return scores.select(
        "task",
        "model",
        "iter",
        order[F.col("aspect")].alias("line_no"),
        F.concat(label[F.col("aspect")], F.lit(": "), fmt3("score")).alias("line"),
    )
