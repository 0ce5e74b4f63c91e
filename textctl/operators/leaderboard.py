"""Leaderboard (G1-G6) and the score-report readers (A4, A5).

Order of operations follows the benchmark: control scores are rounded to 3
decimals per iteration (the report), averaged over iterations; quality
All-Acc is rounded once (the report); the two averages are taken on those
values, then every column is written with 3 decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fmt3, round3
from ..schemas import ASPECTS, BOARD_PREFIX, CTG_REPORT_LABELS

BOARD_COLUMNS = [f"{BOARD_PREFIX[a]}-{k}" for a in ASPECTS for k in ("ctg", "qual")] + ["Avg-ctg", "Avg-qual"]

_LABEL_RX = "\\A(" + "|".join(CTG_REPORT_LABELS[a] for a in ASPECTS) + "): (.*)\\z"


def parse_ctg_report(lines: DataFrame) -> DataFrame:
    """A4: ``Label: 0.123`` lines -> ``(…, aspect, score)``; a line that is
    not one of the four labels gives ``aspect`` NULL (see
    ``incomplete_scores``)."""
    label_to_aspect = F.create_map(*[x for a in ASPECTS for x in (F.lit(CTG_REPORT_LABELS[a]), F.lit(a))])
    lab = F.regexp_extract("line", _LABEL_RX, 1)
    val = F.regexp_extract("line", _LABEL_RX, 2)
    keep = [c for c in lines.columns if c not in ("line", "line_no")]
    return lines.select(*keep, label_to_aspect[lab].alias("aspect"), F.when(lab != "", val.cast("double")).alias("score"))


def parse_quality_report(lines: DataFrame) -> DataFrame:
    """A5: the lines holding ``All-Acc`` in file order; the n-th is the
    n-th aspect."""
    keep = [c for c in lines.columns if c not in ("line", "line_no")]
    acc = lines.where(F.col("line").contains("All-Acc"))
    g = acc.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("xs"))
    aspects = F.array(*[F.lit(a) for a in ASPECTS])
    x = g.select(*keep, F.size("xs").alias("n_values"), F.posexplode("xs").alias("pos", "l"))
    return x.select(
        *keep,
        "n_values",
        F.get(aspects, F.col("pos")).alias("aspect"),
        F.split(F.col("l.line"), ": ").getItem(1).cast("double").alias("all_acc"),
    )


def leaderboard(ctg_report: DataFrame, quality_report: DataFrame, iters: int = 3) -> DataFrame:
    """One row per task and model with the ten string columns.

    ``ctg_report``: ``task, model, iter, aspect, score`` as read back (3
    decimals); ``quality_report``: ``task, model, aspect, all_acc`` as read
    back. Only models with both reports appear (G5).
    """
    c = ctg_report.groupBy("task", "model").pivot("aspect", ASPECTS).agg(
        *[F.first(F.when(F.col("iter") == i, F.col("score")), ignorenulls=True).alias(f"i{i}") for i in range(iters)],
        F.count("score").alias("n"),  # with one aggregate alone a pivot leaves its name out
    )
    q = quality_report.groupBy("task", "model").pivot("aspect", ASPECTS).agg(F.first("all_acc"))
    cols = {}
    for a in ASPECTS:
        total = F.col(f"{a}_i0")
        for i in range(1, iters):
            total = total + F.col(f"{a}_i{i}")
        cols[f"{BOARD_PREFIX[a]}-ctg"] = total / F.lit(iters)
    b = c.select("task", "model", *[v.alias(k) for k, v in cols.items()]).join(
        q.select("task", "model", *[F.col(f"`{a}`").alias(f"{BOARD_PREFIX[a]}-qual") for a in ASPECTS]), ["task", "model"], "inner"
    )
    avg_c = (F.col("`Format-ctg`") + F.col("`C-count-ctg`") + F.col("`Keyword-ctg`") + F.col("`P-word-ctg`")) / F.lit(4)
    avg_q = (F.col("`Format-qual`") + F.col("`C-count-qual`") + F.col("`Keyword-qual`") + F.col("`P-word-qual`")) / F.lit(4)
    b = b.withColumns({"Avg-ctg": avg_c, "Avg-qual": avg_q})
    return b.select("task", "model", *[fmt3(F.col(f"`{k}`")).alias(k) for k in BOARD_COLUMNS])


def leaderboard_numbers(ctg: DataFrame, quality_all_acc: DataFrame, iters: int = 3, mode: str = "report") -> tuple[DataFrame, DataFrame]:
    """The two inputs of ``leaderboard`` straight from scores, without files.

    ``mode="report"``: the values a write and read of the reports gives
    (3 decimals per iteration, Q9/Q10), as the benchmark's leaderboard.
    ``mode="exact"``: unrounded scores, rounding only in the final columns.
    """
    if mode not in ("report", "exact"):
        raise ValueError("mode is 'report' or 'exact'")
    r = round3 if mode == "report" else (lambda c: F.col(c))
    c = ctg.select("task", "model", "iter", "aspect", r("score").alias("score"))
    q = quality_all_acc.select("task", "model", "aspect", r("all_acc").alias("all_acc"))
    return c, q


def incomplete_scores(ctg_report: DataFrame, quality_report: DataFrame, iters: int = 3) -> DataFrame:
    """task/model pairs whose reports do not hold 4 control lines per
    iteration or 4 quality values."""
    c = ctg_report.groupBy("task", "model").agg(
        F.count_distinct("iter").alias("n_iters"),
        F.count_if(F.col("aspect").isNull()).alias("bad_lines"),
        F.count(F.lit(1)).alias("ctg_lines"),
    )
    q = quality_report.groupBy("task", "model").agg(F.count(F.lit(1)).alias("quality_values"))
    j = c.join(q, ["task", "model"], "full_outer")
    return j.where(
        F.col("ctg_lines").isNull()
        | F.col("quality_values").isNull()
        | (F.col("ctg_lines") != F.lit(4 * iters))
        | (F.col("n_iters") != F.lit(iters))
        | (F.col("bad_lines") > 0)
        | (F.col("quality_values") != F.lit(4))
    )
