"""Sinks in the benchmark's formats.

Every sink writes with ``partitionBy`` on ``task``/``model`` (and ``iter``
where the benchmark has one file per iteration), so all tasks and models
are one write. Options are the ones that round-trip newlines, tabs, quotes,
backslashes and leading blanks (SURVEY §2.8). Line-ordered text files are
written one file per partition directory, sorted by line number; they are a
few lines each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A write replaces the folders it has rows for and leaves all others alone.
DYNAMIC = ("partitionOverwriteMode", "dynamic")

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_jsonl(df: DataFrame, path: str, partition_by=("task", "model"), mode: str = "overwrite") -> None:
    """JSON lines, UTF-8 unescaped, NULL fields kept."""
    df.write.mode(mode).option(*DYNAMIC).partitionBy(*partition_by).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, partition_by=("task", "model"), sep: str = ",", mode: str = "overwrite") -> None:
    """CSV (``sep=','``) or TSV (``sep='\\t'``)."""
    w = df.write.mode(mode).option(*DYNAMIC).partitionBy(*partition_by)
    for k, v in {**CSV_OPTIONS, "sep": sep}.items():
        w = w.option(k, v)
    w.csv(path)


def write_lines(lines: DataFrame, path: str, partition_by=("task", "model"), mode: str = "overwrite") -> None:
    """Text reports; one file per partition directory, lines in
    ``line_no`` order. The data per file is a report (tens of lines), so a
    partition per file is bounded."""
    keys = list(partition_by)
    (
        lines.repartition(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys, "line_no")
        .select(*keys, "line")
        .write.mode(mode)
        .option(*DYNAMIC)
        .partitionBy(*keys)
        .text(path)
    )


def write_leaderboard(board: DataFrame, path: str, mode: str = "overwrite", models: list[tuple[int, str]] | None = None) -> None:
    """One CSV per task; first column ``model``. Rows follow the
    registry order of ``models`` (``(idx, model_path)``; a literal map from
    the directory name to its index, no join), then the model name."""
    from ..sources.registry import sql_str, suffix_py

    rows = board.repartition("task")
    if models:
        order = F.expr("map(" + ", ".join(f"{sql_str(suffix_py(p))}, {int(i)}" for i, p in models) + ")")
        rows = rows.withColumn("_idx", order[F.col("model")]).sortWithinPartitions("task", "_idx", "model").drop("_idx")
    else:
        rows = rows.sortWithinPartitions("task", "model")
    write_csv(rows, path, partition_by=("task",), mode=mode)


def write_analysis(analysis: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The analysis table as CSV, TSV and JSON lines, one folder per
    task, model and iteration."""
    keys = ("task", "model", "iter")
    write_csv(analysis, f"{path}/csv", partition_by=keys, mode=mode)
    write_csv(analysis, f"{path}/tsv", partition_by=keys, sep="\t", mode=mode)
    write_jsonl(analysis, f"{path}/jsonl", partition_by=keys, mode=mode)


def write_judge_table(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """the judge file per task and model (CSV, list literals as text)."""
    write_csv(table, path, partition_by=("task", "model"), mode=mode)
