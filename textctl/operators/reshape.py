"""Wide <-> long (C6, E6, D3, F1) and sequential ids.

Long is the engine form: one row per ``(task, model, prompt_id, aspect,
iter)``. Wide is the benchmark's file form: one row per prompt and model,
one array per aspect ordered by iteration. Grouping for wide is by
``(task, model, prompt_id)``, so a group holds at most aspects x iterations
rows, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ASPECTS

WIDE_KEYS = ["task", "model_path", "model", "prompt_id"]


def to_wide(long: DataFrame, values: dict[str, str] | None = None, aspects=ASPECTS) -> DataFrame:
    """One array per aspect and value column, ordered by ``iter``.

    ``values`` maps a long column to a name pattern, by default
    ``raw_text -> {a}_result`` and ``clean_text -> {a}_result_wo_hf``. An
    aspect with no rows gives a NULL column (the benchmark leaves it out).
    """
    values = values or {"raw_text": "{a}_result", "clean_text": "{a}_result_wo_hf"}
    values = {k: v for k, v in values.items() if k in long.columns}
    keys = [k for k in WIDE_KEYS if k in long.columns]
    g = (
        long.groupBy(*keys)
        .pivot("aspect", list(aspects))
        .agg(F.array_sort(F.collect_list(F.struct("iter", *values.keys()))))
    )
    def field(name):
        return lambda x: x.getField(name)

    out = [F.col(k) for k in keys]
    for a in aspects:
        arr = F.col(f"`{a}`")
        for src, pattern in values.items():
            out.append(F.when(F.size(arr) > 0, F.transform(arr, field(src))).alias(pattern.format(a=a)))
    return g.select(*out)


def wide_aspects(wide: DataFrame, suffix: str = "_result") -> list[str]:
    return [a for a in ASPECTS if f"{a}{suffix}" in wide.columns]


def judged_columns(wide: DataFrame) -> list[str]:
    """the columns judged for quality are found by name (``wo_hf``)."""
    return [c for c in wide.columns if "wo_hf" in c]


def to_long(wide: DataFrame, raw_suffix: str = "_result", clean_suffix: str = "_result_wo_hf") -> DataFrame:
    """One row per iteration of every aspect column present.

    ``raw_text`` comes from ``{a}_result``, ``clean_text`` from
    ``{a}_result_wo_hf`` at the same position (NULL if that column or
    element is missing; ``get`` never raises on a short array).
    """
    keys = [k for k in WIDE_KEYS if k in wide.columns]
    aspects = wide_aspects(wide, raw_suffix)
    if not aspects:
        raise ValueError("no {aspect}_result column in the wide table")
    per_aspect = F.array(
        *[
            F.struct(
                F.lit(a).alias("aspect"),
                F.col(f"{a}{raw_suffix}").alias("raw"),
                (F.col(f"{a}{clean_suffix}") if f"{a}{clean_suffix}" in wide.columns else F.lit(None).cast("array<string>")).alias("clean"),
            )
            for a in aspects
        ]
    )
    x = wide.select(*keys, F.explode(per_aspect).alias("s"))
    x = x.select(*keys, F.col("s.aspect").alias("aspect"), F.col("s.clean").alias("_clean"), F.posexplode(F.col("s.raw")).alias("iter", "raw_text"))
    return x.select(*keys, "aspect", F.col("iter").cast("int").alias("iter"), "raw_text", F.get(F.col("_clean"), F.col("iter")).alias("clean_text"))


def clean_wide(wide: DataFrame, cleaner) -> DataFrame:
    """D3: ``{a}_result -> {a}_result_wo_hf`` by an element-wise cleaner
    ``cleaner(task_col, text_col) -> Column`` (e.g. ``clean.rule_clean``)."""
    return wide.withColumns(
        {
            f"{a}_result_wo_hf": F.transform(F.col(f"{a}_result"), lambda x: cleaner(F.col("task"), x))
            for a in wide_aspects(wide)
        }
    )
