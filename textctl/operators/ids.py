"""Sequential ids without putting a whole group into one task.

A ``row_number()`` over ``partitionBy(task)`` would sort every prompt of a
task in one task. Instead the key space is cut at explicit boundaries, taken
once from a sample that a hash of the key selects. A row's bucket is an
expression of its key and those boundaries, so it is the same in every
evaluation and under every partitioning. Rows are numbered within (group,
bucket) and shifted by the count of the group's rows in the buckets before.
The offsets have at most ``buckets + groups`` rows; they are broadcast only
when that bound, from the measured number of groups, fits the broadcast
limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import target_partitions

#: Sampled keys per bucket.
SAMPLE = 64


def _offsets_fit(keys: DataFrame, group_cols: list[str], partitions: int) -> bool:
    """Whether the offset table is certainly small: at most ``partitions +
    groups`` rows of the group columns and two numbers. Measures the distinct
    groups (a partial aggregate over the narrow keys)."""
    from ..plans import joins

    groups, group_bytes = joins.measured(keys.select(*group_cols).distinct())
    per_row = (group_bytes / groups if groups else 0) + 24
    return (partitions + groups) * per_row <= joins.DEFAULT_BROADCAST_BYTES


def _boundaries(keys: DataFrame, place, buckets: int) -> list:
    """At most ``buckets - 1`` places that cut the keys into about equal
    parts. About ``SAMPLE`` keys a bucket come to the driver."""
    every = max(1, keys.count() // (buckets * SAMPLE))
    some = keys.select(place.alias("p")).where(F.pmod(F.xxhash64("p"), F.lit(every)) == 0)
    rows = [r["p"] for r in some.orderBy("p").collect()]
    return [rows[i] for i in sorted({j * len(rows) // buckets for j in range(1, buckets)})] if rows else []


def _literal(value, kind):
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


def row_numbers(keys: DataFrame, group_cols: list[str], order_col: str, out: str = "rank0", partitions: int | None = None) -> DataFrame:
    """Add ``out``: 0-based position of each row within its group, ordered
    by ``order_col`` (unique within a group)."""
    n = partitions or target_partitions(keys.sparkSession)
    place = F.struct(*group_cols, order_col)
    kind = keys.select(place.alias("p")).schema["p"].dataType
    cuts = [_literal(c, kind) for c in _boundaries(keys, place, n)]
    bucket = F.size(F.filter(F.array(*cuts), lambda c: c < place)) if cuts else F.lit(0)
    placed = keys.withColumn("_bucket", bucket)
    on = ["_bucket", *group_cols]
    before = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*on).agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = offsets.select(*on, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    within = F.row_number().over(Window.partitionBy(*on).orderBy(order_col)) - 1
    ranked = placed.withColumn("_rank", within).alias("r")
    small = F.broadcast(offsets) if _offsets_fit(keys, group_cols, n) else offsets.hint("merge")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    return ranked.join(small.alias("o"), same).select(*[F.col(f"r.{c}") for c in keys.columns], (F.col("_off") + F.col("_rank")).alias(out))


def generated_text_ids(prompts: DataFrame, models: list[tuple[int, str]]) -> DataFrame:
    """For each task run, ids count on across the run's models in
    master order: ``position * n_prompts(task) + rank``. ``prompts`` needs
    ``task, prompt_id``; the output has ``task, model_path, prompt_id,
    generated_text_id``."""
    from ..plans.joins import join_small
    from ..sources.registry import models_literal

    keys = prompts.select("task", "prompt_id")
    # numeric ids in numeric order, whatever their type
    number = F.expr("try_cast(prompt_id AS DECIMAL(38, 0))")
    ranked = row_numbers(keys.withColumn("_order", F.struct(number.alias("n"), F.col("prompt_id"))), ["task"], "_order").drop("_order")
    counts = keys.groupBy("task").agg(F.count(F.lit(1)).alias("_n"))  # one row per task
    run = [(pos, path) for pos, (_, path) in enumerate(models)]
    x = join_small(ranked, counts, "task").select("task", "prompt_id", "rank0", "_n", F.explode(models_literal(run)).alias("m"))
    return x.select(
        "task",
        F.col("m.model_path").alias("model_path"),
        F.col("m.model").alias("model"),
        "prompt_id",
        (F.col("m.model_idx").cast("long") * F.col("_n") + F.col("rank0")).alias("generated_text_id"),
    )
