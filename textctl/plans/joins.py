"""Joins whose strategy is chosen from a measured size, not a guess.

``broadcast()`` is only given to a side whose size was checked: the check
is one aggregate over the (already column-pruned) small side, so it reads
only the narrow key/constraint columns. A side that carries whole texts is
never measured: it is joined plainly, and AQE decides from run-time sizes. Above the limit the join is left
to the planner (sort-merge with AQE skew splitting), which is the way that
holds when the side grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side up to this many bytes of column data is broadcast.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> tuple[int, int]:
    """``(rows, bytes)`` of the columns of ``df``: octet length of strings,
    8 bytes per other value. One aggregate job over the pruned columns."""
    widths = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "string":
            widths.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)))
        elif t.startswith("array") or t.startswith("struct") or t.startswith("map"):
            widths.append(F.coalesce(F.octet_length(F.to_json(F.col(f"`{f.name}`"))), F.lit(0)))
        else:
            widths.append(F.lit(8))
    row = widths[0] if len(widths) == 1 else sum(widths[1:], widths[0])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("b")).first()
    return int(r["n"]), int(r["b"])


def measured(df: DataFrame) -> tuple[int, int]:
    """``measured_bytes``, measured each time: a folder may have grown since
    the same plan was last measured."""
    return measured_bytes(df)


def fits_broadcast(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    return measured(df)[1] <= max_bytes


def named_rows(rows: DataFrame, known: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """One row per ``_k`` of ``rows`` (``_k, _row, task, prompt_id``, texts),
    the one with the smallest ``_row``; none for the keys in ``known``, and only the
    keys of ``asked`` if given.

    Which rows these are is found on fixed-width values, first within a
    prompt, then over all. A prompt's rows are then told by a list that is
    joined to them by ``task, prompt_id``, built from the narrow side: rows
    that are already dealt by prompt stay where they are, others are dealt
    once, and no text is sorted. Rows without a prompt are few or none and are
    found by their key.
    """
    at = ["task", "prompt_id"]
    each = rows.groupBy(*at, "_k").agg(F.min("_row").alias("_row"))
    if asked is not None:
        each = each.join(asked.select("_k"), "_k", "left_semi")
    if known is not None:
        each = each.join(known.select("_k").distinct(), "_k", "left_anti")
    one = each.groupBy("_k").agg(F.min("_row").alias("_row"))
    one = each.join(one, ["_k", "_row"], "left_semi")
    lists = one.groupBy(*at).agg(F.collect_list(F.struct("_k", "_row")).alias("_named"))
    here = rows.join(lists.hint("shuffle_hash"), at, "inner").where(F.expr("array_contains(_named, named_struct('_k', _k, '_row', _row))"))
    lost = rows.where(F.col("task").isNull() | F.col("prompt_id").isNull()).join(one.select("_k", "_row"), ["_k", "_row"], "left_semi")
    return here.select(*rows.columns).unionByName(lost.select(*rows.columns))


def _no_prompt() -> Column:
    return F.col("task").isNull() | F.col("prompt_id").isNull()


def asked_rows(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows (``_k, task, prompt_id``, texts) whose ``_k`` is one of ``asked``
    (``_k, task, prompt_id``). A prompt's rows are told by the list of its keys,
    as in ``named_rows``: no text is sorted or dealt by ``_k``."""
    at = ["task", "prompt_id"]
    lists = asked.groupBy(*at).agg(F.collect_set("_k").alias("_asked"))
    here = rows.join(lists.hint("shuffle_hash"), at, "inner").where(F.array_contains("_asked", F.col("_k")))
    lost = rows.where(_no_prompt()).join(asked.where(_no_prompt()).select("_k"), "_k", "left_semi")
    return here.select(*rows.columns).unionByName(lost.select(*rows.columns))


def with_told(rows: DataFrame, *told: DataFrame) -> DataFrame:
    """``rows`` (``_k, task, prompt_id``) left joined with each of ``told`` (the
    same and more) on ``_k``, which a prompt has to itself. What a prompt was
    told goes to its rows as one list, so rows dealt by prompt stay where they
    are and the list's entries, much alike, shrink to little."""
    at = ["task", "prompt_id"]
    here, lost = rows.where(~_no_prompt()), rows.where(_no_prompt())
    for answers in told:
        more = [c for c in answers.columns if c not in ("_k", *at)]
        lists = answers.groupBy(*at).agg(F.collect_list(F.struct("_k", *more)).alias("_told"))
        x = here.join(lists.hint("shuffle_hash"), at, "left").withColumn("_told", F.filter("_told", lambda t: t["_k"] == F.col("_k")))
        x = x.select(*here.columns, F.explode_outer("_told").alias("_told"))
        here = x.select(*here.columns, *[F.col("_told")[c].alias(c) for c in more])
        lost = lost.join(answers.where(_no_prompt()).select("_k", *more), "_k", "left").select(*here.columns)
    return here.unionByName(lost)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Join ``big`` with ``small``, broadcasting ``small`` only if it measured
    at most ``max_bytes``; otherwise a sort-merge join (hinted, so that an
    optimistic size estimate cannot turn it into a broadcast)."""
    if fits_broadcast(small, max_bytes):
        return big.join(F.broadcast(small), on, how)
    # measured too large: a sort-merge join, whatever the static estimate says
    return big.join(small.hint("merge"), on, how)
