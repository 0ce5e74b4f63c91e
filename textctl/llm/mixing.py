"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic, with the
sum of their tokens. The cells' token weights are raked: in turn scaled to
each dimension's target shares and bounded by what a cell holds, round after
round until all three dimensions meet their targets to ``tolerance``. A
document is kept with its cell's probability, kept share of tokens * raked
share / observed share, decided by a hash of its id, so that runs and cluster
sizes agree. There is no upsampling.

The bound is inside the loop, so what one cell cannot give, others of its
categories do. ``budget`` is the share of all tokens to keep; it is lowered
to ``margin`` times what the scarcest category allows, and by a tenth
whenever two rounds leave more than ``stall`` of the gap, but not under
``least``: one tiny source shall not cost the whole corpus. Where the rounds
stall there, categories that miss their targets are kept as far as the others
allow; ``marginals`` reports target and reached share of every category.

Only DataFrame operations are used. The text is read twice: for the cells,
and for the decisions. The cells, at most the product of the categories, are
written before anything else and again every other round; every dimension's
sums are window sums over them, so plans stay small whatever the rounds. The
driver gets single numbers.

Defined results: a null category is the category ''; a null or empty text
has no tokens; documents of cells without tokens have probability 0; a
category without a target keeps its observed share, one without tokens has
target 0, and shares are scaled to sum to 1 over the categories that occur; a
null id is hashed as ''; repeated rows get equal decisions; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textctl.session import prepare

from .common import saved

DIMENSIONS = ("source", "lang", "topic")
MAX_BROADCAST_CELLS = 100_000


@dataclass(frozen=True)
class Params:
    """``targets``: per dimension either an exponent (target share in
    proportion to the observed share to that power: 1 leaves it, 0 makes all
    equal) or a mapping of categories to shares."""

    targets: Mapping[str, float | Mapping[str, float]] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.8})
    budget: float = 0.5
    least: float = 0.4
    margin: float = 0.95
    tolerance: float = 1e-5
    stall: float = 0.9
    rounds: int = 200
    seed: str = "mix"


def topic(text: Column) -> Column:
    """A rule-based topic: legal, tabular, contact or prose."""
    return (
        F.when(text.contains("icens"), "legal")
        .when(text.contains(" | "), "tabular")
        .when(text.contains("@") | text.contains("http"), "contact")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Rounds whose result is written at once, after which the gap is looked at.
STRIDE = 2


def _targets(cells: DataFrame, p: Params) -> DataFrame:
    """Every dimension's categories with observed and target share:
    (dim, category, seen, target)."""
    parts = []
    for d in DIMENSIONS:
        rule = p.targets.get(d, 1.0)
        seen = cells.groupBy(F.col(d).alias("category")).agg(F.sum("seen").alias("seen"))
        if isinstance(rule, Mapping):
            given = F.create_map(*[x for k, v in sorted(rule.items()) for x in (F.lit(k), F.lit(float(v)))]) if rule else None
            want = F.coalesce(F.try_element_at(given, F.col("category")), F.col("seen")) if rule else F.col("seen")
        else:
            want = F.pow("seen", F.lit(float(rule)))
        parts.append(seen.select(F.lit(d).alias("dim"), "category", "seen", F.when(F.col("seen") > 0, want).otherwise(0.0).alias("want")))
    wanted = saved(parts[0].unionByName(parts[1]).unionByName(parts[2]), "wanted")
    sums = wanted.groupBy("dim").agg(F.sum("want").alias("all"))  # a row per dimension
    return saved(wanted.join(F.broadcast(sums), "dim").select("dim", "category", "seen", F.coalesce(F.try_divide("want", "all"), F.lit(0.0)).alias("target")), "targets")


def _gap(d: str) -> Column:
    """How far a cell's category is from its target."""
    return F.abs(F.sum("share").over(Window.partitionBy(d)) - F.col(f"target_{d}"))


def rake(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """``cells`` (the dimensions and ``tokens``) with their raked ``share``
    of the kept tokens, the targets of their categories, ``factor`` (raked
    share over observed share) and ``probability``, the part of them that is
    kept."""
    cells = saved(cells.select(*DIMENSIONS, F.col("tokens").cast("double").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens").alias("total")).first()["total"] or 0.0
    cells = cells.withColumn("seen", F.col("tokens") / F.lit(total) if total else F.lit(0.0))
    targets = _targets(cells, p)
    for d in DIMENSIONS:
        cells = cells.join(targets.filter(F.col("dim") == d).select(F.col("category").alias(d), F.col("target").alias(f"target_{d}")), d)
    scarcest = targets.filter("target > 0").agg(F.min(F.col("seen") / F.col("target")).alias("m")).first()["m"]
    keep = max(min(p.budget, p.margin * scarcest), min(p.least, p.budget)) if total else 0.0
    cells = saved(cells.withColumn("share", F.col("seen")), "raked")
    floor = min(p.least, p.budget)
    turn, gap, stop = 0, float("inf"), not total
    while not stop and turn < p.rounds:
        for _ in range(STRIDE):
            for d in DIMENSIONS:
                now = F.sum("share").over(Window.partitionBy(d))
                fitted = F.when(now > 0, F.col("share") * F.col(f"target_{d}") / now).otherwise(0.0)
                cells = cells.withColumn("share", F.least(fitted, F.col("seen") / F.lit(keep)))
        turn += STRIDE
        cells = saved(cells, "raked")
        before, gap = gap, cells.select(F.greatest(*[_gap(d) for d in DIMENSIONS]).alias("gap")).agg(F.max("gap").alias("gap")).first()["gap"]
        stalled = gap > p.stall * before
        stop = gap <= p.tolerance or (stalled and keep <= floor)
        if stalled and not stop:
            keep = max(keep * 0.9, floor)
    probability = F.when(F.col("seen") > 0, F.least(F.lit(1.0), F.lit(keep) * F.col("share") / F.col("seen"))).otherwise(0.0)
    factor = F.when(F.col("seen") > 0, F.col("share") / F.col("seen")).otherwise(0.0)
    return cells.withColumns({"factor": factor, "probability": probability})


def marginals(raked: DataFrame) -> DataFrame:
    """(dim, category, target, reached, kept_tokens) of raked cells; what the
    bounds keep from a target shows as a difference."""
    kept = raked.withColumn("kept_tokens", F.col("tokens") * F.col("probability"))
    total = kept.agg(F.sum("kept_tokens").alias("t")).first()["t"] or 0.0
    parts = [
        kept.groupBy(F.lit(d).alias("dim"), F.col(d).alias("category")).agg(F.first(f"target_{d}").alias("target"), F.sum("kept_tokens").alias("kept_tokens")) for d in DIMENSIONS
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("dim", "category", "target", (F.col("kept_tokens") / F.lit(total) if total else F.lit(0.0)).alias("reached"), "kept_tokens")


def cells_of(docs: DataFrame, text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """The cells of documents, with their tokens."""
    dims = _dimensions(text_col, topic_col)
    rows = docs.select(*[c.alias(d) for d, c in dims.items()], tokens(F.col(text_col)).alias("tokens"))
    return rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def _dimensions(text_col: str, topic_col: str | None) -> dict[str, Column]:
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(topic_col) if topic_col else topic(F.col(text_col))}
    return {d: F.coalesce(c.cast("string"), F.lit("")) for d, c in dims.items()}


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """Every row of ``docs`` with ``n_tokens``, ``probability`` and ``kept``
    added (columns of these names are replaced)."""
    prepare(docs.sparkSession)
    docs = docs.drop("n_tokens", "probability", "kept")
    rows = docs.withColumns({f"__{d}": c for d, c in _dimensions(text_col, topic_col).items()} | {"n_tokens": tokens(F.col(text_col))})
    raked = saved(rake(cells_of(docs, text_col, topic_col), p), "factors")
    raked = raked.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.round("probability", 6).alias("__p"))
    small = raked.count() <= MAX_BROADCAST_CELLS
    out = rows.join(F.broadcast(raked) if small else raked, [f"__{d}" for d in DIMENSIONS], "left")
    out = out.withColumn("probability", F.coalesce("__p", F.lit(0.0))).withColumn("kept", chance(F.col(id_col), p.seed) < F.col("probability"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_tokens", "probability", "kept")
