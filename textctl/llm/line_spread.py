"""Line dedup by distinct-site spread.

A line's spread is the number of distinct sites it stands on. HyperLogLog
sketches of the sites, one per line hash, are merged by the aggregation; a
line whose estimate lies within ``margin`` of the threshold gets an exact
distinct count. Lines on at least ``min_sites`` sites are cross-site
boilerplate: their first occurrence (smallest id, then position) stays, all
others are removed from their texts.

Lines are the pieces between newlines, compared without blanks, tabs and
returns at their ends. Defined results: blank lines are never removed; a
null text stays null and has no lines; null sites are not counted; a null id
comes before all others; rows with equal id and text are treated alike; an
empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textctl.session import prepare


@dataclass(frozen=True)
class Params:
    """``log_k``: a sketch of 2**log_k registers has a standard error of
    1.04 / sqrt(2**log_k), 1.6 % for 12; ``margin`` is six times that."""

    min_sites: int = 10
    log_k: int = 12
    margin: float = 0.1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _occurrences(rows: DataFrame) -> DataFrame:
    """(id, mark, site, pos, h1, h2) of every line with content."""
    lines = rows.select("id", "mark", "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.col("line"), F.lit(" \t\r"))).filter("line <> ''")
    return lines.select("id", "mark", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def spread(lines: DataFrame, p: Params) -> DataFrame:
    """(h1, h2, first) of the lines on at least ``min_sites`` sites."""
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", p.log_k).alias("sketch"),
        F.min(F.struct("id", "pos")).alias("first"),
    )
    low, high = min(p.min_sites * (1 - p.margin), p.min_sites - 1), max(p.min_sites * (1 + p.margin), p.min_sites + 1)
    wide = sketched.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= low)
    near = wide.filter(F.col("sites") <= high).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact"))
    counted = wide.join(exact, ["h1", "h2"], "left")
    enough = F.when(F.col("sites") > high, F.lit(True)).otherwise(F.col("exact") >= p.min_sites)
    return counted.filter(enough).select("h1", "h2", "first")


def without_boilerplate(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with its text cleaned, and ``n_lines`` (lines with content),
    ``n_removed`` added; columns of these names are replaced."""
    prepare(docs.sparkSession)
    mark = F.xxhash64(F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(site_col).alias("site")).withColumn("mark", mark)
    lines = _occurrences(rows)
    again = lines.join(spread(lines, p), ["h1", "h2"]).filter(~F.struct("id", "pos").eqNullSafe(F.col("first")))
    removed = again.groupBy("id", "mark").agg(F.collect_set("pos").alias("__removed"))
    removed = removed.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "__removed")
    out = docs.drop("n_lines", "n_removed").withColumn("__own", F.xxhash64(F.col(text_col)))
    out = out.join(removed, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")), "left")
    pieces = _lines(F.col(text_col))
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("__removed"))
    clean = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), "\n"))
    filled = F.size(F.filter(pieces, lambda x: F.trim(x, F.lit(" \t\r")) != ""))
    counts = [
        F.when(F.col(text_col).isNull(), 0).otherwise(filled).cast("long").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
    ]
    kept = [clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*kept, *counts)
