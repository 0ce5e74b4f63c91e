"""Source divergence audit: which terms set a source apart within its
language, and how far two sources lie apart, in exact integers.

Words are counted per (language, source); a language keeps its terms of at
least ``min_docs`` documents. A group gives every kept term the share
p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), and two shares p and q
differ by f = floor((p - q)**2 / (p + q)).

How terms are ranked without sorting a group's vocabulary: f depends on two
counts alone, so a group's terms are first counted into cells of (count in
the group, count in the language). f is evaluated per cell, equal values are
merged, and the cumulative multiplicity of the values in falling order tells
which ones reach the ranks wanted; the ten largest values per group are taken
in each task before anything moves. Only the terms of those cells are
expanded, in UTF-8 order. Pairs of sources are summed by tasks over their own
share of the terms, as one matrix per language; no pair is emitted per term.

The text is read once. A task counts with tables of bounded size and emits
partial counts, which Spark adds, so a source or language that holds most
rows is added up before it moves. The vocabulary, not the text, is what
later steps read. A row per kept term holds one count per source.

Defined results: null text, lang, source are ''; every row is a document of
its own, repeated rows and ids included; a group without kept terms has value
0 towards every other and no terms; ties are ranked by item in UTF-8 order;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textctl.plans.joins import join_small

from .common import LOWER, saved, text_session

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = 1_000_000_000


@dataclass(frozen=True)
class Params:
    """``held``: (source, term) counts a task keeps before it emits them."""

    min_docs: int = 10
    ranks: int = 10
    held: int = 300_000


def _count(held: int):
    """Rows of (lang, source, text) to partial counts of terms; a row with a
    null term names each group."""

    def rows(occurrences: dict, documents: dict) -> pa.RecordBatch:
        keys = [(lang, source, term) for (lang, source), c in occurrences.items() for term in (None, *c)]
        names = ["lang", "source", "term"]
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        for name, counts in (("count", occurrences), ("docs", documents)):
            names.append(name)
            columns.append(pa.array([n for c in counts.values() for n in (0, *c.values())], pa.int64()))
        return pa.RecordBatch.from_arrays(columns, names)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}
        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                group = (lang or "", source or "")
                if group not in occurrences:
                    occurrences[group], documents[group] = Counter(), Counter()
                words = TERM.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"))
                occurrences[group].update(words)
                # both tables get their keys in the same order
                documents[group].update(dict.fromkeys(words).keys())
            if sum(map(len, occurrences.values())) > held:
                yield rows(occurrences, documents)
                occurrences, documents = {}, {}
        yield rows(occurrences, documents)

    return fn


def _share(count: Column, n: Column, v: Column) -> Column:
    """p; decimals, as 10**9 * count passes a long on large corpora."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    bottom = (n + 2 * v).cast("decimal(20,0)")
    return F.floor(_div(top, bottom)).cast("long") + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """``_share`` of an array; Python integers over its distinct counts."""
    distinct, back = np.unique(counts, return_inverse=True)
    return np.array([1 + UNIT * (int(c) + 2) // (n + 2 * v) for c in distinct], np.int64)[back]


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, the sums of f over a task's terms for every pair of
    sources (the first before the second)."""
    sums: dict[str, np.ndarray] = {}
    groups: dict[str, tuple[list[str], list[int], int]] = {}
    for b in batches:
        lang = np.array(b.column("lang").to_pylist(), object)
        for name in dict.fromkeys(lang):
            at = np.flatnonzero(lang == name)
            if name not in sums:
                row = b.column("sources")[int(at[0])].as_py()
                groups[name] = ([r["source"] for r in row], [r["n"] for r in row], b.column("v")[int(at[0])].as_py())
                sums[name] = np.zeros((len(row), len(row)), np.int64)
            sources, n, v = groups[name]
            number = {s: i for i, s in enumerate(sources)}
            step = max(1, (1 << 20) // len(sources))
            for start in range(0, len(at), step):
                part = b.column("by").take(pa.array(at[start : start + step]))
                flat = part.flatten()
                term = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False))
                names = flat.field("source").dictionary_encode()
                source = np.array([number[s] for s in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
                counts = np.zeros((len(sources), len(part)), np.int64)
                counts[source, term] = flat.field("count").to_numpy()
                p = np.stack([_shares(c, n[i], v) for i, c in enumerate(counts)])
                for i in range(len(sources) - 1):
                    d = p[i + 1 :] - p[i]
                    sums[name][i, i + 1 :] += (d * d // (p[i + 1 :] + p[i])).sum(1)
    for name, total in sums.items():
        a, b_ = np.triu_indices(len(total), 1)
        sources = groups[name][0]
        columns = [pa.array([name] * len(a), pa.string()), pa.array([sources[i] for i in a], pa.string()), pa.array([sources[i] for i in b_], pa.string()), pa.array(total[a, b_])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def counted(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """``terms`` (lang, term, count, by: counts per source) of the kept
    terms, and ``groups`` (lang, source, n, lang_n, v) of all groups."""
    text_session(docs.sparkSession)
    parts = docs.select("lang", "source", "text").mapInArrow(_count(p.held), "lang string, source string, term string, count long, docs long")
    counts = saved(parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "term-counts")
    terms = counts.filter("term IS NOT NULL").groupBy("lang", "term")
    terms = terms.agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"), F.collect_list(F.struct("source", "count")).alias("by"))
    terms = saved(terms.filter(F.col("docs") >= p.min_docs).select("lang", "term", "count", "by"), "terms")
    own = terms.select("lang", F.inline("by")).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = terms.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.count(F.lit(1)).alias("v"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return terms, saved(groups.na.fill(0, ["n", "lang_n", "v"]), "groups")


def distinctive_terms(terms: DataFrame, groups: DataFrame, p: Params = Params()) -> DataFrame:
    """(lang, source, item, value, rank): the first ``ranks`` kept terms that
    a group has and gives more than its language does."""
    each = terms.select("lang", F.col("term").alias("item"), F.col("count").alias("all"), F.inline("by"))
    cells = join_small(each.groupBy("lang", "source", "count", "all").agg(F.count(F.lit(1)).alias("terms")), groups, ["lang", "source"])
    cells = cells.withColumns({"p": _share(F.col("count"), F.col("n"), F.col("v")), "q": _share(F.col("all"), F.col("lang_n"), F.col("v"))})
    cells = saved(cells.filter("count > 0 AND p > q").select("lang", "source", "count", "all", "terms", _distance(F.col("p"), F.col("q")).alias("value")), "cells")
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    values = values.withColumn("at", F.row_number().over(down)).filter(F.col("at") <= p.ranks)
    before = F.coalesce(F.sum("terms").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).filter(F.col("before") < p.ranks).select("lang", "source", "value")
    wanted = saved(join_small(cells.drop("terms"), values, ["lang", "source", "value"]), "wanted-cells")
    found = join_small(each, wanted, ["lang", "source", "count", "all"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= p.ranks).select("lang", "source", "item", "value", "rank")


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language
    by its distance over all kept terms."""
    langs = groups.filter("v > 0").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.first("v").alias("v"))
    at = join_small(terms.select("lang", "by"), langs, "lang")
    half = at.mapInArrow(_pair_sums, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    half = saved(half, "pairs")
    # without kept terms every pair of the language has value 0
    bare = groups.filter("v = 0").select("lang", "source")
    none = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).unionByName(none)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank)


def audit(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Both parts: lang, source, part ('pair' or 'term'), item, value, rank."""
    terms, groups = counted(docs, p)
    parts = [(source_pairs(terms, groups), "pair"), (distinctive_terms(terms, groups, p), "term")]
    one, two = (df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for df, name in parts)
    return one.unionByName(two)
