"""MinHash near-duplicates by fast similarity sketching.

A document is the set of its distinct ``width``-word shingles (words split
at blanks, A-Z lower-cased; a shorter text is one shingle). Its sketch has
``bins`` coordinates, filled in rounds: round i throws every shingle into a
hashed bin with a hashed value, earlier rounds rank before later ones, and
from round ``bins`` on round i throws all shingles into bin i - bins, so
that every coordinate is filled after 2 * bins rounds whatever the size of
the set; rounds stop once all are. Coordinates of two sets agree with
probability equal to their Jaccard similarity. ``rows`` coordinates make a
band; documents that share one of ``bands`` bands are candidates, and a
candidate link counts only if the full shingle sets confirm it.

How the work stays bounded without losing links:

- equal sets (exact copies) collapse into one class before anything else;
- a bucket's members are compared with one hub each, not with one another;
  members that end up in one component need no further comparison;
- what is left are members of one bucket in different components. Each such
  pair is looked at, once, within the join: sizes that exclude a link, or
  four bits of every coordinate that agree too seldom (by ``sigmas`` standard
  deviations for a pair at the threshold), settle it there; the other pairs
  go to exact confirmation. So large groups whose members share a passage,
  but are no near duplicates, do not turn into sets sent for every pair.

Defined results: null and wordless texts have an empty set and are linked
with nothing; a row without an id is linked with nothing and kept; rows that
share an id count as one document; equal rows are equal members; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, is_empty, mix64, saved, text_session, word_hashes
from .graph import components


@dataclass(frozen=True)
class Params:
    """A link: 100 * |intersection| >= percent * |union|. All coordinates are
    banded: a pair at 75 % misses all of 128 bands of 8 with probability
    1.4e-6, a pair at 77 % with 5e-8; 4.75 sigmas of four-bit codes rule out
    a pair at 75 % with 1e-6."""

    width: int = 5
    percent: int = 75
    bins: int = 1024
    rows: int = 8
    bands: int = 128
    sigmas: float = 4.75
    seed: int = 77

    @property
    def most_unequal(self) -> int:
        """Coordinates whose four bits may differ."""
        equal = 1 - 15 / 16 * (1 - self.percent / 100)
        return math.floor(self.bins * (1 - equal) + self.sigmas * math.sqrt(self.bins * equal * (1 - equal)))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    n = min(width, len(w))
    if not n:
        return w
    code = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        code += w[j : len(w) - n + 1 + j] * np.uint64(pow(0x9FB21C651E98DF25, j + 1, 1 << 64))
    return np.unique(mix64(code))


class Sketcher:
    def __init__(self, p: Params):
        rng = np.random.Generator(np.random.PCG64(p.seed))
        self.p = p
        self.seeds = rng.integers(0, 1 << 63, 2 * p.bins, dtype=np.uint64)
        self.band = rng.integers(0, 1 << 63, (1, p.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(self, s: np.ndarray) -> np.ndarray:
        bins, none = self.p.bins, np.uint64((1 << 64) - 1)
        out = np.full(bins, none)
        together = min(bins, max(1, 4096 // len(s)))  # rounds thrown at once
        for first in range(0, bins, together):
            i = np.arange(first, min(bins, first + together))
            h = mix64(s[None, :] ^ self.seeds[i, None])
            value = (i.astype(np.uint64)[:, None] << np.uint64(52)) | (h >> np.uint64(12))
            np.minimum.at(out, (h % np.uint64(bins)).astype(np.int64).ravel(), value.ravel())
            if out.max() != none:
                return out
        for b in np.flatnonzero(out == none):
            out[b] = (np.uint64(bins + b) << np.uint64(52)) | (mix64(s ^ self.seeds[bins + b]) >> np.uint64(12)).min()
        return out

    def bands(self, sketch: np.ndarray) -> np.ndarray:
        parts = sketch.reshape(-1, self.p.rows)[: self.p.bands] * self.band
        number = np.arange(len(parts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(mix64(parts).sum(axis=1, dtype=np.uint64) + number).view(np.int64)

    @staticmethod
    def code(sketch: np.ndarray) -> np.ndarray:
        """Four bits of each coordinate, 16 coordinates a number."""
        four = (mix64(sketch) & np.uint64(15)).reshape(-1, 16)
        return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of the set: two independent sums over its mixed members."""
    a = int(mix64(s).sum(dtype=np.uint64)) - (1 << 63)
    b = int(mix64(s * np.uint64(0xD1342543DE82EF95) + np.uint64(1)).sum(dtype=np.uint64)) - (1 << 63)
    return a, b


def _sketched(rows: DataFrame, p: Params) -> DataFrame:
    """(id, n, k1, k2, bands, code) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(p)
        for b in batches:
            n, k1, k2, bands, code = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, p.width)
                one, two = digest(s) if len(s) else (None, None)
                n.append(len(s))
                k1.append(one)
                k2.append(two)
                sketch = sketcher.sketch(s) if len(s) else None
                bands.append(None if sketch is None else sketcher.bands(sketch))
                code.append(None if sketch is None else sketcher.code(sketch))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(code, pa.list_(pa.int64()))], ["id", "n", "k1", "k2", "bands", "code"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, bands array<long>, code array<long>")


def _sets(rows: DataFrame, p: Params) -> DataFrame:
    """(id, n, members) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, p.width) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "members"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Sizes that
    exclude a link are left out before any set is moved; b's sets travel
    with the pairs, a's (the hubs') meet them in the last join."""
    kind = pairs.schema["a"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= p.percent * (len(x) + len(y) - both):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, arrow), pa.array(b, arrow)], ["a", "b"])

    sizes = sets.select("id", "n")
    fit = (
        pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb")), "b")
        .filter((100 * F.col("na") >= p.percent * F.col("nb")) & (100 * F.col("nb") >= p.percent * F.col("na")))
    )
    full = fit.select("a", "b", "mb").join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
    return full.select("a", "b", "ma", "mb").mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}")


def near_duplicates(docs: DataFrame, p: Params = Params(), hubs: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_shingles``, ``component_id`` (smallest
    id reachable over links) and ``kept`` (the id is the component's)."""
    spark = docs.sparkSession
    text_session(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sketched = saved(_sketched(rows, p), "sketches")
    grouped = sketched.filter("n > 0 AND id IS NOT NULL")
    classes = saved(grouped.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")

    # one row per class
    first = grouped.join(classes.withColumnRenamed("rep", "id"), ["id", "k1", "k2"], "left_semi")
    members = saved(_shared(first), "buckets")
    found = _linked(rows, members, first.select("id", "n", "code"), p, hubs)

    labelled = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = sketched.select("id", "n", "k1", "k2").join(labelled, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _shared(first: DataFrame) -> DataFrame:
    """(bucket, id) of the buckets with several members, from (id, bands)."""
    # dealt by bucket once, for the count and for the join with it
    banded = first.select("id", F.explode("bands").alias("bucket")).repartition("bucket")
    shared = banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    return banded.join(shared.select("bucket"), "bucket").select("bucket", "id")


def _linked(rows: DataFrame, members: DataFrame, codes: DataFrame, p: Params, hubs: int) -> DataFrame:
    """(node, component) from buckets (bucket, id) with several members."""
    nodes = members.select("id").distinct()
    sets = saved(_sets(rows.join(nodes, "id", "left_semi"), p), "sets")
    kind = members.schema["id"].dataType.simpleString()
    tested = links = rows.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    found = links.toDF("node", "component")
    left = members.withColumn("component", F.col("id"))
    for turn in range(hubs + 1):
        mixed = left.groupBy("bucket").agg(F.min("id").alias("hub"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        if turn < hubs:
            # every member of another component against the bucket's hub
            with_hub = left.join(mixed.select("bucket", "hub"), "bucket")
            hub = with_hub.filter("id = hub").select("bucket", F.col("component").alias("own")).dropDuplicates(["bucket"])
            pairs = with_hub.join(hub, "bucket").filter("component <> own").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        else:
            pairs = _rest(left.join(mixed.select("bucket"), "bucket", "left_semi"), codes, p)
        pairs = saved(pairs.join(tested, ["a", "b"], "left_anti") if turn else pairs, "pairs")
        if not is_empty(pairs):
            new = saved(_confirmed(pairs, sets, p), "links")
            tested = tested.unionByName(pairs)
            if not is_empty(new):
                links = links.unionByName(new)
                found = components(links)
        if turn < hubs:
            left = left.drop("component").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
            left = saved(_without_hubs(left, mixed), "buckets")
    return found


def _rest(left: DataFrame, codes: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of a bucket's members in different components, each from
    the first bucket they share, that size and sketch do not rule out."""
    # a member meets its code once, not in every bucket
    shared = left.groupBy("id").agg(F.collect_set("bucket").alias("buckets"), F.min("component").alias("component"))
    full = saved(shared.join(codes.dropDuplicates(["id"]), "id"), "mixed").withColumn("bucket", F.explode("buckets"))
    b = full.select("bucket", F.col("id").alias("b"), "component", "n", "code", "buckets")
    a = full.select("bucket", F.col("id").alias("a"), F.col("component").alias("own"), F.col("n").alias("na"), F.col("code").alias("code_a"), F.col("buckets").alias("buckets_a"))
    lowest = F.lit(0x1111111111111111)

    def unequal(x, y):
        pairs = x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1))
        return F.bit_count(pairs.bitwiseOR(F.shiftrightunsigned(pairs, 2)).bitwiseAND(lowest))

    differ = F.aggregate(F.zip_with("code_a", "code", unequal), F.lit(0), lambda total, x: total + x)
    fit = (100 * F.col("na") >= p.percent * F.col("n")) & (100 * F.col("n") >= p.percent * F.col("na"))
    once = F.array_min(F.array_intersect("buckets_a", "buckets")) == a["bucket"]
    on = (a["bucket"] == b["bucket"]) & (F.col("own") != F.col("component")) & (F.col("a") < F.col("b")) & fit & (differ <= p.most_unequal) & once
    return a.join(b, on).select("a", "b")


def _without_hubs(left: DataFrame, mixed: DataFrame) -> DataFrame:
    """Buckets that were mixed, without the hubs that were just compared
    with all members."""
    return left.join(mixed.select("bucket", "hub"), "bucket").filter("id <> hub").drop("hub")
