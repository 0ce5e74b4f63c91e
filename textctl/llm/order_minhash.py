"""Document fingerprints by Order MinHash.

A text is the multiset of its k-mers of code points; the j-th occurrence of
a k-mer is an element of its own (k-mer, j). Each of ``size`` random orders
selects the ``tuple_size`` smallest elements, puts them back into the order
in which they stand in the text, and hashes that tuple of k-mers. The share
of equal entries of two fingerprints estimates a likeness that falls with
edit distance: it sees moved and repeated passages, which a set sketch does
not.

Defined results: a null or empty text has the empty fingerprint ''; two
empty texts have likeness 1, an empty and a non-empty one 0. A text shorter
than k is one k-mer. Equal texts have equal fingerprints. Other columns of
the input are ignored, whatever their names. An empty table gives an empty
result. Repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions, text_session


@dataclass(frozen=True)
class Params:
    """``k`` is a power of two (k-mer hashes are built by doubling)."""

    k: int = 8
    tuple_size: int = 2
    size: int = 64
    seed: int = 20240817


_BASE = 0xC6A4A7935BD1E995
_BLOCK = 2048
_CHUNK = 1 << 16


class Sketcher:
    def __init__(self, p: Params):
        if p.k & (p.k - 1):
            raise ValueError("k must be a power of two")
        rng = np.random.Generator(np.random.PCG64(p.seed))
        self.p = p
        self.mul = (rng.integers(0, 1 << 31, p.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)[:, None]
        self._rows = np.arange(p.size)
        self._x = np.empty(p.size * _BLOCK, np.uint32)
        self.tuple_mul = rng.integers(0, 1 << 63, p.tuple_size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def kmers(self, texts: list[str]) -> list[np.ndarray]:
        """Hashes of each text's k-mers, in text order."""
        k = self.p.k
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        codes += np.uint64(1)
        h, width = codes, 1
        while width < k:
            h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
            width *= 2
        h = mix64(h)
        out, at = [], 0
        for t in texts:
            if len(t) >= k:
                out.append(h[at : at + len(t) - k + 1])
            else:
                code = 0
                for c in codes[at : at + len(t)].tolist():
                    code = (code * _BASE + c) & (1 << 64) - 1
                out.append(mix64(np.array([code], np.uint64)))
            at += len(t)
        return out

    @staticmethod
    def numbered(parts: list[np.ndarray]) -> list[np.ndarray]:
        """32-bit hashes of each text's elements (k-mer, occurrence number)."""
        h = np.concatenate(parts)
        n = len(h)
        sizes = [len(p) for p in parts]
        own = h + np.repeat(np.arange(len(parts), dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), sizes)
        bits = np.uint64(int(n).bit_length())
        s = own >> bits
        s <<= bits
        s |= np.arange(n, dtype=np.uint64)
        s.sort()
        at = (s & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
        s >>= bits
        again = np.flatnonzero(s[1:] == s[:-1]) + 1
        again = again[own[at[again]] == own[at[again - 1]]]  # the same text's k-mer as before it
        out = (h >> np.uint64(32)).astype(np.uint32)
        if len(again):
            run = np.flatnonzero(np.diff(again, prepend=-1) != 1)
            count = np.arange(len(again)) - np.repeat(run, np.diff(run, append=len(again))) + 1
            at = at[again]
            out[at] = mix64(h[at] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return np.split(out, np.cumsum(sizes[:-1]))

    def smallest(self, g: np.ndarray) -> np.ndarray:
        """Places of the ``tuple_size`` smallest elements (the last one again
        if there are fewer), for each order."""
        want = self.p.tuple_size
        values, pick = [], []
        for at in range(0, len(g), _BLOCK):
            part = g[at : at + _BLOCK]
            x = np.multiply(self.mul, part, out=self._x[: self.p.size * len(part)].reshape(self.p.size, -1))
            for turn in range(min(want, len(part))):  # the smallest of the block, one after the other
                if turn:
                    x[self._rows, col] = 0xFFFFFFFF
                col = x.argmin(axis=1)
                if len(g) > _BLOCK:
                    values.append(x[self._rows, col])
                pick.append(col + at)
        if len(pick) > want:
            return np.take_along_axis(np.array(pick), np.argsort(np.array(values), axis=0, kind="stable")[:want], axis=0)
        return np.array(pick + [np.full(self.p.size, len(g) - 1)] * (want - len(pick)))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """``size`` 32-bit entries a text; none for an empty text. Short
        texts are read together, as calls would cost more than the work."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        chunk: list[int] = []
        length = 0
        for i, t in enumerate(texts):
            if t:
                chunk.append(i)
                length += len(t)
            if chunk and (length >= _CHUNK or i == len(texts) - 1):
                parts = self.kmers([texts[j] for j in chunk])
                pick = np.array([self.smallest(g) for g in self.numbered(parts)])
                pick.sort(axis=1)  # back into the order of the text
                sizes = np.array([len(h) for h in parts])
                pick += (np.cumsum(sizes) - sizes)[:, None, None]
                picked = np.concatenate(parts)[pick]
                code = np.minimum(sizes, self.p.tuple_size).astype(np.uint64)[:, None]
                for n in range(self.p.tuple_size):
                    code = code + picked[:, n] * self.tuple_mul[n]
                for j, entries in zip(chunk, (mix64(code) >> np.uint64(32)).astype(np.uint32)):
                    out[j] = entries
                chunk, length = [], 0
        return out


def as_text(sketch: np.ndarray) -> str:
    """Hex, eight digits an entry."""
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.count_nonzero(a == b) / len(a))


def fingerprints(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and its ``fingerprint``."""
    text_session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(p)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_text(x) for x in sketch([t or "" for t in texts])], pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edit(text: str, other: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, copy, id, text) sorted within partitions so that each
    document is followed by the next one in descending id.

    The ids are cut into ranges by quantiles (an aggregate over ids alone);
    each range ends with a copy of the row that begins the next one, so that
    no task needs rows of another. What reaches the driver are two numbers
    a range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = 4 * partitions(spark)
    ids = rows.select("id")
    bounds = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))
    # the bucket falls with the id; null ids come after all others
    bucket = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(
        F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b >= F.col("id"))) if bounds else F.lit(0)
    )
    firsts = ids.groupBy(bucket.alias("bucket")).agg(F.max("id").alias("id")).orderBy("bucket").collect()
    before = [(r["id"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]  # the first row of all goes to the last range
    heads = spark.createDataFrame(before, f"head {rows.schema['id'].dataType.simpleString()}, target int")
    placed = rows.join(F.broadcast(heads), rows["id"].eqNullSafe(heads["head"]), "left")
    own = F.struct(bucket.cast("int").alias("bucket"), F.lit(0).alias("copy"))
    also = F.struct(F.col("target").alias("bucket"), F.lit(1).alias("copy"))
    at = F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, also)))
    placed = placed.select(at.alias("at"), "id", "text").select("at.bucket", "at.copy", "id", "text")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "copy", F.col("id").desc_nulls_last(), "text")


def edited_likeness(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``edit``; the
    other text is the next document's in descending id, the first one's after
    the last), with the likeness of the text to its edited text and to the
    next text. Rows of equal ids are ordered by text; null ids come last.
    """
    text_session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(p)
        held: tuple = ()  # bucket and (id, text, sketch) of the row whose successor is to come
        closed = None  # the bucket whose successor copy has been read
        for b in batches:
            buckets, copies, ids, texts = (c.to_pylist() for c in b.columns)
            texts = [t or "" for t in texts]
            pairs = []  # row, its successor
            for row in zip(buckets, copies, ids, texts, sketch(texts)):
                bucket, copy, *rest = row
                if copy and bucket == closed:
                    continue  # further rows with the id of the copied row
                if held and held[0] == bucket:
                    pairs.append((held[1], rest))
                held = () if copy else (bucket, rest)
                closed = bucket if copy else None
            edited = [edit(one[1], two[1]) for one, two in pairs]
            out = [
                (doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, after))
                for ((doc, text, own), (_, _, after)), new, other in zip(pairs, edited, sketch(edited))
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    rows = _in_order(docs, id_col, text_col)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(rows.schema["id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
