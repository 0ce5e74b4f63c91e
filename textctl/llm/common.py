"""What the operators of this subpackage share."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textctl.session import ensure_checkpoint_dir, prepare

MASK = (1 << 64) - 1
#: UTF-8 bytes; A-Z to a-z, nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_session(spark: SparkSession) -> None:
    """Sets the session up for Python stages over whole texts: batches are cut
    by bytes as well as by rows, as one row may hold a very long text."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.empty(size, np.uint64)
            a[0], have = 1, 1
            while have < size:
                a[have : 2 * have] = a[:have] * np.uint64(pow(base, have, 1 << 64))
                have *= 2
            _POWERS[name] = a
    return _POWERS["up"], _POWERS["down"]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as an array with the start and end offsets of the words
    ``[^\\x20\\x09-\\x0D]+``."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return raw, none, none
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return raw, edge[0::2], edge[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of (already lower-cased) UTF-8 bytes:
    a polynomial over the bytes from prefix sums, then a finaliser."""
    raw, start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def saved(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` once to the shared checkpoint folder and reads it back:
    cuts the lineage, survives lost executors, keeps column pruning. Rows may
    be laid out in folders ``by`` a column of few values."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    """For saved tables: reads at most one row."""
    return not df.take(1)
