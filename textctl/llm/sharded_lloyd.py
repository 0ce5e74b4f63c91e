"""Centroid clustering by dimension-sharded Lloyd rounds, in exact integers.

A vector's components become integers, floor(scale * x), and are cut into
column blocks of ``width`` components. Vectors are dealt into chunks of
``chunk`` rows; a row of the block table holds one column block of one chunk.
The table is written once, bucketed by (shard, chunk), so that it is never
shuffled again. A round is then:

1. column-block tasks compute, against their slice of the centroids only,
   the exact partial distances of a chunk to every centroid;
2. the partial distances of a chunk are added over its column blocks (a
   shuffle of one number per vector, centroid and block) and the smallest sum
   names the cluster, ties the smaller number;
3. the labels, one number per vector, go back to the column blocks; each
   shard adds up its own components per cluster and replaces its own slice
   by floor(sum / count); a slice of an empty cluster stays.

A slice has k * width numbers, bounded by the parameters, so slices are
broadcast; nothing that grows with the rows is. A round's slices are written
to the shared folder, which cuts the lineage: a lost executor costs at most
the round it was in. Chunks have the same number of rows whatever the data,
so equal or very common vectors are no hot key.

Defined results: a null vector, one with another number of components, or
with a null, NaN or infinite component is not kept; a null id counts as ''
in the choice of the first centroids, and its vector is clustered like any
other; repeated rows are rows of their own; vectors of one id are told apart
by their components in that choice; with fewer than ``k`` kept vectors there
are as many clusters; an empty table gives an empty result; other columns
are ignored. Integers are limited to +-2**27 (a component of 131,072 at the
scale 1,024), so that every squared distance fits in a long; inertias that do
not are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textctl.session import ensure_checkpoint_dir, prepare

from .common import is_empty, partitions, saved

LIMIT = 1 << 27


@dataclass(frozen=True)
class Params:
    k: int = 8
    rounds: int = 10
    dims: int = 64
    width: int = 16
    scale: int = 1024
    rows: int = 4096
    seed: str = "3"

    @property
    def shards(self) -> int:
        return math.ceil(self.dims / self.width)

    @property
    def chunk(self) -> int:
        """Rows of a chunk: its distances to all centroids stay under 32 MB."""
        return max(1, min(self.rows, (1 << 22) // max(self.k, self.width)))


def whole(vector: Column, p: Params) -> Column:
    """Whether a vector is kept."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce((F.size(vector) == p.dims) & finite, F.lit(False))


def _integer(x: Column, p: Params) -> Column:
    scaled = x.cast("double") * F.lit(float(p.scale))
    return F.floor(F.greatest(F.least(scaled, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long")


def _integers(x: np.ndarray, p: Params) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(np.clip(x.astype(np.float64) * float(p.scale), -LIMIT, LIMIT)).astype(np.int32)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and components of ``size`` rows at a time (the last has fewer)."""
    ids, rows, n = [], [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            take = min(size - n, b.num_rows - at)
            part = b.slice(at, take)
            ids.append(part.column(0))
            rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(take, -1))
            at, n = at + take, n + take
            if n == size:
                yield pa.concat_arrays(ids), np.concatenate(rows)
                ids, rows, n = [], [], 0
    if n:
        yield pa.concat_arrays(ids), np.concatenate(rows)


def _cut(p: Params, id_type: pa.DataType):
    """Rows of (id, vector) to column blocks; block 0 carries the ids."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, (ids, x) in enumerate(_chunks(batches, p.chunk)):
            x = _integers(x, p)
            listed = pa.array([ids.to_pylist()] + [None] * (p.shards - 1), pa.list_(id_type))
            data = [np.ascontiguousarray(x[:, s * p.width : (s + 1) * p.width]).tobytes() for s in range(p.shards)]
            chunk = pa.array([first + number] * p.shards, pa.int64())
            columns = [chunk, pa.array(range(p.shards), pa.int32()), pa.array([len(x)] * p.shards, pa.int32()), listed, pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "shard", "n", "ids", "data"])

    return fn


class _Blocks:
    """The column blocks as a table bucketed by (shard, chunk)."""

    def __init__(self, kept: DataFrame, p: Params, id_col: str, vec_col: str):
        self.spark: SparkSession = kept.sparkSession
        id_type = kept.schema[id_col].dataType
        types = {"chunk": T.LongType(), "shard": T.IntegerType(), "n": T.IntegerType(), "ids": T.ArrayType(id_type), "data": T.BinaryType()}
        schema = T.StructType([T.StructField(name, kind) for name, kind in types.items()])
        cut = kept.select(F.col(id_col), F.col(vec_col)).mapInArrow(_cut(p, to_arrow_type(id_type)), schema)
        n = partitions(self.spark)
        self.name = f"column_blocks_{uuid4().hex}"
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{self.name}"
        # chunk numbers follow the tasks that read the vectors: fixed by writing them
        staged = saved(cut, "column-blocks")
        staged.repartition(n, "shard", "chunk").write.bucketBy(n, "shard", "chunk").option("path", path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forgets the table's name; its files lie in the checkpoint folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _first_slices(kept: DataFrame, p: Params, id_col: str, vec_col: str) -> DataFrame:
    """(shard, slice): the vectors with the ``k`` smallest hashes of their
    ids. The top k are taken per task before anything moves."""
    digest = F.sha2(F.concat(F.lit(p.seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    top = kept.select(digest.alias("digest"), F.transform(vec_col, lambda x: _integer(x, p)).alias("x")).orderBy("digest", "x").limit(p.k)
    top = top.select(F.row_number().over(Window.orderBy("digest", "x")).alias("cluster"), "x")  # k rows; equal ones are told apart
    rows = top.select("cluster", F.posexplode("x").alias("dim", "value"))
    order = F.sort_array(F.collect_list(F.struct("cluster", "dim", "value")))
    shard = F.expr(f"dim div {p.width}").cast("int")
    return rows.groupBy(shard.alias("shard")).agg(F.transform(order, lambda r: r["value"]).alias("slice"))


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(chunk, shard, components, slice of the centroids) of block rows."""
    slices = b.column("slice")
    for i in range(b.num_rows):
        n = b.column("n")[i].as_py()
        x = np.frombuffer(b.column("data")[i].as_buffer(), np.int32).reshape(n, -1).astype(np.int64)
        c = slices[i].values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, x.shape[1])
        yield b.column("chunk")[i].as_py(), b.column("shard")[i].as_py(), x, c


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact partial distances of a column block, in the narrowest unsigned
    integers that hold them."""
    for b in batches:
        chunk, size, data = [], [], []
        for number, _, x, c in _matrices(b):
            d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
            d = d.astype(np.min_scalar_type(int(d.max(initial=0))))
            chunk.append(number)
            size.append(d.itemsize)
            data.append(d.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), b.column("n"), pa.array(size, pa.int32()), pa.array(data, pa.binary())], ["chunk", "n", "size", "data"])


def _nearest(parts: pa.Table) -> pa.Table:
    """Adds a chunk's partial distances and takes the smallest sum."""
    n = parts.column("n")[0].as_py()
    total = 0
    for size, data in zip(parts.column("size"), parts.column("data")):
        total = total + np.frombuffer(data.as_buffer(), f"u{size.as_py()}").astype(np.int64)
    total = total.reshape(n, -1)
    label = total.argmin(1)  # the first of equal ones
    near = total[np.arange(n), label]
    columns = [parts.column("chunk")[:1].combine_chunks(), pa.array([label.astype(np.int32).tobytes()], pa.binary()), pa.array([near.tobytes()], pa.binary())]
    return pa.Table.from_arrays(columns, ["chunk", "labels", "near"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard, cluster and dimension: the sum and count over a task's
    chunks, and the old component."""
    total: dict[int, np.ndarray] = {}
    count: dict[int, np.ndarray] = {}
    old: dict[int, np.ndarray] = {}
    for b in batches:
        for i, (_, s, x, c) in enumerate(_matrices(b)):
            label = np.frombuffer(b.column("labels")[i].as_buffer(), np.int32)
            if s not in old:
                old[s], total[s], count[s] = c, np.zeros_like(c), np.zeros(len(c), np.int64)
            for j in np.unique(label):
                total[s][j] += x[label == j].sum(0)
            count[s] += np.bincount(label, minlength=len(c))
    for s, c in old.items():
        k, w = c.shape
        columns = [np.full(k * w, s, np.int32), np.repeat(np.arange(k), w), np.tile(np.arange(w), k), total[s].ravel(), np.repeat(count[s], w), c.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["shard", "cluster", "dim", "total", "n", "old"])


def _assign(blocks: DataFrame, slices: DataFrame) -> DataFrame:
    """(chunk, labels, near) for the given slices."""
    at = blocks.select("chunk", "shard", "n", "data").join(F.broadcast(slices), "shard")
    parts = at.mapInArrow(_partial, "chunk long, n int, size int, data binary")
    return parts.groupBy("chunk").applyInArrow(_nearest, "chunk long, labels binary, near binary")


def _update(blocks: DataFrame, slices: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """The slices after one round."""
    sent = labels.select("chunk", "labels", F.explode(F.sequence(F.lit(0), F.lit(p.shards - 1))).alias("shard"))
    # the labels are dealt like the buckets; the blocks stay where they are
    at = blocks.select("chunk", "shard", "n", "data").join(sent.hint("shuffle_hash"), ["shard", "chunk"]).join(F.broadcast(slices), "shard")
    sums = at.mapInArrow(_sums, "shard int, cluster long, dim long, total long, n long, old long")
    new = sums.groupBy("shard", "cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.first("old").alias("old"))
    value = F.expr("if(n > 0, (total - pmod(total, n)) div n, old)")
    order = F.sort_array(F.collect_list(F.struct("cluster", "dim", value.alias("value"))))
    return new.groupBy("shard").agg(F.transform(order, lambda r: r["value"]).alias("slice"))


def _rows(id_type: pa.DataType, id_col: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].values.cast(id_type)
                label = pa.array(np.frombuffer(b.column("labels")[i].as_buffer(), np.int32))
                near = pa.array(np.frombuffer(b.column("near")[i].as_buffer(), np.int64))
                yield pa.RecordBatch.from_arrays([ids, label, near], [id_col, "cluster", "distance"])

    return fn


def centroids(slices: DataFrame, p: Params) -> DataFrame:
    """(cluster, centroid): the slices of a cluster put together again; k rows."""
    at = slices.select("shard", "slice", F.least(F.lit(p.width), p.dims - F.col("shard") * p.width).alias("w"))
    cells = at.select("shard", "w", F.posexplode("slice").alias("at", "value")).select(F.expr("cast(at div w as int)").alias("cluster"), "shard", "at", "value")
    order = F.sort_array(F.collect_list(F.struct("shard", "at", "value")))
    return cells.groupBy("cluster").agg(F.transform(order, lambda r: r["value"]).alias("centroid"))


def cluster(vectors: DataFrame, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Two tables: the id, ``cluster`` and ``distance`` of every kept vector,
    and the final centroids (``cluster``, ``centroid``)."""
    spark = vectors.sparkSession
    prepare(spark)
    kept = vectors.select(id_col, vec_col).filter(whole(F.col(vec_col), p))
    slices = saved(_first_slices(kept, p, id_col, vec_col), "slices")
    blocks = _Blocks(kept, p, id_col, vec_col)
    try:
        for _ in range(0 if is_empty(slices) else p.rounds):
            slices = saved(_update(blocks.table(), slices, _assign(blocks.table(), slices), p), "slices")
        ids = blocks.table().filter("shard = 0").select("chunk", "ids")
        id_type = vectors.schema[id_col].dataType
        schema = T.StructType([T.StructField(id_col, id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        found = saved(ids.join(_assign(blocks.table(), slices), "chunk").mapInArrow(_rows(to_arrow_type(id_type), id_col), schema), "clusters")
    finally:
        blocks.drop()
    return found, saved(centroids(slices, p), "centroids")


def report(found: DataFrame, centres: DataFrame) -> DataFrame:
    """Every row of ``found`` with the inertias and its centroid's digest."""
    each = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = found.agg(F.try_sum("distance").alias("inertia"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    small = centres.select("cluster", digest.alias("centroid_sha256")).join(each, "cluster").join(F.broadcast(total))  # k rows
    return found.join(F.broadcast(small), "cluster").select(*[c for c in found.columns if c not in ("cluster", "distance")], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
