import hashlib
import math
import random

import pytest

from textctl.llm.sharded_lloyd import LIMIT, Params, cluster, report

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, p):
    import numpy as np

    kept = []
    for i, v in rows:
        if v is None or len(v) != p.dims or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        kept.append((i, [math.floor(max(min(p.scale * x, LIMIT), -LIMIT)) for x in v]))
    first = sorted((hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centres = [x for _, x in first[: p.k]]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    assign = lambda: [min((far(x, c), j) for j, c in enumerate(centres)) for _, x in kept]
    for _ in range(p.rounds):
        found = assign()
        for j in range(len(centres)):
            own = [x for (_, x), (_, c) in zip(kept, found) if c == j]
            if own:
                centres[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((i is None, i or 0), c, d) for (i, _), (d, c) in zip(kept, assign())), centres


def run(spark, rows, p, parts=3):
    found, centres = cluster(spark.createDataFrame(rows, SCHEMA).repartition(parts), p)
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in found.collect())
    return got, [r.centroid for r in sorted(centres.collect())], found, centres


@pytest.mark.parametrize("p", [Params(k=4, rounds=3, dims=5, width=2, rows=7), Params(k=3, rounds=0, dims=5, width=8), Params(k=6, rounds=1, dims=5, width=1, rows=1000)])
def test_equals_brute_force(spark, p):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) + 3 * (i % 3) for _ in range(p.dims)]) for i in range(90)]
    rows += [(i, [0.5] * p.dims) for i in range(100, 140)]  # a common vector
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, rows[9][1])]  # repeated rows and ids
    got, centres, found, cs = run(spark, rows, p)
    assert (got, centres) == brute(rows, p)
    again = run(spark, rows[::-1], p, parts=8)[:2]
    assert again == (got, centres)
    out = report(found, cs).collect()
    total = sum(d for _, _, d in got)
    assert len(out) == len(rows) and {r.inertia for r in out} == {total} and sum({r.cluster: r.cluster_inertia for r in out}.values()) == total
    digest = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centres)}
    assert all(r.centroid_sha256 == digest[r.cluster] for r in out)


def test_empty_clusters_stay_and_ties_take_the_smaller_number(spark):
    p = Params(k=3, rounds=2, dims=1, width=1)
    rows = [(i, [1.0]) for i in range(6)]  # three equal centroids: two stay empty
    got, centres, *_ = run(spark, rows, p)
    assert {c for _, c, _ in got} == {0} and centres == [[1024]] * 3


def test_odd_rows(spark):
    p = Params(k=8, rounds=2, dims=2, width=16)
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert report(*cluster(df, p)).collect() == []
    rows += [(None, [0.25, -0.001]), (8, [1e30, -1e30]), (8, [1e30, -1e30])]
    got, centres, found, cs = run(spark, rows, p)
    assert (got, centres) == brute(rows, p) and len(centres) == 3
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", "'x' AS cluster", "'x' AS shard", "'x' AS distance", "'x' AS chunk")
    assert sorted(report(*cluster(clash, p)).columns) == sorted(report(found, cs).columns)
    assert report(*cluster(spark.createDataFrame([], SCHEMA), p)).collect() == []


def test_string_ids(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "vec_id string, embedding array<double>")
    found, _ = cluster(df, Params(k=1, rounds=1, dims=2, width=1))
    assert {(r.vec_id, r.cluster) for r in found.collect()} == {("a", 0), ("b", 0)}


def test_blocks_stay_where_they_are(spark):
    """The labels are shuffled to the bucketed blocks, the blocks never."""
    from pyspark.sql import functions as F

    from textctl.llm import sharded_lloyd as L

    p = Params(k=2, dims=4, width=2)
    kept = spark.createDataFrame([(i, [float(i), 1.0, 0.0, 2.0]) for i in range(20)], SCHEMA)
    blocks = L._Blocks(kept, p, "vec_id", "embedding")
    try:
        slices = L._first_slices(kept, p, "vec_id", "embedding")
        labels = spark.createDataFrame([], "chunk long, labels binary")
        plan = L._update(blocks.table(), slices, labels, p)._jdf.queryExecution().sparkPlan().toString()
        full = L._update(blocks.table(), slices, labels, p)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Bucketed: true" in full
        join = full[full.index("ShuffledHashJoin") :]
        left = join[: join.index("Scan parquet")]
        assert "Exchange" not in left, left
    finally:
        blocks.drop()
    assert not [t for t in spark.catalog.listTables() if t.name == blocks.name] and F is not None
