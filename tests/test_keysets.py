"""Bitmaps of keys against the anti join."""

import random

from pyspark.sql import functions as F

from textctl.operators import inference as INF
from textctl.operators import keysets
from textctl.schemas import ASPECTS

MODELS = [(0, "org/a"), (1, "org/b"), (2, "org/none")]


def tables(spark, n=300, kind="long"):
    rnd = random.Random(1)
    name = (lambda i: i) if kind == "long" else (lambda i: f"id {i:05}")
    prompts = [("s" if i % 3 else "t", name(i)) for i in range(n)] + [("s", None), (None, name(1)), ("s", name(1))]
    results = [(t, m.replace("/", "-"), p, a, i) for t, p in prompts if p is not None and t for _, m in MODELS[:2] for a in ASPECTS for i in range(2) if rnd.random() < 0.9]
    results += results[:50] + [("s", "org-a", name(10**6), ASPECTS[0], 0), ("s", "org-a", None, ASPECTS[0], 0), ("u", "org-a", name(3), ASPECTS[0], 1)]
    master = spark.createDataFrame(prompts, f"task string, prompt_id {kind}")
    return master, spark.createDataFrame(results, f"task string, model string, prompt_id {kind}, aspect string, iter int")


def anti(master, results):
    keys = master.where("task IS NOT NULL AND prompt_id IS NOT NULL").distinct()
    return INF.pending(INF.request_keys(keys, MODELS, 2, ASPECTS), results)


def test_pending_equals_the_anti_join(spark):
    for kind in ("long", "string"):
        master, results = tables(spark, kind=kind)
        want = sorted(map(tuple, anti(master, results).select(*keysets.SET, "prompt_id").collect()))
        got = sorted(map(tuple, keysets.pending(master, MODELS, results, 2, ASPECTS).select(*keysets.SET, "prompt_id").collect()))
        assert got == want and len(want) > 2400


def test_several_buckets(spark):
    """More prompts than one bitmap holds; gaps at its edges."""
    n = 3 * keysets.BITS + 17
    master = spark.range(n).selectExpr("'s' AS task", "id AS prompt_id")
    out = [0, 1, 31, 32, keysets.BITS - 1, keysets.BITS, keysets.BITS + 7, 2 * keysets.BITS, n - 1]
    full = spark.range(n).selectExpr("'s' AS task", "'org-a' AS model", "id AS prompt_id", f"'{ASPECTS[0]}' AS aspect", "0 AS iter")
    left = keysets.pending(master, MODELS[:1], full.where(~F.col("prompt_id").isin(out)), 1, ASPECTS[:1])
    assert sorted(r.prompt_id for r in left.collect()) == out
    assert keysets.pending(master, MODELS[:1], full, 1, ASPECTS[:1]).count() == 0
    assert keysets.pending(master, MODELS[:1], full.limit(0), 1, ASPECTS[:1]).count() == n


def test_bitmaps_of_runs_merge(spark):
    master, results = tables(spark)
    numbers = keysets.numbered(master)
    parts = [keysets.held(results.where(F.col("iter") == i), numbers) for i in range(2)] + [keysets.held(results.limit(40), numbers)]
    whole = {tuple(r) for r in keysets.held(results, numbers).select(*keysets.SET, "bucket", F.hex("bits")).collect()}
    assert {tuple(r) for r in keysets.merged(parts[0].unionByName(parts[1]).unionByName(parts[2])).select(*keysets.SET, "bucket", F.hex("bits")).collect()} == whole


def test_fill(spark):
    master, results = tables(spark)
    keys = {(r.task, r.prompt_id) for r in master.collect() if r.task and r.prompt_id is not None}
    there = {tuple(r) for r in results.collect()}
    rows = keysets.fill(master, MODELS, results, 2, ASPECTS).collect()
    assert len(rows) == 2 * 3 * 4 * 2
    for r in rows:
        own = [p for t, p in keys if t == r.task]
        assert (r.n_prompts, r.n_held) == (len(own), sum((r.task, r.model, p, r.aspect, r.iter) in there for p in own))


def test_no_request_key_is_shuffled(spark):
    """Answers are counted into bitmaps before anything moves."""
    master, results = tables(spark)
    numbers = keysets.numbered(master).checkpoint()
    plan = keysets.held(results, numbers)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_bitmap_construct_agg" in plan, plan
