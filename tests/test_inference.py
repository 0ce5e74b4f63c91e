"""Retry / dead letters, restart without repeated requests, cleaning dedupe."""

from pyspark.sql import functions as F

from textctl.operators import clean as CL
from textctl.operators import inference as INF
from textctl.plans import queries as Q
from textctl.sources import fixtures as fx

from conftest import SF0001

KEYS = ["task", "model", "prompt_id", "aspect", "iter"]


def test_dead_letters_and_retries(spark):
    req = Q._chat_requests(spark, SF0001)
    done = INF.run_model(req, INF.flaky_factory, policy=INF.NO_WAIT, keys=KEYS)
    rows = done.join(req.select(*KEYS, F.length("prompt").alias("n")), KEYS).collect()
    assert len(rows) == req.count()
    for r in rows:
        if r["n"] % 11 == 0:
            assert r["text"] is None and r["error"] == "RetryableError: overloaded" and r["attempts"] == 3
        else:
            assert r["error"] is None and r["text"] == f"ok:{r['n']}"


def test_restart_runs_only_pending(spark, tmp_out):
    req = Q._chat_requests(spark, SF0001)
    calls = spark.sparkContext.accumulator(0)

    def counting_factory(model_path):
        m = INF.EchoModel()

        def call(prompts):
            calls.add(len(prompts))
            return m(prompts)

        return call

    first = INF.run_model(req.where(F.col("iter") < 2), counting_factory, keys=KEYS)
    first.write.mode("overwrite").parquet(f"{tmp_out}/done")
    n_first = calls.value
    todo = INF.pending(req, spark.read.parquet(f"{tmp_out}/done"))
    second = INF.run_model(todo, counting_factory, keys=KEYS)
    second.write.mode("append").parquet(f"{tmp_out}/done")
    assert calls.value - n_first == req.where(F.col("iter") == 2).count()
    allr = spark.read.parquet(f"{tmp_out}/done")
    assert allr.count() == req.count() and allr.select(*KEYS).distinct().count() == req.count()


def test_model_clean_equals_rule_clean_and_dedupes(spark):
    r = fx.results(spark, SF0001).select(*KEYS, "raw_text")
    calls = spark.sparkContext.accumulator(0)

    def factory(model_path):
        m = CL.RuleCleanerModel()

        def call(prompts):
            calls.add(len(prompts))
            return m(prompts)

        return call

    by_model = CL.model_clean(r, factory)
    by_rule = CL.clean_rules(r)
    a = by_model.select(*KEYS, "clean_text")
    b = by_rule.select(*KEYS, "clean_text")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert calls.value == r.select("task", "raw_text").distinct().count() < r.count()


def test_errors_as_sentinel(spark):
    req = Q._chat_requests(spark, SF0001)
    done = INF.errors_as_text(INF.run_model(req, INF.flaky_factory, policy=INF.NO_WAIT, keys=KEYS), sentinel="Invalid Error")
    assert done.where(F.col("error").isNotNull() & (F.col("text") != "Invalid Error")).count() == 0


def test_as_many_tasks_as_asked_for_call_the_model(spark):
    """One model's requests spread over all partitions."""
    req = spark.range(20_000).select(F.col("id").alias("k"), F.lit("m").alias("model_path"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))
    done = INF.run_model(req, INF.echo_factory, keys=["k"], partitions=1000, checkpoint=False)
    assert done.select(F.spark_partition_id().alias("p")).distinct().count() > 950


def test_only_failed_prompts_are_asked_again():
    """C4: errors per prompt cost their own retries; a call that raises is
    asked again prompt by prompt, within its sub-batch."""
    asked = []

    def per_prompt(prompts):
        asked.extend(prompts)
        return [INF.RetryableError("busy") if p == "p99" and asked.count(p) < 3 else ValueError("no") if p == "p7" else "ok:" + p for p in prompts]

    policy = INF.RetryPolicy(max_attempts=5, backoff_s=0)
    texts, errors, attempts = INF._answer(per_prompt, [f"p{i}" for i in range(100)], policy)
    assert len(asked) == 102 and texts[99] == "ok:p99" and attempts[99] == 3 and attempts[0] == 1
    assert texts[7] is None and errors[7] == "ValueError: no" and attempts[7] == 1
    asked.clear()

    def raising(prompts):
        asked.extend(prompts)
        if "p3" in prompts:
            raise ValueError("bad prompt")
        return prompts

    texts, errors, attempts = INF._answer(raising, [f"p{i}" for i in range(8)], policy)
    assert len(asked) == 16 and errors == [None] * 3 + ["ValueError: bad prompt"] + [None] * 4


def test_requests_reach_the_model(spark):
    """System message, messages and parameters come with the prompt."""
    from textctl.operators import chat as CH

    class Seen:
        takes_requests = True

        def __call__(self, requests):
            return [f"{r['system']}|{len(r['messages']) if r['messages'] is not None else 0}|{r['params'] is not None}" for r in requests]

    models = [("gpt-4", "openai"), ("cyberagent/calm2-7b-chat", "calm2")]
    rows = [(i, path, "text") for i, (path, _) in enumerate(models)]
    req = CH.render_requests(spark.createDataFrame(rows, "k int, model_path string, prompt string"))
    req = req.select("k", "model_path", F.col("chat_prompt").alias("prompt"), "system", "messages", "params", "family")
    known = {r["k"]: r["family"] for r in req.collect()}
    done = INF.run_model(req, lambda path: Seen(), keys=["k"], request_cols=["system", "messages", "params"])
    for r in done.collect():
        system, messages, params = r["text"].split("|")
        if known[r["k"]] in CH.CHAT_SYSTEM:
            assert system != "None" and messages == "2"
        elif known[r["k"]] in CH.GEN_PARAMS:
            assert messages == "0" and params == "True"


def test_arrow_batches_are_cut_by_bytes(spark):
    """Model calls get Arrow batches bounded in bytes (long prompts), not
    only in rows (``spark.sql.execution.arrow.maxBytesPerBatch``)."""
    import pandas as pd

    req = Q._chat_requests(spark, SF0001).select("prompt")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(256 * 1024))
    try:
        batches = req.mapInPandas(
            lambda it: (pd.DataFrame({"n": [len(b)], "chars": [int(b["prompt"].str.len().sum())]}) for b in it), "n long, chars long"
        ).collect()
    finally:
        spark.conf.set(key, before)
    assert sum(b["n"] for b in batches) == req.count()
    assert max(b["chars"] for b in batches) < 2 * 256 * 1024  # a batch closes once it passes the limit
    assert max(b["n"] for b in batches) < 10000


def test_pending_requests_on_keys_equal_full_fan_out(spark):
    """C8 restart: the pending requests found on keys, with their prompt
    joined afterwards, are the rows the full fan-out would leave."""
    master = fx.prompts(spark, SF0001, with_prompts=True)
    models = fx.generated_models()
    full = INF.generation_requests(master, models)
    finished = full.where((F.col("prompt_id") % 3 == 0) | ((F.col("prompt_id") % 3 == 1) & (F.col("iter") < 2))).select(*KEYS)
    want = INF.pending(full, finished)
    got = INF.pending_requests(master, models, finished)
    assert sorted(got.columns) == sorted(want.columns)  # a join puts its keys first
    want = want.select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.count() == full.count() - finished.count()


def test_prompts_of_loaded_models_are_not_sorted(spark):
    """With no more models than stay loaded no prompt is kept to be
    sorted; every model still gets its own requests, built once a worker."""
    rows = [(i, f"m{i % 3}", f"p{i}") for i in range(500)]
    req = spark.createDataFrame(rows, "k int, model_path string, prompt string").repartition(4)
    factory = lambda path: lambda prompts: [f"{path}:{p}" for p in prompts]
    for models in (None, 3, 9):
        done = INF.run_model(req, factory, keys=["k"], checkpoint=False, models=models)
        assert ("Sort [" in done._jdf.queryExecution().executedPlan().toString()) == (models != 3)
        assert {(r.k, r.text) for r in done.collect()} == {(k, f"{m}:{p}") for k, m, p in rows}


def test_prompts_rendered_after_the_join_equal_those_before(spark):
    """A master without rendered prompts gives the same requests."""
    models = fx.generated_models()
    keys = INF.request_keys(fx.prompts(spark, SF0001), models).where("prompt_id % 3 < 2")
    a = INF.with_prompt(keys, fx.prompts(spark, SF0001, with_prompts=True), models)
    b = INF.with_prompt(keys, fx.prompts(spark, SF0001), models)
    assert a.count() == keys.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
