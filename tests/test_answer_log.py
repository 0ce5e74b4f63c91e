"""What a stage paid for survives the stage."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textctl.operators import answer_log as LOG
from textctl.operators import inference as INF
from textctl.plans import jobs

from test_jobs import ONE, _small


def paid(folder):
    return Counter(x.strip() for f in os.listdir(folder) for x in open(f"{folder}/{f}")) if os.path.isdir(folder) else Counter()


def recorder(folder, most=None, kill=False):
    """A model that writes every prompt it is paid for to a file of its own
    worker. With ``most``, the first call after that many prompts, over all
    workers, ends its worker (``kill``) or stops."""

    def factory(model_path):
        import hashlib
        import os

        os.makedirs(folder, exist_ok=True)

        def model(prompts):
            if most is not None and sum(len(open(f"{folder}/{f}", "rb").readlines()) for f in os.listdir(folder)) >= most:
                if kill:
                    os._exit(3)
                raise INF.StopCalls("quota")
            hashes = [hashlib.sha256(p.encode()).hexdigest() for p in prompts]
            with open(f"{folder}/{os.getpid()}", "a") as f:
                f.writelines(f"{h}\n" for h in hashes)
            return [f"answer to {h}" for h in hashes]

        return model

    return factory


def stored(spark, path):
    """How often each answer is in the log, by the hash of its prompt (the
    iterations of a prompt are the same text)."""
    return Counter(r.raw_text.split()[-1] for r in spark.read.parquet(path).collect()) if os.path.isdir(path) else Counter()


ONE_BY_ONE = INF.RetryPolicy(max_attempts=1, backoff_s=0.0, batch=1)


def test_killed_stage_keeps_the_answers_of_ended_tasks(spark, tmp_out):
    master, out = f"{_small(spark, tmp_out)}/summary/*.json", f"{tmp_out}/out"
    jobs.generate(spark, master, f"{out}-all", recorder(f"{tmp_out}/all"), models=ONE, policy=ONE_BY_ONE)
    every = paid(f"{tmp_out}/all")
    assert every.total() == 24
    with pytest.raises(Exception):
        jobs.generate(spark, master, out, recorder(f"{tmp_out}/a", most=14, kill=True), models=ONE, policy=ONE_BY_ONE, commit_every=2)
    first, kept = paid(f"{tmp_out}/a"), stored(spark, f"{out}/generated")
    assert 0 < kept.total() <= first.total() < 24 and kept <= first
    left = jobs.unanswered(spark, master, out, models=ONE)
    assert left.agg(F.sum(F.col("n_prompts") - F.col("n_held"))).first()[0] == 24 - kept.total()
    again = jobs.generate(spark, master, out, recorder(f"{tmp_out}/b"), models=ONE, policy=ONE_BY_ONE, resume=True, commit_every=5)
    # asked again is exactly what was not in the log
    assert kept + paid(f"{tmp_out}/b") == every == stored(spark, f"{out}/generated")
    assert again.count() == again.select(*jobs.KEYS).distinct().count() == 24
    assert jobs.unanswered(spark, master, out, models=ONE).count() == 0


def test_stopped_callable_loses_nothing(spark, tmp_out):
    """Every answer is paid once, in all three stages that call a model."""
    master, out = f"{_small(spark, tmp_out)}/*/*.json", f"{tmp_out}/out"
    stages = {
        "gen": lambda f, resume: jobs.generate(spark, master, out, f, models=ONE, policy=ONE_BY_ONE, resume=resume, commit_every=7),
        "clean": lambda f, resume: jobs.clean(spark, out, factory=f, policy=ONE_BY_ONE, resume=resume, commit_every=7),
        "judge": lambda f, resume: jobs.score_quality(spark, master, out, f, models=ONE, policy=ONE_BY_ONE, resume=resume, commit_every=7),
    }
    for name, stage in stages.items():
        a, b, c = (f"{tmp_out}/{name}-{x}" for x in "abc")
        stage(recorder(a, most=5), False)
        if name == "clean":
            rows = spark.read.parquet(f"{out}/cleaned")
            assert rows.where("clean_error = 'no answer'").count() > 0 and rows.where("clean_text IS NULL").count() == 0
        stage(recorder(b), True)
        first, second = paid(a), paid(b)
        stage(recorder(c), True)
        assert 5 <= first.total() < second.total() + 13 and not paid(c), name
        if name == "gen":  # three iterations of every prompt
            assert (first + second).total() == 48 and stored(spark, f"{out}/generated") == first + second
        if name == "clean":  # one call per distinct text
            assert set((first + second).values()) == {1}
        if name == "judge":  # both questions, as no verdict parses
            assert (first + second).total() == 96
    assert spark.read.parquet(f"{out}/cleaned").where("clean_error IS NOT NULL").count() == 0


def test_a_new_run_hides_older_answers_but_keeps_them(spark, tmp_out):
    master, out = f"{_small(spark, tmp_out)}/*/*.json", f"{tmp_out}/out"
    other = [(1, "rinna/bilingual-gpt-neox-4b-instruction-sft")]
    jobs.generate(spark, master, out, recorder(f"{tmp_out}/a"), models=ONE)
    jobs.generate(spark, master, out, recorder(f"{tmp_out}/b"), models=other)
    fresh = jobs.generate(spark, master, out, INF.length_factory, models=ONE)
    kinds = {(r.model_path, r.raw_text.split()[0].split(":")[0]) for r in fresh.collect()}
    assert kinds == {(ONE[0][1], "ok"), (other[0][1], "answer")} and fresh.count() == 96
    assert spark.read.parquet(f"{out}/generated").count() == 144  # what was paid for is still there


def test_newest_answer_of_a_key(spark, tmp_out):
    path, schema = f"{tmp_out}/log", "_k string, text string, error string"
    for rows in ([("a", "1", None), ("b", None, "e1"), ("c", None, "e1")], [("a", "2", None), ("b", "ok", None), ("c", None, "e2")], [("a", None, "e3"), ("b", None, "e3")]):
        LOG.append(spark.createDataFrame(rows, schema), path, LOG.new_run())
    got = {r["_k"]: (r.text, r.error) for r in LOG.newest(spark, path, "_k").collect()}
    assert got == {"a": ("2", None), "b": ("ok", None), "c": (None, "e2")}


def test_stop_inside_a_batch_keeps_what_was_settled(spark):
    def half(prompts):
        if "p5" in prompts:
            raise INF.StopCalls("enough")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, "m", f"p{i}") for i in range(9)], "k long, model_path string, prompt string").coalesce(1)
    policy = INF.RetryPolicy(batch=2, backoff_s=0.0)
    out = INF.run_model(df, lambda m: half, policy=policy, keys=["k"], checkpoint=False).collect()
    assert sorted((r.k, r.text, r.attempts) for r in out) == [(i, f"P{i}", 1) for i in range(4)]
