"""The five stages as jobs over folders, end to end with stand-in models."""

import glob

from pyspark.sql import functions as F

from textctl import sinks
from textctl.operators import clean as CL
from textctl.operators import inference as INF
from textctl.operators import leaderboard as LB
from textctl.operators import scores as S
from textctl.operators import validity as V
from textctl.plans import jobs
from textctl.plans import queries as Q
from textctl.sources import files
from textctl.sources import fixtures as fx

from conftest import SF0001

MODELS = [(0, "elyza/ELYZA-japanese-Llama-2-7b-fast-instruct"), (1, "rinna/youri-7b-chat"), (2, "org/unlisted-model")]


def _master_files(spark, tmp):
    m = fx.prompts(spark, SF0001, with_prompts=True)
    cols = [f.name for f in files.MASTER.fields]
    sinks.write_jsonl(m.select("task", *cols), f"{tmp}/datasets", partition_by=("task",))
    return f"{tmp}/datasets/*/*.json"


def test_five_stages(spark, tmp_out):
    master_glob = _master_files(spark, tmp_out)
    out = f"{tmp_out}/output"
    gen = jobs.generate(spark, master_glob, out, INF.echo_factory, models=MODELS)
    n_prompts = fx.prompts(spark, SF0001, text=False).count()
    assert gen.count() == n_prompts * 4 * 3 * 2  # the unlisted model is reported, not run
    assert spark.read.parquet(f"{out}/unsupported_models").first()["model_path"] == "org/unlisted-model"
    exported = files.read_results(spark, f"{out}/generated_jsonl/*/*/*.json")
    assert exported.count() == n_prompts * 2 and exported.where(F.col("generated_text_id").isNull()).count() == 0
    # resume: nothing left to run
    again = jobs.generate(spark, master_glob, out, INF.echo_factory, models=MODELS, resume=True)
    assert again.count() == gen.count()

    cl = jobs.clean(spark, out, factory=CL.rule_cleaner_factory, policy=INF.NO_WAIT)
    rule = CL.clean_rules(gen.select(*jobs.KEYS, "raw_text"))
    assert cl.select(*jobs.KEYS, "clean_text").exceptAll(rule.select(*jobs.KEYS, "clean_text")).count() == 0

    sc = jobs.score_control(spark, master_glob, out)
    master = files.read_master(spark, master_glob)
    want = S.ctg_scores(V.with_validity(cl, master))
    assert sc.exceptAll(want).count() == 0 and want.exceptAll(sc).count() == 0
    assert glob.glob(f"{out}/analysis/tsv/task=*/model=*/iter=*/part-*")

    qs = jobs.score_quality(spark, master_glob, out, Q.length_judge_factory, policy=INF.NO_WAIT)
    assert qs.count() == 3 * 2 * 4 * 3

    board = jobs.leaderboard(spark, out)
    assert board.count() == 3 * 2
    lines = open(glob.glob(f"{out}/leaderboard/task=summary/*.csv")[0]).read().splitlines()
    assert lines[0] == "model," + ",".join(LB.BOARD_COLUMNS) and len(lines) == 3


def _counting(folder, fail=False, judge=False):
    """A model that echoes (or judges), counts its prompts in files of the
    folder, and fails for some prompts."""
    import os

    os.makedirs(folder, exist_ok=True)

    def model(prompts):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("x" * len(prompts))
        if judge:
            return ["適切" if len(p) % 2 else "不適切" for p in prompts]
        return [ValueError("no answer") if fail and len(p) % 5 == 0 else "answer " + p for p in prompts]

    return lambda path: model


def _calls(folder):
    import os

    return sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder))


ONE = [MODELS[0]]


def _small(spark, tmp, n=6):
    """A master per task with string ids, and one line that does not parse."""
    m = fx.prompts(spark, SF0001, with_prompts=True).where(F.col("prompt_id") < n)
    cols = [F.concat(F.lit("id-"), F.col("prompt_id")).alias("prompt_id"), *[f.name for f in files.MASTER.fields[1:]]]
    for task in ("summary", "ad_text"):
        m.where(F.col("task") == task).select(*cols).coalesce(1).write.option("ignoreNullFields", "false").json(f"{tmp}/in/{task}")
        with open(f"{tmp}/in/{task}/more.json", "w") as f:
            f.write('{"prompt_id": broken\n')
    return f"{tmp}/in"


def test_tasks_one_after_the_other_on_a_uri(spark, tmp_out):
    """A second task leaves the first alone; a restart on a
    path with a scheme asks and adds nothing; string ids score fully; the
    broken line is kept aside."""
    import pytest

    root, out = _small(spark, tmp_out), f"file://{tmp_out}/out"
    count = f"{tmp_out}/calls"
    for task in ("summary", "ad_text"):
        master = f"{root}/{task}/*.json"
        jobs.generate(spark, master, out, _counting(count), models=ONE)
        assert spark.read.text(f"{out}/quarantine").count() == 1
        jobs.clean(spark, out, factory=_counting(count + "-clean"), tasks=[task], models=ONE)
        jobs.score_control(spark, master, out, tasks=[task], models=ONE)
        jobs.score_quality(spark, master, out, _counting(count + "-judge", judge=True), tasks=[task], models=ONE)
    with pytest.raises(RuntimeError):
        jobs.score_control(spark, master, out, strict=True)
    for name in ("generated", "cleaned", "valid", "judged"):
        got = spark.read.parquet(f"{out}/{name}").groupBy("task").count()
        assert {r["task"]: r["count"] for r in got.collect()} == {"summary": 24, "ad_text": 24}
    assert spark.read.parquet(f"{out}/ctg_scores").select("task").distinct().count() == 2
    assert len(glob.glob(f"{tmp_out}/out/reports/*/task=*")) == 4
    board = jobs.leaderboard(spark, out, models=ONE)
    assert {r["task"] for r in board.collect()} == {"summary", "ad_text"}
    asked = [_calls(count + x) for x in ("", "-clean", "-judge")]
    for task in ("summary", "ad_text"):
        master = f"{root}/{task}/*.json"
        jobs.generate(spark, master, out, _counting(count), models=ONE, resume=True)
        jobs.clean(spark, out, factory=_counting(count + "-clean"), tasks=[task], models=ONE, resume=True)
        jobs.score_quality(spark, master, out, _counting(count + "-judge", judge=True), tasks=[task], models=ONE, resume=True)
    assert asked == [_calls(count + x) for x in ("", "-clean", "-judge")]
    assert spark.read.parquet(f"{out}/generated").count() == 48


def test_failed_requests_are_retried_and_replaced(spark, tmp_out):
    """A failed request keeps its error as text until a later
    run succeeds; keys stay unique."""
    master, out = f"{_small(spark, tmp_out)}/summary/*.json", f"{tmp_out}/out"
    first = jobs.generate(spark, master, out, _counting(f"{tmp_out}/a", fail=True), models=ONE, policy=INF.NO_WAIT)
    failed = first.where(F.col("error").isNotNull())
    n = failed.count()
    assert 0 < n < 24 and failed.where(F.col("raw_text") != "ValueError: no answer").count() == 0
    jobs.clean(spark, out)
    assert jobs.score_control(spark, master, out).agg(F.sum("n")).first()[0] == 24
    assert spark.read.parquet(f"{out}/valid").where(F.col("is_valid").isNull() & (F.col("aspect") != "format")).count() == 0
    again = jobs.generate(spark, master, out, _counting(f"{tmp_out}/b"), models=ONE, resume=True)
    assert _calls(f"{tmp_out}/b") == n and again.where(F.col("error").isNotNull()).count() == 0
    assert again.count() == again.select(*jobs.KEYS).distinct().count() == 24


def test_any_number_of_iterations(spark, tmp_out):
    """Reports and board follow the iteration count."""
    root = _small(spark, tmp_out)
    for iters in (1, 5):
        out = f"{tmp_out}/out{iters}"
        jobs.generate(spark, f"{root}/*/*.json", out, INF.echo_factory, models=ONE, iters=iters)
        jobs.clean(spark, out)
        jobs.score_control(spark, f"{root}/*/*.json", out)
        jobs.score_quality(spark, f"{root}/*/*.json", out, Q.length_judge_factory, models=ONE, iters=iters)
        board = jobs.leaderboard(spark, out, models=ONE, iters=iters).collect()
        assert len(board) == 2 and all(x is not None for r in board for x in r)
        lines = open(glob.glob(f"{out}/reports/quality/task=summary/*/*.txt")[0]).read().splitlines()
        assert sum("-Acc" in x and x.startswith("iter") for x in lines) == 4 * iters and sum(x.startswith("All-Acc: ") for x in lines) == 4
