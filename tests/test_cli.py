"""The command line runs the five stages like the benchmark's runner."""

import glob

import pytest

from textctl import __main__ as cli
from textctl.operators.leaderboard import BOARD_COLUMNS

from test_jobs import _master_files


def test_all_stages_from_the_command_line(spark, tmp_out, monkeypatch):
    monkeypatch.setenv("MODEL_PATH_0", "elyza/ELYZA-japanese-Llama-2-7b-fast-instruct")
    monkeypatch.setenv("MODEL_PATH_1", "rinna/youri-7b-chat")
    master = _master_files(spark, tmp_out)
    out = f"{tmp_out}/output"
    cli.main(
        [
            "all",
            "--master", master,
            "--output_path", out,
            "--factory", "textctl.operators.inference:echo_factory",
            "--judge", "textctl.plans.queries:length_judge_factory",
        ]
    )
    for task in ("summary", "ad_text", "pros_and_cons"):
        lines = open(glob.glob(f"{out}/leaderboard/task={task}/*.csv")[0]).read().splitlines()
        assert lines[0] == "model," + ",".join(BOARD_COLUMNS)
        # registry order
        assert [x.split(",")[0] for x in lines[1:]] == ["elyza-ELYZA-japanese-Llama-2-7b-fast-instruct", "rinna-youri-7b-chat"]


def test_command_line_checks_its_arguments():
    with pytest.raises(SystemExit):
        cli.main(["generate"])  # no model factory
    with pytest.raises(ValueError):
        cli.load("no_function_here")


def test_task_option_reads_the_benchmark_layout(spark, tmp_out, monkeypatch):
    """--task narrows the prompt files read: {master_path}/{task}/{master_file}."""
    from pyspark.sql import functions as F

    from textctl.sources import files
    from textctl.sources import fixtures as fx

    monkeypatch.setenv("MODEL_PATH_0", "elyza/ELYZA-japanese-Llama-2-7b-fast-instruct")
    m = fx.prompts(spark, "/root/testdata/sf0.001", with_prompts=True)
    cols = [f.name for f in files.MASTER.fields]
    for task in ("summary", "ad_text", "pros_and_cons"):
        m.where(F.col("task") == task).select(*cols).write.option("ignoreNullFields", "false").json(f"{tmp_out}/datasets/{task}")
    out = f"{tmp_out}/output"
    cli.main(
        [
            "generate",
            "--master_path", f"{tmp_out}/datasets",
            "--master_file", "*.json",
            "--task", "summary",
            "--task", "ad_text",
            "--output_path", out,
            "--factory", "textctl.operators.inference:echo_factory",
        ]
    )
    tasks = {r["task"] for r in spark.read.parquet(f"{out}/generated").select("task").distinct().collect()}
    assert tasks == {"summary", "ad_text"}
