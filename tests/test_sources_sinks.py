"""Sinks and readers round trip, reports -> leaderboard."""

import glob
import os

from pyspark.sql import functions as F

from textctl import sinks
from textctl.operators import judge as J
from textctl.operators import leaderboard as LB
from textctl.operators import reshape, scores
from textctl.plans import queries as Q
from textctl.sources import files
from textctl.sources import fixtures as fx

from conftest import SF0001


def test_master_jsonl_round_trip(spark, tmp_out):
    m = fx.prompts(spark, SF0001, with_prompts=True)
    cols = [f.name for f in files.MASTER.fields]
    sinks.write_jsonl(m.select("task", *cols), tmp_out, partition_by=("task",))
    back = files.read_master(spark, f"{tmp_out}/*/*.json")
    assert files.quarantine(back).count() == 0
    a = m.select("task", *cols)
    b = back.select("task", *cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_results_wide_jsonl_round_trip_in_benchmark_layout(spark, tmp_out):
    long = fx.results(spark, SF0001)
    w = reshape.to_wide(long).withColumn("generated_text_id", F.lit(0).cast("long")).withColumn("base_text", F.lit("b"))
    # benchmark layout: {root}/{task}/{model}/generated_result/<file>.jsonl
    for r in w.select("task", "model").distinct().collect():
        part = w.where((F.col("task") == r["task"]) & (F.col("model") == r["model"]))
        out = f"{tmp_out}/out/{r['task']}/{r['model']}/generated_result"
        part.drop("task", "model").withColumnRenamed("model_path", "model").coalesce(1).write.mode("overwrite").option(
            "ignoreNullFields", "false"
        ).json(out + "/_tmp")
        src = glob.glob(out + "/_tmp/*.json")[0]
        os.link(src, out + "/generated_result_v1_wo_hf.jsonl")
    back = files.read_results(spark, f"{tmp_out}/out/*/*/generated_result/*.jsonl", clean=True)
    assert back.count() == w.count()
    relong = reshape.to_long(back).withColumn("prompt_id", F.col("prompt_id").cast("long"))  # ids are read as text
    k = ["task", "model", "prompt_id", "aspect", "iter", "raw_text", "clean_text"]
    assert relong.select(*k).exceptAll(long.select(*k)).count() == 0


def test_corrupt_lines_are_quarantined(spark, tmp_out):
    p = os.path.join(tmp_out, "summary")
    os.makedirs(p)
    with open(os.path.join(p, "prompts_v1.jsonl"), "w") as f:
        f.write('{"prompt_id": 1, "base_text": "x", "keyword": 45}\n{not json\n')
    df = files.read_master(spark, f"{tmp_out}/*/prompts_v1.jsonl")
    rows = {r["prompt_id"]: r for r in df.collect()}
    assert rows["1"]["keyword"] == "45" and rows["1"]["task"] == "summary"  # numbers read as declared strings
    assert files.quarantine(df).count() == 1


def test_csv_text_round_trip(spark, tmp_out):
    texts = ["a\nb", "tab\there", 'q"uote', "back\\slash", " lead", "全角　空白", "x,y"]
    df = spark.createDataFrame([("t", "m", i, s) for i, s in enumerate(texts)], "task string, model string, i int, s string")
    sinks.write_csv(df, tmp_out)
    back = spark.read.options(**sinks.CSV_OPTIONS, multiLine="true").schema("i int, s string").csv(f"{tmp_out}/task=t/model=m")
    assert sorted((r["i"], r["s"]) for r in back.collect()) == list(enumerate(texts))


def test_reports_to_leaderboard_through_files(spark, tmp_out):
    d = SF0001
    sc = Q.scores(spark, d)
    sinks.write_lines(scores.ctg_report_lines(sc), f"{tmp_out}/ctg", partition_by=("task", "model", "iter"))
    sinks.write_lines(Q.quality_lines(spark, d), f"{tmp_out}/quality")
    c = files.read_ctg_reports(spark, f"{tmp_out}/ctg/*/*/*/*.txt")
    q = files.read_quality_reports(spark, f"{tmp_out}/quality/*/*/*.txt")
    assert LB.incomplete_scores(c, q).count() == 0
    from_files = LB.leaderboard(c, q)
    in_memory = Q.leaderboard(spark, d)
    assert from_files.exceptAll(in_memory).count() == 0 and in_memory.exceptAll(from_files).count() == 0
    sinks.write_leaderboard(from_files, f"{tmp_out}/board")
    head = open(glob.glob(f"{tmp_out}/board/task=ad_text/*.csv")[0]).readline().strip()
    assert head == "model," + ",".join(LB.BOARD_COLUMNS)


def test_quality_report_layout(spark):
    lines = Q.quality_lines(spark, SF0001)
    one = lines.where("task = 'ad_text' AND model = 'elyza-ELYZA-japanese-Llama-2-7b-fast-instruct'").orderBy("line_no").collect()
    text = [r["line"] for r in one]
    assert text[0] == "Model: elyza-ELYZA-japanese-Llama-2-7b-fast-instruct"
    assert text[1].startswith("Data Num: ")
    assert text[2] == "【format_wo_hf】"
    assert text[3].startswith("iter0-Acc: ") and text[6].startswith("All-Acc: ") and text[7] == ""
    assert len(text) == 2 + 4 * 6


def test_leaderboard_rows_follow_the_registry(spark, tmp_out):
    """Rows in registry order (not name order) within each task file."""
    import glob

    from textctl import sinks
    from textctl.operators.leaderboard import BOARD_COLUMNS

    models = [(0, "zeta/model-b"), (1, "alpha/model-a"), (2, "mid/model-c")]
    rows = [(t, m.replace("/", "-"), *["0.500"] * len(BOARD_COLUMNS)) for t in ("summary", "ad_text") for _, m in reversed(models)]
    board = spark.createDataFrame(rows, ["task", "model", *BOARD_COLUMNS])
    sinks.write_leaderboard(board, f"{tmp_out}/lb", models=models)
    for task in ("summary", "ad_text"):
        lines = open(glob.glob(f"{tmp_out}/lb/task={task}/*.csv")[0]).read().splitlines()
        assert [line.split(",")[0] for line in lines[1:]] == ["zeta-model-b", "alpha-model-a", "mid-model-c"]
