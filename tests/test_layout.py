"""The layout data source: round trips, splits, pruning, two-phase writes."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from textctl.operators import reshape as R
from textctl.sources import fixtures as fx
from textctl.sources import files, layout
from conftest import SF0001


def wide(spark):
    r = fx.results(spark, SF0001, iters=2).where("prompt_id < 40").withColumn("prompt_id", F.col("prompt_id").cast("string"))
    return R.to_wide(r).select("task", "model", "model_path", "prompt_id", *[f.name for f in files.RESULTS_CLEAN_WIDE.fields if f.name.endswith(("_result", "_wo_hf"))])


def rows(df, *cols):
    return sorted((tuple(map(repr, r)) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_round_trip_of_results(spark, tmp_out):
    df = wide(spark)
    layout.write(df.repartition(3), tmp_out, "results_clean")
    assert rows(layout.read(spark, tmp_out, "results_clean"), *df.columns) == rows(df)
    # the benchmark's own reader reads the same files
    back = files.read_results(spark, f"{tmp_out}/*/*/generated_result/*.jsonl", clean=True)
    assert rows(back, *df.columns) == rows(df)
    one = df.drop(*[c for c in df.columns if c.endswith("_wo_hf")])
    layout.write(one.coalesce(1), tmp_out, "results")
    assert len(glob.glob(f"{tmp_out}/*/*/generated_result/generated_result_v1.jsonl")) == 6
    assert rows(layout.read(spark, tmp_out, "results"), *one.columns) == rows(one)  # without the cleaned files
    assert rows(layout.read(spark, tmp_out, "models")) == rows(df.select("task", "model").distinct())


def test_lines_at_every_split(spark, tmp_out):
    os.makedirs(f"{tmp_out}/summary")
    lines = [json.dumps({"prompt_id": i, "title": "é" * (i % 7), "char_count_answer": [i, 2]}, ensure_ascii=False) for i in range(60)]
    lines[7], lines[8], lines[30] = '{"prompt_id": broken', '{"prompt_id": 8, "char_count_answer": "no list"}', json.dumps({"prompt_id": 30, "base_text": "x" * 3000})
    with open(f"{tmp_out}/summary/prompts_v1.jsonl", "w") as f:
        f.write("\n".join(lines))  # no line end at the end
    for size in (1, 2, 17, 50, 64, 1000, 1 << 20):
        r = layout.LayoutReader(layout.KINDS["master"], {"path": tmp_out, "split_bytes": size})
        got = [line.decode() for p in r.partitions() for line in r._lines(p)]
        assert got == lines, size
    small = layout.read(spark, tmp_out, "master", split_bytes=100).collect()
    assert len(small) == 60 and {r._corrupt_record for r in small} == {None, lines[7], lines[8]}
    assert {r.prompt_id for r in small if not r._corrupt_record} == {str(i) for i in range(60) if i not in (7, 8)}


def test_conditions_on_folders_are_pushed_down(spark, tmp_out):
    df = wide(spark).withColumn("model", F.when(F.col("task") == "summary", F.col("model")).otherwise("m2"))
    layout.write(df, tmp_out, "results_clean")
    with open(glob.glob(f"{tmp_out}/ad_text/m2/generated_result/*.jsonl")[0], "wb") as f:
        f.write(b"\xff not read")
    got = layout.read(spark, tmp_out, "results_clean").where((F.col("task") == "summary") & F.col("model").isin("m2", df.first().model) & F.col("prompt_id").isNotNull())
    assert got.where("_corrupt_record IS NOT NULL").count() == 0
    assert got.count() == df.where(F.col("task") == "summary").where(F.col("model") == df.first().model).count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo" not in plan.split("Filter")[0] and got.rdd.getNumPartitions() < layout.read(spark, tmp_out, "results_clean").rdd.getNumPartitions()


def test_reports_keep_their_line_order(spark, tmp_out):
    lines = [("s", "m", i, n, f"line {n} of {i}") for i in range(3) for n in range(30)] + [("t", "m", 0, 0, ""), ("t", "m", 0, 1, "é: 0.500")]
    df = spark.createDataFrame(lines, "task string, model string, iter int, line_no int, line string")
    layout.write(df.orderBy(F.rand(1)).repartition(5), tmp_out, "ctg_report")
    assert open(f"{tmp_out}/s/m/score/v1_ctg_score_2.txt").read() == "".join(f"line {n} of 2\n" for n in range(30))
    assert rows(layout.read(spark, tmp_out, "ctg_report")) == rows(df)
    with pytest.raises(Exception, match="several tasks|not in order"):
        df.repartition(5, "line_no").write.format(layout.NAME).mode("append").options(kind="ctg_report").save(tmp_out)
    assert rows(layout.read(spark, tmp_out, "ctg_report")) == rows(df) and not glob.glob(f"{tmp_out}/_staging/*/*")


def test_overwrite_replaces_the_folders_that_get_rows(spark, tmp_out):
    df = wide(spark)
    layout.write(df.repartition(4), tmp_out, "results_clean")
    part = df.where(F.col("task") == "summary").limit(3).checkpoint()
    layout.write(part, tmp_out, "results_clean")
    others = df.where(F.col("task") != "summary")
    assert rows(layout.read(spark, tmp_out, "results_clean").where("task <> 'summary'"), *df.columns) == rows(others)
    models = [r.model for r in part.select("model").distinct().collect()]
    assert rows(layout.read(spark, tmp_out, "results_clean").where(F.col("model").isin(models) & (F.col("task") == "summary")), *df.columns) == rows(part)
    layout.write(part, tmp_out, "results_clean", mode="append")
    assert layout.read(spark, tmp_out, "results_clean").where(F.col("model").isin(models) & (F.col("task") == "summary")).count() == 6


def test_a_failed_write_shows_nothing(spark, tmp_out):
    df = wide(spark)
    layout.write(df, tmp_out, "results_clean")
    before = rows(layout.read(spark, tmp_out, "results_clean"))
    bad = df.withColumn("model", F.when(F.col("prompt_id") == "33", F.lit("a/b")).otherwise(F.col("model"))).repartition(4)
    with pytest.raises(Exception, match="no folder can be named"):
        layout.write(bad, tmp_out, "results_clean")
    assert rows(layout.read(spark, tmp_out, "results_clean")) == before and not os.listdir(f"{tmp_out}/_staging")


def test_an_interrupted_commit_is_seen_whole_and_finished(spark, tmp_out, monkeypatch):
    """The commit file exists, one of the moves was made: readers see every
    file of the write once; the next writer ends it."""
    kind = layout.KINDS["master"]
    schema = files.T.StructType([files.T.StructField("task", files.T.StringType()), files.T.StructField("prompt_id", files.T.StringType())])
    batch = lambda n: layout.pa.RecordBatch.from_pylist([{"task": t, "prompt_id": f"{n}{t}{i}"} for t in "ab" for i in range(3)])
    first = layout.LayoutWriter(kind, {"path": tmp_out}, schema, True)
    first.commit([first.write(iter([batch("old")]))])
    second = layout.LayoutWriter(kind, {"path": tmp_out}, schema, True)
    message = second.write(iter([batch("new")]))
    monkeypatch.setattr(layout, "_finish", lambda where, root: None)
    second.commit([message])
    monkeypatch.undo()
    seen = lambda: sorted(r.prompt_id for r in layout.read(spark, tmp_out, "master").collect())
    want = sorted(f"new{t}{i}" for t in "ab" for i in range(3))
    commit = layout._commits(*layout._open(tmp_out))[0]
    assert seen() == want
    os.replace(*commit["moves"][0])
    assert seen() == want
    layout.LayoutWriter(kind, {"path": tmp_out}, schema, True)
    assert seen() == want and not os.listdir(f"{tmp_out}/_commits") and len(glob.glob(f"{tmp_out}/*/*.jsonl")) == 2
