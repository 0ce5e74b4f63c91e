"""Compatibility switches and policies of SURVEY §1.4 (Q8, Q9, Q16, Q25),
extra sinks (E12, F9) and request partitioning."""

import glob

import pytest
from pyspark.sql import functions as F

from textctl import sinks
from textctl.functions.text import parse_bool_list
from textctl.operators import chat as CH
from textctl.operators import clean as CL
from textctl.operators import inference as INF
from textctl.operators import judge as J
from textctl.operators import leaderboard as LB
from textctl.plans import queries as Q
from textctl.sources import fixtures as fx
from textctl.sources.registry import check_inputs

from conftest import SF0001


def test_parse_bool_list_compat_counts_raw_answers_as_true(spark):
    df = spark.createDataFrame([("[True, False, '判定できません']",)], "c string")
    assert df.select(parse_bool_list("c", compat=True).alias("x")).first()["x"] == [True, False, True]
    assert df.select(parse_bool_list("c").alias("x")).first()["x"] == [True, False, None]


def test_check_inputs_strict(spark):
    missing = Q.missing_inputs(spark, SF0001)
    assert check_inputs(missing).count() == missing.count() > 0
    with pytest.raises(FileNotFoundError):
        check_inputs(missing, strict=True)
    check_inputs(missing.limit(0), strict=True)


def test_chat_messages_for_hosted_chat(spark):
    df = spark.createDataFrame([("openai", "問", True), ("openai", "問", False), ("calm2", "問", True)], "f string, t string, u boolean")
    rows = df.select(CH.chat_messages("f", "t", "u").alias("m")).collect()
    assert [tuple(x) for x in rows[0]["m"]] == [("system", CH.CHAT_SYSTEM["openai"][0]), ("user", "問")]
    assert [tuple(x) for x in rows[1]["m"]] == [("system", ""), ("user", "問")]
    assert rows[2]["m"] is None


def test_judge_skips_dead_letters_only_when_asked(spark):
    items = Q._with_base(spark, SF0001).withColumnRenamed("clean_text", "text")
    n_sentinel = items.where(F.col("text") == "Invalid Error").count()
    assert n_sentinel > 0
    all_rows = J.judge_with_models(items, Q.length_judge_factory, policy=INF.NO_WAIT)
    kept = J.judge_with_models(items, Q.length_judge_factory, policy=INF.NO_WAIT, skip_dead_letters=True)
    assert all_rows.count() == items.count()
    assert kept.count() == items.count() - n_sentinel


def test_leaderboard_modes(spark):
    sc, acc = Q.scores(spark, SF0001), Q.all_acc(spark, SF0001)
    report = LB.leaderboard(*LB.leaderboard_numbers(sc, acc))
    exact = LB.leaderboard(*LB.leaderboard_numbers(sc, acc, mode="exact"))
    assert report.exceptAll(Q.leaderboard(spark, SF0001)).count() == 0
    assert exact.count() == report.count()
    with pytest.raises(ValueError):
        LB.leaderboard_numbers(sc, acc, mode="other")


def test_analysis_and_judge_table_sinks(spark, tmp_out):
    a = Q.analysis_rows(spark, SF0001)
    sinks.write_analysis(a, f"{tmp_out}/analysis")
    for kind in ("csv", "tsv", "jsonl"):
        assert glob.glob(f"{tmp_out}/analysis/{kind}/task=*/model=*/iter=*/part-*")
    back = spark.read.json(f"{tmp_out}/analysis/jsonl")
    assert back.count() == a.count()
    t = Q.judge_table(spark, SF0001)
    sinks.write_judge_table(t, f"{tmp_out}/judge")
    csv = spark.read.options(**sinks.CSV_OPTIONS, multiLine="true").csv(f"{tmp_out}/judge")
    assert csv.count() == t.count()
    assert set(csv.columns) >= {"prompt_id", "format_wo_hf", "prohibited_word_wo_hf", "generated_text_id"}


def test_run_model_spreads_a_single_partition(spark):
    req = Q._chat_requests(spark, SF0001).coalesce(1)
    keys = ["task", "model", "prompt_id", "aspect", "iter"]
    # a shuffle of the prompts only where asked for
    assert INF.run_model(req, INF.echo_factory, keys=keys, checkpoint=False).rdd.getNumPartitions() == 1
    done = INF.run_model(req, INF.echo_factory, keys=keys, partitions=8, checkpoint=False)
    assert done.rdd.getNumPartitions() == 8
    assert done.count() == req.count()


def test_judge_dedupe_same_answers_fewer_calls(spark):
    """with a deterministic judge, one call per distinct (task,
    base_text, text) gives every row the answers it would get alone."""
    items = Q._with_base(spark, SF0001).withColumnRenamed("clean_text", "text")
    calls = spark.sparkContext.accumulator(0)

    def counting_judge(model_path):
        judge = Q.LengthJudge()

        def call(prompts):
            calls.add(len(prompts))
            return judge(prompts)

        return call

    cols = ["task", "model", "prompt_id", "aspect", "iter", "ok", "stage", "raw"]
    every = J.judge_with_models(items, Q.length_judge_factory, policy=INF.NO_WAIT).select(*cols)
    once = J.judge_with_models(items, counting_judge, policy=INF.NO_WAIT, dedupe=True).select(*cols)
    assert once.count() == items.count()
    assert every.exceptAll(once).count() == 0 and once.exceptAll(every).count() == 0
    distinct = items.select("task", "base_text", "text").distinct().count()
    assert distinct < items.count()
    keys = ["task", "model", "prompt_id", "aspect", "iter"]
    asked_again = items.join(once.where(F.col("stage") != "first").select(*keys), keys).select("task", "base_text", "text").distinct().count()
    assert calls.value == distinct + asked_again


def test_texts_of_a_prompt_stay_where_they_are(spark, tmp_path):
    """Which rows are asked for is found on narrow rows; the results'
    texts are neither shuffled nor sorted, only the documents they come from."""
    spark.range(40).selectExpr("id AS doc_id", "repeat('text. ', 9) AS text").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = Q._with_base(spark, d).withColumnRenamed("clean_text", "text").withColumn("_k", J.answer_key(False))
        keyed = fx.results_by_prompt(spark, d).select(*Q.KEYS, "raw_text").withColumn("_k", CL.text_key())
        for frame in (J.judge_requests(items), CL.clean_requests(keyed.where("prompt_id IS NOT NULL AND task IS NOT NULL"))):
            plan = frame._jdf.queryExecution().executedPlan().toString().split("\n")
            # from the join that finds the rows down to the documents' only shuffle
            at = next(i for i, x in enumerate(plan) if "ShuffledHashJoin" in x)
            down = plan[at : next(i for i in range(at, len(plan)) if "Exchange" in plan[i]) + 1]
            assert not any("Sort" in x for x in down) and "REPARTITION_BY_NUM" in down[-1]
            assert frame.count() == frame.select("_k").distinct().count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_row_per_key_is_named_also_without_a_prompt(spark):
    """Keys shared over prompts, rows that come twice, null prompts."""
    from textctl.plans.joins import named_rows

    rows = [("a", 5, "s", 1), ("a", 3, "s", 2), ("b", 3, "s", 2), ("b", 4, "s", 1), ("c", 1, "s", None), ("c", 2, "s", 1), ("d", 2, None, None), ("d", 2, None, None), ("e", 7, "t", 1)]
    df = spark.createDataFrame([(*r, f"{r}") for r in rows], "_k string, _row long, task string, prompt_id long, raw_text string")
    known = spark.createDataFrame([("e",), ("e",)], "_k string")
    asked = spark.createDataFrame([(k,) for k in "abcde"], "_k string")
    got = sorted((r._k, r._row) for r in named_rows(df, known, asked).collect())
    assert got == [("a", 3), ("b", 3), ("c", 1), ("d", 2), ("d", 2)]


def test_rows_are_asked_and_told_by_prompt(spark):
    """Keys that come twice, unknown ones, null prompts: as joins on the key."""
    from textctl.plans.joins import asked_rows, with_told

    rows = [("a", "s", 1), ("a", "s", 1), ("b", "s", 1), ("c", "s", 2), ("d", None, None), ("d", None, None), ("e", "s", None), ("f", "t", 3)]
    df = spark.createDataFrame([(*r, f"text {i}") for i, r in enumerate(rows)], "_k string, task string, prompt_id long, text string")
    told = [("a", "s", 1, "x"), ("a", "s", 1, "y"), ("d", None, None, "z"), ("e", "s", None, None), ("f", "t", 3, None), ("g", "t", 3, "no row")]
    answers = spark.createDataFrame(told, "_k string, task string, prompt_id long, answer string")
    got = sorted(r.text for r in asked_rows(df, answers.drop("answer")).collect())
    assert got == [f"text {i}" for i, r in enumerate(rows) if r[0] in "adef"]
    want = df.join(answers.select("_k", "answer"), "_k", "left").select("_k", "task", "prompt_id", "text", "answer")
    out = with_told(df, answers)
    assert out.columns == want.columns and out.count() == 10
    assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0


def test_answers_by_row_are_joined_without_their_key(spark, tmp_path):
    """neither texts nor keys of results are dealt by key; the second
    question and the answers go to a prompt's rows as lists."""
    spark.range(40).selectExpr("id AS doc_id", "repeat('text. ', 9 + id) AS text").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = Q._with_base(spark, str(tmp_path)).withColumnRenamed("clean_text", "text")
        out = J.judge_with_models(items, Q.length_judge_factory, policy=INF.NO_WAIT)
        plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
        # the rows that have a prompt; the others are few or none
        at = next(i for i, x in enumerate(plan) if "Union" in x)
        mark = plan[at].index("Union")
        here = plan[at + 1 : next(i for i in range(at + 1, len(plan)) if plan[i][mark : mark + 2] == "+-")]
        assert sum("ShuffledHashJoin" in x for x in here) >= 2
        assert not any("hashpartitioning(_k" in x or "SortMergeJoin" in x for x in here)
        assert out.count() == 40 * 24 and out.select("stage").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
