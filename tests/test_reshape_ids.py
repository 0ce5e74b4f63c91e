"""Wide <-> long round trips, id numbering under skew."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from textctl.operators import ids, reshape
from textctl.plans import queries as Q
from textctl.sources import fixtures as fx

from conftest import SF0001


def test_wide_long_round_trip(spark):
    long = fx.results(spark, SF0001).select("task", "model_path", "model", "prompt_id", "aspect", "iter", "raw_text", "clean_text")
    back = reshape.to_long(reshape.to_wide(long))
    cols = ["task", "model_path", "model", "prompt_id", "aspect", "iter", "raw_text", "clean_text"]
    assert back.select(*cols).exceptAll(long.select(*cols)).count() == 0
    assert long.select(*cols).exceptAll(back.select(*cols)).count() == 0


def test_absent_aspect_is_null(spark):
    long = fx.results(spark, SF0001).where(F.col("aspect") != "keyword")
    w = reshape.to_wide(long)
    assert w.where(F.col("keyword_result").isNotNull()).count() == 0
    assert reshape.judged_columns(w) == [f"{a}_result_wo_hf" for a in ["format", "char_count", "keyword", "prohibited_word"]]


def test_row_numbers_match_window_with_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot", i) for i in rnd.sample(range(10**6), 3000)] + [(f"g{rnd.randrange(5)}", i) for i in rnd.sample(range(10**6), 2000)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = ids.row_numbers(df, ["g"], "k", partitions=7)
    want = df.withColumn("rank0", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_row_numbers_without_broadcast(spark, monkeypatch):
    """Offsets too large to broadcast (limit 0): sort-merge join, same ranks."""
    from textctl.plans import joins

    monkeypatch.setattr(joins, "DEFAULT_BROADCAST_BYTES", 0)
    rows = [(f"g{i % 3}", i * 7 % 1009) for i in range(1009)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = ids.row_numbers(df, ["g"], "k", partitions=5)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    want = df.withColumn("rank0", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_generated_text_ids_dense_per_task(spark):
    ids_df = ids.generated_text_ids(fx.prompts(spark, SF0001, text=False), fx.generated_models())
    per = ids_df.groupBy("task").agg(F.min("generated_text_id").alias("lo"), F.max("generated_text_id").alias("hi"), F.count("*").alias("n"))
    for r in per.collect():
        assert r["lo"] == 0 and r["hi"] == r["n"] - 1


def test_row_numbers_do_not_depend_on_exchange_reuse(spark):
    """3,000,000 keys, another column carried, no exchange reuse."""
    df = spark.range(3_000_000).select((F.col("id") * 7919 % 3_000_017).alias("k"), F.lit("g").alias("g"), F.concat(F.lit("x"), F.col("id")).alias("x"))
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = ids.row_numbers(df, ["g"], "k", partitions=16)
        got = got.withColumn("near", F.lag("k").over(Window.partitionBy((F.col("rank0") / 1000).cast("long")).orderBy("rank0")))
        r = got.agg(F.count_distinct("rank0").alias("n"), F.min("rank0").alias("lo"), F.max("rank0").alias("hi"), F.sum((F.col("near") >= F.col("k")).cast("int")).alias("bad")).first()
        edge = got.groupBy((F.col("rank0") / 1000).cast("long").alias("b")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
        w = Window.orderBy("b")
        wrong = edge.withColumn("prior", F.lag("hi").over(w)).where("prior >= lo").count()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert tuple(r) == (3_000_000, 0, 2_999_999, 0) and wrong == 0


def test_results_are_dealt_by_prompt_before_they_are_repeated(spark, tmp_path):
    """Documents in many files; the wide form groups results where
    they are, and only documents are shuffled."""
    spark.range(40).selectExpr("id AS doc_id", "repeat('text. ', 9) AS text").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("wide_results", "clean_wide", "explode_iterations", "judged_columns"):
        p = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert p.count("Exchange ") == 1 and p.index("Generate explode([[") < p.index("Exchange "), name
    a, b = fx.results(spark, str(tmp_path)), fx.results_by_prompt(spark, str(tmp_path))
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
