"""Plan shape: pruning, pushdown, broadcast only after a size check,
results independent of partitioning."""

from textctl.plans import joins
from textctl.plans import queries as Q
from textctl.sources import fixtures as fx

from conftest import SF0001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_constraint_join_is_broadcast_and_text_not_read_on_small_side(spark):
    p = plan(Q.scores(spark, SF0001))
    assert "BroadcastHashJoin" in p
    narrow = plan(fx.prompts(spark, SF0001, text=False))
    assert "text:string" not in narrow and "Exchange" not in narrow


def test_join_small_falls_back_to_shuffle_join_above_limit(spark):
    big = fx.results(spark, SF0001)
    small = fx.prompts(spark, SF0001, text=False).select("task", "prompt_id", "min_chars")
    j = joins.join_small(big, small, ["task", "prompt_id"], max_bytes=10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        s = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in s or "ShuffledHashJoin" in s
        assert j.count() == big.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_scores_independent_of_partitioning(spark):
    a = Q.scores(spark, SF0001)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        fx._VIEWS.clear()
        b = Q.scores(spark, SF0001)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        fx._VIEWS.clear()


def test_scores_properties(spark):
    for r in Q.scores(spark, SF0001).collect():
        assert 0 <= r["score"] <= 1
        assert r["n_valid"] + r["n_undecided"] <= r["n"]
        if r["aspect"] != "format":
            assert r["n_undecided"] == 0


def test_model_stage_adds_no_shuffle_to_a_spread_input(spark):
    """Requests keep their partitioning (no shuffle by model); the model
    stage only sorts by model inside each partition."""
    from textctl.operators import inference as INF

    req = Q._chat_requests(spark, SF0001)
    before = plan(req).count("Exchange")
    staged = INF.run_model(req, INF.echo_factory, keys=Q.KEYS, checkpoint=False)
    p = plan(staged)
    assert "MapInPandas" in p and p.count("Exchange") == before


def test_score_aggregate_combines_map_side(spark):
    """A partial aggregate before the shuffle, so a hot group sends one
    row per map task, not its rows."""
    p = plan(Q.scores(spark, SF0001))
    assert "partial_count" in p


def test_scores_equal_when_the_constraint_side_is_too_large(spark, monkeypatch):
    """Beyond the broadcast limit the validity join is a sort-merge join
    (AQE may split skewed partitions); the scores stay the same."""
    want = Q.scores(spark, SF0001)
    rows_want = sorted(tuple(r) for r in want.collect())
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, max_bytes=0: False)
    fx._VIEWS.clear()
    try:
        got = Q.scores(spark, SF0001)
        p = plan(got)
        assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p
        assert sorted(tuple(r) for r in got.collect()) == rows_want
    finally:
        fx._VIEWS.clear()


def test_hot_prompt_is_split_by_aqe_and_scores_stay(spark, monkeypatch):
    """One prompt holds a third of the results; with the constraint join
    above the broadcast limit, AQE splits the hot partition of the
    sort-merge join (skew=true) and the scores equal the broadcast ones."""
    import contextlib
    import io

    from pyspark.sql import functions as F

    from textctl.operators import scores as S
    from textctl.operators import validity as V

    n = 30000
    aspects = F.array(*[F.lit(a) for a in ["format", "char_count", "keyword", "prohibited_word"]])
    res = spark.range(n).select(
        F.lit("summary").alias("task"),
        F.lit("m").alias("model"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("prompt_id"),
        F.element_at(aspects, (F.col("id") % 4 + 1).cast("int")).alias("aspect"),
        (F.col("id") % 3).cast("int").alias("iter"),
        F.concat(F.lit("前置き "), F.repeat(F.lit("abc def "), (F.col("id") % 50).cast("int"))).alias("raw_text"),
        F.repeat(F.lit("abc def "), (F.col("id") % 50).cast("int")).alias("clean_text"),
    )
    master = spark.range(n).select(
        F.lit("summary").alias("task"), F.col("id").alias("prompt_id"), F.lit(10).alias("min_chars"), F.lit(200).alias("max_chars"),
        F.lit("abc").alias("keyword_answer"), F.lit("zzz").alias("prohibited_word_answer"),
    )
    want = sorted(tuple(r) for r in S.ctg_scores(V.with_validity(res, master)).collect())
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, max_bytes=0: False)
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = S.ctg_scores(V.with_validity(res, master))
        got = sorted(tuple(r) for r in df.collect())
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in buf.getvalue()
    assert got == want


def test_clean_dedupe_combines_map_side(spark):
    """Identical texts collapse in each map task before the dedupe
    shuffle (partial aggregate), so a text repeated in a third of the rows
    crosses the shuffle once per map task."""
    from textctl.operators import clean as CL
    from textctl.operators import inference as INF

    r = fx.results(spark, SF0001).select(*Q.KEYS, "raw_text")
    out = CL.model_clean(r, CL.rule_cleaner_factory, policy=INF.NO_WAIT, checkpoint=False)
    p = plan(out)
    # the partial step aggregates a fixed-width number by hash: no text is sorted for it
    assert "partial_min" in p and "SortAggregate" not in p
