"""The benchmark's five stages as Spark jobs over folders.

Each job reads its inputs with one scan for all tasks and models, runs the
operators, and writes its outputs partitioned by ``task`` and ``model``:

1. ``generate``   master (JSONL) -> generated texts (long Parquet + wide JSONL export)
2. ``clean``      generated -> cleaned texts (long Parquet + wide ``_wo_hf`` JSONL export)
3. ``score_control`` master + cleaned -> control scores, analysis tables, score reports
4. ``score_quality`` master + cleaned -> judged rows, judge table, quality reports
5. ``leaderboard``   reports -> one CSV per task

A write replaces the folders of the tasks and models it has rows for and no
others (dynamic partition overwrite), as the benchmark keeps a file per task
and model: stages may run task by task or with a slice of the models.
``tasks`` and ``models`` narrow stages 2 to 5 to those folders.

Answers of models are appended to a log task by task, as tasks end, with the
run they belong to (``operators/answer_log.py``); nothing calls a model
twice, and a stage that is killed keeps what its ended tasks were answered.
``commit_every`` bounds the requests of a task. ``resume=True`` asks only for
what has no successful answer yet, in every stage that calls a model. A
request that failed keeps its error row until a later run succeeds; its text
is the sentinel or the error, as the benchmark writes it.

Lines of the master that do not parse are written to ``{out}/quarantine``;
``strict`` makes them an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..operators import answer_log as LOG
from ..operators import chat as CH
from ..operators import clean as CL
from ..operators import ids as ID
from ..operators import inference as INF
from ..operators import judge as J
from ..operators import keysets
from ..operators import leaderboard as LB
from ..operators import reshape as R
from ..operators import scores as S
from ..operators import validity as V
from ..schemas import ASPECTS, DEFAULT_ITERS, SENTINEL
from ..sources import files
from ..sources.registry import missing_results, model_slice, registry_paths, suffix_py

KEYS = ["task", "model", "prompt_id", "aspect", "iter"]


def _master(spark: SparkSession, master_paths, out: str, strict: bool = False) -> DataFrame:
    m = files.read_master(spark, master_paths)
    bad = f"{out}/quarantine"
    files.quarantine(m).write.mode("overwrite").json(bad)
    n = spark.read.text(bad).count()
    if n and strict:
        raise RuntimeError(f"{n} lines of the prompt master do not parse; see {bad}")
    if n:
        print(f"textctl: {n} lines of the prompt master do not parse; see {bad}")
    return files.parsed(m)


def _replace(df: DataFrame, path: str, by=("task", "model")) -> None:
    """Writes Parquet, replacing only the folders that get rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _narrowed(df: DataFrame, tasks, models) -> DataFrame:
    if tasks:
        df = df.where(F.col("task").isin(list(tasks)))
    if models is not None:
        df = df.where(F.col("model").isin([suffix_py(path) for _, path in models]))
    return df


def generate(
    spark: SparkSession,
    master_paths,
    out: str,
    factory,
    models: list[tuple[int, str]] | None = None,
    iters: int = DEFAULT_ITERS,
    use_system: bool = True,
    policy=None,
    resume: bool = False,
    strict: bool = False,
    partitions: int | None = None,
    commit_every: int | None = None,
) -> DataFrame:
    """Stage 1: every prompt x aspect x iteration x model through its family's
    chat layout and the model; stored long in ``{out}/generated``."""
    master = _master(spark, master_paths, out, strict)
    models = models if models is not None else model_slice(registry_paths())
    target = f"{out}/generated"
    run = LOG.new_run()
    if resume and LOG.exists(spark, target):
        # found by bitmaps of keys; only pending requests get their prompt text
        open_keys = keysets.pending(master, models, LOG.successes(spark, target), iters, ASPECTS)
        req = INF.with_prompt(open_keys, master, models)
    else:
        scope = master.select("task").distinct().select("task", F.explode(F.array(*[F.lit(suffix_py(path)) for _, path in models])).alias("model"))
        LOG.start_anew(scope, target, run)
        req = INF.generation_requests(master, models, iters=iters)
    req = CH.render_requests(req, use_system=use_system)
    to_model = [c for c in ("family", "system", "messages", "params") if c in req.columns]
    able = req.where(F.col("supported")).select(*KEYS, "model_path", F.col("chat_prompt").alias("prompt"), *to_model)
    able = LOG.spread(able, commit_every, KEYS)
    done = INF.run_model(able, factory, policy=policy, keys=KEYS, strip_echo=True, partitions=partitions, request_cols=to_model, checkpoint=False)
    LOG.append(done.withColumnRenamed("text", "raw_text"), target, run, ("task", "model"))
    if CH.unsupported_paths(models):
        CH.unsupported(req.where(~F.col("supported"))).write.mode("overwrite").parquet(f"{out}/unsupported_models")
    stored = _generated(spark, out)
    here = _narrowed(stored, None, models)
    wide = R.to_wide(here, values={"raw_text": "{a}_result"})
    ids = ID.generated_text_ids(master, models)
    base = master.select("task", "prompt_id", "base_text")
    export = wide.join(ids, ["task", "model_path", "model", "prompt_id"], "inner").join(base, ["task", "prompt_id"], "inner")
    sinks.write_jsonl(export, f"{out}/generated_jsonl")
    return stored


def _generated(spark: SparkSession, out: str) -> DataFrame:
    """All generated texts; of a failed request the error as text."""
    rows = LOG.latest(spark, f"{out}/generated", KEYS)
    return rows.withColumn("raw_text", F.coalesce("raw_text", "error"))


def unanswered(spark: SparkSession, master_paths, out: str, models=None, iters: int = DEFAULT_ITERS) -> DataFrame:
    """Per task, model, aspect and iteration how many prompts have
    a successful answer, for those that miss some (``n_prompts``,
    ``n_held``), from bitmaps of keys."""
    master = files.parsed(files.read_master(spark, master_paths))
    models = models if models is not None else model_slice(registry_paths())
    models = [m for m in models if not CH.unsupported_paths([m])]
    x = keysets.fill(master, models, LOG.successes(spark, f"{out}/generated"), iters, ASPECTS)
    return x.where(F.col("n_held") < F.col("n_prompts"))


def clean(
    spark: SparkSession,
    out: str,
    factory=None,
    policy=None,
    tasks=None,
    models=None,
    resume: bool = False,
    partitions: int | None = None,
    commit_every: int | None = None,
) -> DataFrame:
    """Stage 2: header/footer removal for every generated text; the rule
    cleaner when ``factory`` is None, else the cleaning model, asked once per
    distinct text. Answers are kept by text in ``{out}/clean_answers``."""
    gen = _narrowed(_generated(spark, out), tasks, models).select(*KEYS, "model_path", "raw_text", F.col("error").alias("generation_error"))
    if factory is None:
        cleaned = CL.clean_rules(gen).withColumn("clean_error", F.lit(None).cast("string"))
    else:
        keyed = gen.withColumn("_k", CL.text_key())
        answers = f"{out}/clean_answers"
        again = resume and LOG.exists(spark, answers)
        req = LOG.spread(CL.clean_requests(keyed, known=LOG.successes(spark, answers) if again else None), commit_every, ["_k"])
        done = INF.run_model(req, factory, policy=policy, keys=["_k"], partitions=partitions, request_cols=["system"], checkpoint=False)
        LOG.append(done, answers, LOG.new_run())  # of a text asked again the newest answer counts
        # stored once, so that the join below is between two shuffles and a hot text can be split
        known = LOG.newest(spark, answers, "_k").checkpoint()
        cleaned = CL.with_answers(keyed, known)
        # a model that stopped leaves texts unanswered: failed until a later run
        none = F.col("clean_text").isNull() & F.col("raw_text").isNotNull()
        cleaned = cleaned.withColumn("clean_error", F.when(none, F.coalesce("clean_error", F.lit("no answer"))).otherwise(F.col("clean_error")))
        cleaned = cleaned.withColumn("clean_text", F.when(none, F.lit(SENTINEL)).otherwise(F.col("clean_text")))
    cols = [*KEYS, "model_path", "raw_text", "clean_text", "generation_error", "clean_error"]
    _replace(cleaned.select(*cols), f"{out}/cleaned")
    stored = _narrowed(spark.read.parquet(f"{out}/cleaned"), tasks, models)
    sinks.write_jsonl(R.to_wide(stored), f"{out}/cleaned_jsonl")
    return stored


def check_inputs(spark: SparkSession, out: str, tasks, models) -> DataFrame:
    """The tasks and models asked for that have no cleaned texts."""
    found = spark.read.parquet(f"{out}/cleaned").select("task", "model").distinct()
    return missing_results(spark, found, tasks, models)


def _report_missing(spark: SparkSession, out: str, master: DataFrame, tasks, models) -> None:
    if models is None:
        return
    wanted = list(tasks) if tasks else [r["task"] for r in master.select("task").distinct().collect()]  # tasks are a fixed few
    missing = check_inputs(spark, out, wanted, models)
    missing.write.mode("overwrite").parquet(f"{out}/missing_inputs")
    for r in spark.read.parquet(f"{out}/missing_inputs").limit(100).collect():
        print(f"textctl: no cleaned texts of {r['model']} for {r['task']}")


def score_control(spark: SparkSession, master_paths, out: str, tasks=None, models=None, strict: bool = False) -> DataFrame:
    """Stage 3: validity of every text, scores per task, model, aspect and
    iteration, the analysis tables and the ``Label: 0.000`` reports."""
    master = _master(spark, master_paths, out, strict)
    _report_missing(spark, out, master, tasks, models)
    cleaned = _narrowed(spark.read.parquet(f"{out}/cleaned"), tasks, models)
    _replace(V.with_validity(cleaned, master), f"{out}/valid")
    valid = _narrowed(spark.read.parquet(f"{out}/valid"), tasks, models)
    counted = S.ctg_scores(valid)
    _replace(counted, f"{out}/ctg_scores")
    scores = _narrowed(spark.read.parquet(f"{out}/ctg_scores"), tasks, models).select(*counted.columns)
    sinks.write_lines(S.ctg_report_lines(scores), f"{out}/reports/ctg", partition_by=("task", "model", "iter"))
    _replace(_analysis(cleaned, valid, master), f"{out}/analysis/parquet", by=("task", "model", "iter"))
    analysis = _narrowed(spark.read.parquet(f"{out}/analysis/parquet"), tasks, models)
    sinks.write_analysis(analysis, f"{out}/analysis")
    # of all models, so that a run with a slice of them does not hide gaps
    every = spark.read.parquet(f"{out}/cleaned").select(*KEYS).join(master.select("task").distinct(), "task", "left_semi")
    V.coverage(every, master).write.mode("overwrite").parquet(f"{out}/coverage")
    return scores


def _analysis(cleaned: DataFrame, valid: DataFrame, master: DataFrame) -> DataFrame:
    """One row per prompt, model and iteration, texts and flags per
    aspect. The flags are joined to the texts on keys; the texts are pivoted
    once, the result is stored and read by all three sinks."""
    aspects = ["char_count", "keyword", "prohibited_word", "format"]
    texts = cleaned.select(*KEYS, "raw_text", "clean_text").join(valid.select(*KEYS, "is_valid"), KEYS, "inner")
    w = texts.groupBy("task", "model", "prompt_id", "iter").pivot("aspect", aspects).agg(
        F.first("raw_text").alias("result"), F.first("clean_text").alias("result_wo_hf"), F.first("is_valid").alias("is_valid")
    )
    cols = [c for c in ["title", "base_text", "char_count", "keyword", "prohibited_word", "format"] if c in master.columns]
    j = w.join(master.select("task", "prompt_id", *cols), ["task", "prompt_id"], "inner")
    out = ["task", "model", "iter", "prompt_id", *[c for c in ("title", "base_text") if c in cols]]
    sel = [F.col(c) for c in out]
    for a in aspects:
        sel += [F.col(a), F.col(f"{a}_result"), F.col(f"{a}_result_wo_hf"), F.col(f"{a}_is_valid").alias(f"is_valid_{a}")]
    return j.select(*sel)


def score_quality(
    spark: SparkSession,
    master_paths,
    out: str,
    factory,
    policy=None,
    skip_dead_letters: bool = False,
    dedupe: bool = False,
    tasks=None,
    models=None,
    iters: int = DEFAULT_ITERS,
    resume: bool = False,
    strict: bool = False,
    partitions: int | None = None,
    commit_every: int | None = None,
) -> DataFrame:
    """Stage 4: the judge for every cleaned text (fallback question for the
    answers that do not parse), judge table and quality reports. The answers
    to both questions are kept in ``{out}/judge_answers``."""
    master = _master(spark, master_paths, out, strict)
    _report_missing(spark, out, master, tasks, models)
    cleaned = _narrowed(spark.read.parquet(f"{out}/cleaned"), tasks, models).select(*KEYS, F.col("clean_text").alias("text"))
    items = cleaned.join(master.select("task", "prompt_id", "base_text"), ["task", "prompt_id"], "inner")
    if skip_dead_letters:
        items = items.where(F.col("text") != F.lit(SENTINEL))
    items = items.withColumn("_k", J.answer_key(dedupe))
    answers = []
    for number in (1, 2):
        path = f"{out}/judge_answers/question={number}"
        known = LOG.successes(spark, path) if resume and LOG.exists(spark, path) else None
        open_ = J.judge_requests(items, is_bool=number == 2, first=answers[0] if answers else None, known=known)
        open_ = LOG.spread(open_, commit_every, ["_k"])
        done = INF.run_model(open_, factory, policy=policy, keys=["_k"], partitions=partitions, request_cols=["system"], checkpoint=False)
        LOG.append(done, path, LOG.new_run())
        answers.append(LOG.newest(spark, path, "_k").checkpoint())
    judged = J.with_answers(items, *answers)
    _replace(judged, f"{out}/judged")
    judged = _narrowed(spark.read.parquet(f"{out}/judged"), tasks, models)
    qs = J.quality_scores(judged)
    n = cleaned.select("task", "model", "prompt_id").distinct().groupBy("task", "model").agg(F.count(F.lit(1)).alias("data_num"))
    sinks.write_lines(J.quality_report_lines(qs, n, iters=iters), f"{out}/reports/quality")
    run = models if models is not None else model_slice(registry_paths())
    ids = ID.generated_text_ids(master, run) if run else None  # positions in the registry
    sinks.write_judge_table(J.judge_table(judged, ids), f"{out}/judge_table")
    return qs


def leaderboard(
    spark: SparkSession, out: str, strict: bool = True, models: list[tuple[int, str]] | None = None, tasks=None, iters: int = DEFAULT_ITERS
) -> DataFrame:
    """Stage 5: the reports read back and combined; ``strict`` raises when a
    model's reports are incomplete (else they are left out and listed).
    Rows of each task's file follow the registry order of ``models``
    (default: the configured registry)."""
    c = files.read_ctg_reports(spark, f"{out}/reports/ctg/*/*/*/*.txt")
    q = files.read_quality_reports(spark, f"{out}/reports/quality/*/*/*.txt")
    if tasks:
        c, q = _narrowed(c, tasks, None), _narrowed(q, tasks, None)
    bad = LB.incomplete_scores(c, q, iters=iters)
    some = [tuple(r) for r in bad.limit(10).collect()]
    if strict and some:
        raise RuntimeError(f"incomplete score reports: {some}")
    board = LB.leaderboard(c.join(bad.select("task", "model"), ["task", "model"], "left_anti"), q, iters=iters)
    models = models if models is not None else model_slice(registry_paths())
    sinks.write_leaderboard(board, f"{out}/leaderboard", models=models)
    return board
