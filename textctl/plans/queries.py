"""The registered queries: each takes ``(spark, data_dir)`` and returns a
DataFrame built by the package's operators over the fixture views derived
from the folder's tables (``sources.fixtures``). Long texts are reported as
``md5`` and ``length`` so that outputs stay narrow; every query runs over
the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uuid import uuid4

from ..functions.text import delete_blank, strip_echo
from ..operators import answer_log as LOG
from ..operators import chat as CH
from ..operators import clean as CL
from ..operators import edges as ED
from ..operators import ids as ID
from ..operators import inference as INF
from ..operators import judge as J
from ..operators import judge_cells as JC
from ..operators import keysets
from ..operators import leaderboard as LB
from ..operators import prompts as P
from ..operators import reshape as R
from ..operators import scores as S
from ..operators import validity as V
from ..plans.joins import join_small
from ..schemas import ASPECTS, DEFAULT_ITERS, TASKS
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources import layout
from ..sources.registry import list_models, models_literal, model_slice, suffix_py

KEYS = ["task", "model", "prompt_id", "aspect", "iter"]


def md5len(c, name: str) -> list[Column]:
    c = F.col(c) if isinstance(c, str) else c
    return [F.md5(c).alias(f"{name}_md5"), F.length(c).alias(f"{name}_len")]


# ---------------------------------------------------------------- shared views


def results(spark, d):
    return fx.results(spark, d)


def results_by_prompt(spark, d):
    return fx.results_by_prompt(spark, d)


def keys_of_results(spark, d):
    return fx.result_keys(spark, d)


def master(spark, d, with_prompts=False, text=True):
    return fx.prompts(spark, d, with_prompts=with_prompts, text=text)


def narrow_master(spark, d):
    return fx.prompts(spark, d, text=False)


def valid(spark: SparkSession, d: str) -> DataFrame:
    return V.with_validity(results(spark, d), narrow_master(spark, d))


def scores(spark, d):
    return S.ctg_scores(valid(spark, d))


def judged(spark, d):
    keys = keys_of_results(spark, d).select(*KEYS)
    ans = fx.judge_answers(spark, d)
    return J.parse_answers(join_small(keys, ans, ["task", "prompt_id", "iter"], "inner"))


def quality(spark, d):
    return J.quality_scores(judged(spark, d))


def all_acc(spark, d):
    return J.quality_all_acc(quality(spark, d))


def registry_requests(spark, d, models=None):
    """C1 for the given models (default: the run slice), with chat prompts."""
    m = master(spark, d, with_prompts=True)
    return INF.generation_requests(m, models or fx.generated_models())


# ---------------------------------------------------------------- A: sources


def src_prompt_master(spark, d):
    m = master(spark, d, with_prompts=True)
    return m.select(
        "task", "prompt_id", "title", *md5len("base_text", "base_text"), "format", "char_count", "keyword", "prohibited_word",
        "min_chars", "max_chars", "keyword_answer", "prohibited_word_answer",
        *[x for a in ASPECTS for x in md5len(f"prompt_{a}", f"prompt_{a}")],
    )


def src_results(spark, d):
    return results(spark, d).select("task", "model_path", "model", "prompt_id", "aspect", "iter", *md5len("raw_text", "raw_text"))


def src_results_clean(spark, d):
    return results(spark, d).select(
        "task", "model_path", "model", "prompt_id", "aspect", "iter", *md5len("raw_text", "raw_text"), *md5len("clean_text", "clean_text")
    )


def read_ctg_report(spark, d):
    lines = S.ctg_report_lines(scores(spark, d))
    return LB.parse_ctg_report(lines)


def quality_lines(spark, d):
    qs = quality(spark, d)
    n = keys_of_results(spark, d).select("task", "model", "prompt_id").distinct().groupBy("task", "model").agg(F.count(F.lit(1)).alias("data_num"))
    return J.quality_report_lines(qs, n)


def read_quality_report(spark, d):
    return LB.parse_quality_report(quality_lines(spark, d))


def parse_bool_list(spark, d):
    from ..functions.text import parse_bool_list as pbl

    cells = J.bool_list_cells(judged(spark, d))
    x = cells.select("task", "model", "prompt_id", "aspect", F.posexplode(pbl("cell")).alias("iter", "ok"))
    return x.select("task", "model", "prompt_id", "aspect", F.col("iter").cast("int").alias("iter"), "ok")


def _layout(spark) -> str:
    """A new folder on the shared storage."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/layout-{uuid4().hex}"


def layout_master(spark, d):
    """A1: the prompt master written in the benchmark's layout and read back
    through the data source."""
    root, kind = _layout(spark), layout.KINDS["master"]
    m = master(spark, d)
    layout.write(m.select("task", *[F.col(f.name).cast(f.dataType) for f in kind.fields if f.name in m.columns]), root, "master")
    back = layout.read(spark, root, "master")
    return back.select("task", F.col("prompt_id").cast("long").alias("prompt_id"), "title", *md5len("base_text", "base_text"), "format", "char_count", "keyword", "prohibited_word", "char_count_answer", "keyword_answer", "prohibited_word_answer", "_corrupt_record")


def _layout_results(spark, d, kind, root):
    short = fx.short_results(spark, d)
    w = R.to_wide(short if kind == "results_clean" else short.drop("clean_text"))
    layout.write(w.withColumn("prompt_id", F.col("prompt_id").cast("string")), root, kind)


def layout_results(spark, d):
    """A2: generated results, as files and back, one row per text."""
    root = _layout(spark)
    _layout_results(spark, d, "results", root)
    back = R.to_long(layout.read(spark, root, "results"))
    return back.select("task", "model", "model_path", F.col("prompt_id").cast("long").alias("prompt_id"), "aspect", "iter", "raw_text")


def layout_results_clean(spark, d):
    """A3: cleaned results of one task and model, the other folders ruled
    out before they are listed."""
    root = _layout(spark)
    _layout_results(spark, d, "results_clean", root)
    one = layout.read(spark, root, "results_clean").where((F.col("task") == TASKS[1]) & (F.col("model") == suffix_py(fx.generated_models()[0][1])))
    return R.to_long(one).select("task", "model", F.col("prompt_id").cast("long").alias("prompt_id"), "aspect", "iter", "raw_text", "clean_text")


def layout_models(spark, d):
    """A10: the models with results, from the folders alone; one model has
    cleaned results only."""
    root, first = _layout(spark), F.col("model") == suffix_py(fx.generated_models()[0][1])
    short = fx.short_results(spark, d)
    layout.write(R.to_wide(short.where(first).drop("clean_text")), root, "results")
    layout.write(R.to_wide(short.where(~first & (F.col("task") == TASKS[0]))), root, "results_clean")
    return layout.read(spark, root, "models").select("task", "model")


def layout_ctg_reports(spark, d):
    """Control reports, written in line order and parsed again."""
    root = _layout(spark)
    layout.write(S.ctg_report_lines(scores(spark, d)), root, "ctg_report")
    return LB.parse_ctg_report(layout.read(spark, root, "ctg_report"))


def layout_quality_reports(spark, d):
    """Quality reports, the same way."""
    root = _layout(spark)
    layout.write(quality_lines(spark, d), root, "quality_report")
    return LB.parse_quality_report(layout.read(spark, root, "quality_report"))


def list_models_q(spark, d):
    return list_models(keys_of_results(spark, d))


def missing_inputs(spark, d):
    """Configured models without results, per task present in the master."""
    tasks = narrow_master(spark, d).select("task").distinct()
    expected = tasks.select("task", F.explode(models_literal(model_slice(fx.REGISTRY))).alias("m")).select(
        "task", "m.model_path", "m.model"
    )
    present = keys_of_results(spark, d).select("task", "model").distinct()
    return expected.join(present, ["task", "model"], "left_anti")


# ---------------------------------------------------------------- B: prompts


def constraints_long(spark, d):
    m = narrow_master(spark, d).withColumn("base_text", F.lit(None).cast("string"))
    return P.constraints_long(m).drop("base_text")


def task_prompts(spark, d):
    return P.task_prompts(master(spark, d)).select("task", "prompt_id", "aspect", *md5len("prompt", "prompt"))


def clean_prompts(spark, d):
    r = results(spark, d)
    return r.select(*KEYS, *md5len(P.clean_prompt("task", "raw_text"), "prompt"))


def _with_base(spark, d):
    r = results_by_prompt(spark, d).select(*KEYS, "clean_text")
    # both lie dealt by prompt: no result is shuffled or sorted; base texts are
    # not read once more to be measured
    return r.join(fx.base_texts(spark, d).hint("shuffle_hash"), ["task", "prompt_id"], "inner")


def judge_prompts(spark, d):
    x = _with_base(spark, d)
    return x.select(*KEYS, *md5len(P.judge_prompt("task", "clean_text", "base_text"), "prompt"))


def judge_prompts_bool(spark, d):
    x = _with_base(spark, d)
    return x.select(*KEYS, *md5len(P.judge_prompt("task", "clean_text", "base_text", is_bool=True), "prompt"))


def chat_prompts(spark, d):
    """Every task prompt in every family's layout, with and without the
    system prompt (fan-out by a literal array, no join)."""
    tp = P.task_prompts(master(spark, d))
    combos = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(u).alias("use_system")) for f in CH.FAMILIES for u in (True, False)])
    x = tp.select("task", "prompt_id", "aspect", "prompt", F.explode(combos).alias("c")).select(
        "task", "prompt_id", "aspect", "prompt", "c.family", "c.use_system"
    )
    return x.select(
        "task", "prompt_id", "aspect", "family", "use_system",
        CH.chat_system("family", "use_system").alias("system"),
        *md5len(CH.chat_prompt("family", "prompt", "use_system"), "chat"),
    )


def route_family(spark, d):
    req = registry_requests(spark, d, model_slice(fx.REGISTRY))
    r = CH.route(req)
    return r.groupBy("model_path", "loader_family", "family", "supported").agg(F.count(F.lit(1)).alias("n_requests"))


def unsupported_models(spark, d):
    return CH.unsupported(registry_requests(spark, d, model_slice(fx.REGISTRY)))


def gen_requests(spark, d):
    r = CH.render_requests(registry_requests(spark, d))
    return r.select(
        *KEYS, "model_path", "family", "use_system", *md5len("chat_prompt", "chat"),
        F.col("params.temperature").alias("temperature"), F.col("params.top_p").alias("top_p"),
    )


def gen_params(spark, d):
    """The parameters of every model with a renderer: all families."""
    r = CH.render_requests(registry_requests(spark, d, list(enumerate(CH.RENDERER))))
    return r.groupBy("model_path", "family").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.first("params.do_sample").alias("do_sample"),
        F.first("params.temperature").alias("temperature"),
        F.first("params.top_p").alias("top_p"),
        F.first("params.top_k").alias("top_k"),
        F.first("params.repetition_penalty").alias("repetition_penalty"),
        F.first("params.num_beams").alias("num_beams"),
        F.first("params.max_new_tokens").alias("max_new_tokens"),
    )


def strip_echo_q(spark, d):
    tp = P.task_prompts(master(spark, d))
    echoed = tp.withColumn("out", F.concat("prompt", F.lit("\n応答("), F.length("prompt").cast("string"), F.lit(")")))
    return echoed.select("task", "prompt_id", "aspect", strip_echo("out", "prompt").alias("text"))


# ---------------------------------------------------------------- C: generation


def _chat_requests(spark, d):
    r = CH.render_requests(registry_requests(spark, d))
    return r.select(*KEYS, "model_path", F.col("chat_prompt").alias("prompt"))


def gen_run(spark, d):
    done = INF.run_model(_chat_requests(spark, d), INF.echo_factory, keys=KEYS, strip_echo=True, models=len(fx.generated_models()))
    return done.select(*KEYS, "text", "error")


def gen_ids(spark, d):
    return ID.generated_text_ids(narrow_master(spark, d), fx.generated_models())


def _flaky(spark, d):
    return INF.run_model(_chat_requests(spark, d), INF.flaky_factory, policy=INF.NO_WAIT, keys=KEYS, models=len(fx.generated_models()))


def dead_letters(spark, d):
    return INF.dead_letters(_flaky(spark, d)).select(*KEYS, "error", "attempts")


def gen_errors(spark, d):
    return INF.errors_as_text(_flaky(spark, d)).select(*KEYS, "text")


def wide_results(spark, d):
    w = R.to_wide(results_by_prompt(spark, d))
    sep = "␞"
    cols = []
    for a in ASPECTS:
        cols += [F.size(f"{a}_result").alias(f"{a}_n"), F.md5(F.array_join(f"{a}_result", sep)).alias(f"{a}_md5"),
                 F.md5(F.array_join(f"{a}_result_wo_hf", sep)).alias(f"{a}_wo_hf_md5")]
    return w.select("task", "model", "prompt_id", *cols)


def pending_requests(spark, d):
    finished = results(spark, d).where(F.col("clean_text") != F.lit(fx.SENTINEL))
    return INF.pending(keys_of_results(spark, d).select(*KEYS), finished)


def gen_resume(spark, d):
    """A stage whose model stops half way and a second run of it. The
    answers of both come from the log; every request has one row there."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/answers-{uuid4().hex}"
    m = master(spark, d)
    models = fx.generated_models()
    LOG.append(INF.run_model(_chat_requests(spark, d), INF.quota_factory, keys=KEYS, checkpoint=False, models=len(models)), path, LOG.new_run(), ("task", "model"))
    left = keysets.pending(m, models, LOG.successes(spark, path), DEFAULT_ITERS, ASPECTS)
    again = CH.render_requests(INF.with_prompt(left, m, models)).select(*KEYS, "model_path", F.col("chat_prompt").alias("prompt"))
    LOG.append(INF.run_model(again, INF.length_factory, keys=KEYS, checkpoint=False, models=len(models)), path, LOG.new_run(), ("task", "model"))
    return LOG.visible(spark, path).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_answers"), F.max("text").alias("text"))


def pending_bitmaps(spark, d):
    """The requests of an interrupted run, by bitmaps of keys."""
    return keysets.pending(fx.gappy_prompts(spark, d), fx.generated_models(), fx.gappy_keys(spark, d), DEFAULT_ITERS, ASPECTS)


def key_fill(spark, d):
    """Prompts with a result per task, model, aspect and iteration."""
    return keysets.fill(fx.gappy_prompts(spark, d), model_slice(fx.REGISTRY), fx.gappy_keys(spark, d), DEFAULT_ITERS, ASPECTS)


# ---------------------------------------------------------------- D: cleaning


def clean_run(spark, d):
    r = results_by_prompt(spark, d).select(*KEYS, "raw_text")
    out = CL.model_clean(r, CL.rule_cleaner_factory, policy=INF.NO_WAIT)
    return out.select(*KEYS, *md5len("clean_text", "clean_text"), "error")


def clean_rules(spark, d):
    r = results(spark, d).select(*KEYS, "raw_text")
    return CL.clean_rules(r).select(*KEYS, *md5len("clean_text", "clean_text"))


def clean_wide(spark, d):
    w = R.to_wide(results_by_prompt(spark, d), values={"raw_text": "{a}_result"})
    c = R.clean_wide(w, CL.rule_clean)
    sep = "␞"
    return c.select("task", "model", "prompt_id", *[F.md5(F.array_join(f"{a}_result_wo_hf", sep)).alias(f"{a}_wo_hf_md5") for a in ASPECTS])


def _edge_texts(spark, d):
    return results(spark, d).select(*KEYS, "raw_text")


def edge_phrases(spark, d):
    """The headers and footers found in the generated texts."""
    texts = _edge_texts(spark, d)
    return ED.phrases(texts, ED.discover(texts))


def clean_discovered(spark, d):
    """The texts without them."""
    texts = _edge_texts(spark, d)
    return ED.strip(texts, ED.discover(texts)).select(*KEYS, *md5len("clean_text", "clean_text"))


# ---------------------------------------------------------------- E: control


def delete_blank_q(spark, d):
    r = results(spark, d)
    return r.select(*KEYS, *md5len(delete_blank("clean_text"), "clean_nb"))


def _valid_of(aspect):
    def q(spark, d):
        v = valid(spark, d).where(F.col("aspect") == aspect)
        return v.select("task", "model", "prompt_id", "iter", "is_valid")

    q.__name__ = f"valid_{aspect}"
    return q


def explode_iterations(spark, d):
    long = R.to_long(R.to_wide(results_by_prompt(spark, d)))
    return long.select(*KEYS, *md5len("raw_text", "raw_text"), *md5len("clean_text", "clean_text"))


def valid_all(spark, d):
    return valid(spark, d).select(*KEYS, "is_valid")


def analysis_rows(spark, d):
    """The analysis table (one row per prompt, model and iteration)."""
    # hashes are taken next to the scan: no text crosses the join or the pivot
    hashed = results(spark, d).withColumns({"r": F.md5("raw_text"), "c": F.md5("clean_text")})
    v = V.with_validity(hashed, narrow_master(spark, d), keep=["r", "c"])
    slim = v.select("task", "model", "prompt_id", "iter", "aspect", "r", "c", "is_valid")
    w = slim.groupBy("task", "model", "prompt_id", "iter").pivot("aspect", ASPECTS).agg(
        F.first("r").alias("result_md5"), F.first("c").alias("result_wo_hf_md5"), F.first("is_valid").alias("is_valid")
    )
    m = master(spark, d).select("task", "prompt_id", "title", F.md5("base_text").alias("base_text_md5"), *ASPECTS)
    out = w.join(m, ["task", "prompt_id"], "inner")
    cols = ["task", "model", "iter", "prompt_id", "title", "base_text_md5"]
    for a in ["char_count", "keyword", "prohibited_word", "format"]:
        cols += [F.col(a), F.col(f"{a}_result_md5"), F.col(f"{a}_result_wo_hf_md5"), F.col(f"{a}_is_valid").alias(f"is_valid_{a}")]
    return out.select(*cols)


def master_key_issues(spark, d):
    return V.master_key_issues(fx.gappy_prompts(spark, d)).select("task", "prompt_id", "n", "issue")


def ctg_report_lines(spark, d):
    return S.ctg_report_lines(scores(spark, d))


def coverage(spark, d):
    return V.coverage(fx.gappy_keys(spark, d), fx.gappy_prompts(spark, d))


# ---------------------------------------------------------------- F: quality


def judged_columns(spark, d):
    w = R.to_wide(results_by_prompt(spark, d))
    cols = R.judged_columns(w)
    per = F.array(*[F.struct(F.lit(c.replace("_result", "")).alias("label"), F.col(c).alias("xs")) for c in cols])
    x = w.select("task", "model", "prompt_id", F.explode(per).alias("s")).select(
        "task", "model", "prompt_id", "s.label", F.posexplode("s.xs").alias("iter", "text")
    )
    return x.select("task", "model", "prompt_id", "label", F.col("iter").cast("int").alias("iter"), *md5len("text", "text"))


class LengthJudge:
    """Stand-in judge: answers from the prompt's length (first question:
    適切 / 不適切 / an unparseable text; fallback: True / False / text)."""

    def __call__(self, prompts):
        out = []
        for p in prompts:
            n = len(p)
            if "必ずTrue, False" in p:
                out.append(["True", " False\n", "わからない"][n % 3])
            else:
                out.append(["適切", "不 適切", "判断できません"][n % 3])
        return out


def length_judge_factory(model_path):
    return LengthJudge()


def judge_run(spark, d):
    items = _with_base(spark, d).withColumnRenamed("clean_text", "text")
    j = J.judge_with_models(items, length_judge_factory, policy=INF.NO_WAIT)
    return j.select(*KEYS, "ok", "stage", "raw")


def _answers(spark, d):
    keys = keys_of_results(spark, d).select(*KEYS)
    return join_small(keys, fx.judge_answers(spark, d), ["task", "prompt_id", "iter"], "inner")


def judge_normalise(spark, d):
    return _answers(spark, d).select(*KEYS, delete_blank("answer").alias("answer_nb"))


def judge_label(spark, d):
    from ..functions.text import judge_label as jl

    return _answers(spark, d).select(*KEYS, jl("answer").alias("label"))


def judge_fallback(spark, d):
    return judged(spark, d).where(F.col("stage") != "first").select(*KEYS, "ok", "stage")


def judge_unparsed(spark, d):
    return judged(spark, d).where(F.col("stage") == "unparsed").select(*KEYS, "raw")


def judge_table(spark, d):
    """the judge file (list-literal cells per aspect) with the ids of C3."""
    ids = ID.generated_text_ids(narrow_master(spark, d), fx.generated_models())
    return J.judge_table(judged(spark, d), ids)


def judge_cells(spark, d):
    """The judge table of a talkative judge (one model and aspect)
    written as literals and read back as VARIANT; kept answers are whole texts."""
    said = fx.talkative_answers(spark, d).withColumns({"model": F.lit("judged-model"), "aspect": F.lit(ASPECTS[0])})
    written = JC.to_table(JC.from_judged(J.parse_answers(said)))
    read = JC.to_judged(JC.from_table(written.select("task", "model", "prompt_id", f"{ASPECTS[0]}_wo_hf")))
    return read.select("task", "prompt_id", "iter", "kind", "ok", *md5len("raw", "raw"))


def judge_cells_scored(spark, d):
    """F7 from the judge table's literals, beside the benchmark's reading of
    them by truthiness (Q25)."""
    x = JC.to_judged(JC.from_table(J.judge_table(judged(spark, d))))
    return J.quality_scores(x, n_all=F.count("truth"), n_true=F.count_if("truth")).drop("n_fallback")


def quality_scores(spark, d):
    return quality(spark, d)


def quality_all_acc(spark, d):
    return all_acc(spark, d)


def quality_report_lines(spark, d):
    return quality_lines(spark, d)


# ---------------------------------------------------------------- G: leaderboard


def ctg_mean_rounded(spark, d):
    return S.ctg_mean_rounded(scores(spark, d))


def _board_inputs(spark, d):
    """The two inputs of the leaderboard as the reports hold them, formatted
    and parsed back (A4, A5): for the completeness check of the reports."""
    return LB.parse_ctg_report(S.ctg_report_lines(scores(spark, d))), LB.parse_quality_report(quality_lines(spark, d))


def _board_numbers(spark, d):
    """The same values straight from the scores (3 decimals per iteration,
    All-Acc rounded once): no text round trip, no shuffle to order lines."""
    return LB.leaderboard_numbers(scores(spark, d), all_acc(spark, d), mode="report")


def leaderboard_wide(spark, d):
    c, q = _board_numbers(spark, d)
    cm = c.groupBy("task", "model", "aspect").agg(
        *[F.first(F.when(F.col("iter") == i, F.col("score")), ignorenulls=True).alias(f"i{i}") for i in range(3)]
    ).select("task", "model", "aspect", ((F.col("i0") + F.col("i1") + F.col("i2")) / F.lit(3)).alias("ctg"))
    j = cm.join(q.select("task", "model", "aspect", F.col("all_acc").alias("qual")), ["task", "model", "aspect"], "inner")
    return j.groupBy("task", "model").pivot("aspect", ASPECTS).agg(F.first("ctg").alias("ctg"), F.first("qual").alias("qual"))


def leaderboard_avg(spark, d):
    w = leaderboard_wide(spark, d)
    avg_c = sum([F.col(f"{a}_ctg") for a in ASPECTS[1:]], F.col(f"{ASPECTS[0]}_ctg")) / F.lit(4)
    avg_q = sum([F.col(f"{a}_qual") for a in ASPECTS[1:]], F.col(f"{ASPECTS[0]}_qual")) / F.lit(4)
    return w.select("task", "model", avg_c.alias("avg_ctg"), avg_q.alias("avg_qual"))


def leaderboard(spark, d):
    c, q = _board_numbers(spark, d)
    return LB.leaderboard(c, q)


def incomplete_scores(spark, d):
    """Reports of an interrupted run: one lacks a control line, one an
    iteration, one a quality value, one all of them."""
    c, q = _board_inputs(spark, d)
    one = F.col("model") == F.lit(suffix_py(fx.generated_models()[1][1]))
    c = c.where(~(one & (F.col("task") == TASKS[0]) & (F.col("iter") == 1) & (F.col("aspect") == ASPECTS[0])) & ~(~one & (F.col("task") == TASKS[1]) & (F.col("iter") == 2)))
    q = q.where(~(one & (F.col("task") == TASKS[2]) & (F.col("aspect") == ASPECTS[1])) & ~(~one & (F.col("task") == TASKS[2])))
    return LB.incomplete_scores(c, q).select("task", "model", "ctg_lines", "quality_values")


def ctg_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d)


QUERIES = {
    # A sources
    "src_prompt_master": src_prompt_master,
    "src_results": src_results,
    "src_results_clean": src_results_clean,
    "read_ctg_report": read_ctg_report,
    "read_quality_report": read_quality_report,
    "parse_bool_list": parse_bool_list,
    "list_models": list_models_q,
    "missing_inputs": missing_inputs,
    # B prompts
    "constraints_long": constraints_long,
    "task_prompts": task_prompts,
    "clean_prompts": clean_prompts,
    "judge_prompts": judge_prompts,
    "judge_prompts_bool": judge_prompts_bool,
    "chat_prompts": chat_prompts,
    "route_family": route_family,
    "unsupported_models": unsupported_models,
    "gen_params": gen_params,
    "strip_echo": strip_echo_q,
    # C generation
    "gen_requests": gen_requests,
    "gen_run": gen_run,
    "gen_ids": gen_ids,
    "dead_letters": dead_letters,
    "gen_errors": gen_errors,
    "wide_results": wide_results,
    "pending_requests": pending_requests,
    "layout_master": layout_master,
    "layout_results": layout_results,
    "layout_results_clean": layout_results_clean,
    "layout_models": layout_models,
    "layout_ctg_reports": layout_ctg_reports,
    "layout_quality_reports": layout_quality_reports,
    "gen_resume": gen_resume,
    "pending_bitmaps": pending_bitmaps,
    "key_fill": key_fill,
    # D cleaning
    "clean_run": clean_run,
    "clean_rules": clean_rules,
    "edge_phrases": edge_phrases,
    "clean_discovered": clean_discovered,
    "clean_wide": clean_wide,
    # E control
    "delete_blank": delete_blank_q,
    "valid_format": _valid_of("format"),
    "valid_keyword": _valid_of("keyword"),
    "valid_prohibited_word": _valid_of("prohibited_word"),
    "valid_char_count": _valid_of("char_count"),
    "explode_iterations": explode_iterations,
    "valid_all": valid_all,
    "ctg_scores": ctg_scores,
    "analysis_rows": analysis_rows,
    "ctg_report_lines": ctg_report_lines,
    "coverage": coverage,
    "master_key_issues": master_key_issues,
    # F quality
    "judged_columns": judged_columns,
    "judge_run": judge_run,
    "judge_normalise": judge_normalise,
    "judge_label": judge_label,
    "judge_fallback": judge_fallback,
    "judge_unparsed": judge_unparsed,
    "judge_table": judge_table,
    "judge_cells": judge_cells,
    "judge_cells_scored": judge_cells_scored,
    "quality_scores": quality_scores,
    "quality_all_acc": quality_all_acc,
    "quality_report_lines": quality_report_lines,
    # G leaderboard
    "ctg_mean_rounded": ctg_mean_rounded,
    "leaderboard_wide": leaderboard_wide,
    "leaderboard_avg": leaderboard_avg,
    "leaderboard": leaderboard,
    "incomplete_scores": incomplete_scores,
}
