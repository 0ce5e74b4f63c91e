"""Benchmark-shaped views derived from the shared data tables by Spark.

The benchmark ships no data, so prompts, generations, cleanings and judge
answers are derived from ``documents`` and ``labels`` by fixed rules (see
FIXTURES.md §3). Every view is a lazy plan over the scan: it grows with the
tables and feeds the real operators. The DuckDB views of the oracle apply
the same rules (``textctl.oracle``).
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prompts import with_prompt_columns
from ..schemas import ASPECTS, DEFAULT_ITERS, SENTINEL, TASKS
from .registry import model_slice, model_struct_sql, sql_str
from .tables import read_table

_VIEWS: OrderedDict = OrderedDict()
_MAX_VIEWS = 64


def _memo(name: str, spark: SparkSession, data_dir: str, *args, build):
    """One DataFrame per view, session and folder: branches of a query that
    use the same view share one plan (and Spark can reuse its exchanges).
    The most recently used views are kept; a view of another session object
    (an id reused after a session ended) is built again."""
    key = (name, spark.sparkContext.applicationId, id(spark), data_dir, args)
    df = _VIEWS.get(key)
    if df is None or df.sparkSession is not spark:
        df = _VIEWS[key] = build()
        while len(_VIEWS) > _MAX_VIEWS:
            _VIEWS.popitem(last=False)
    else:
        _VIEWS.move_to_end(key)
    return df

# --- Fixture rules (our own; FIXTURES.md §3) ---
# Registry: four configured models; the first two have generations, the
# third has no results yet, the fourth no renderer either.
REGISTRY = [
    "elyza/ELYZA-japanese-Llama-2-7b-fast-instruct",
    "llm-jp/llm-jp-13b-instruct-full-jaster-v1.0",
    "rinna/bilingual-gpt-neox-4b-instruction-sft",
    "org/unlisted-model",
]
GENERATED = (0, 2)  # model_slice(start_index=0, num=2)
KEYWORD_BY_LANG = {"en": "th", "de": "sch", "fr": "eau", "es": "ci"}
PROHIBITED_BY_LANG = {"en": "Whou", "de": "Zu", "fr": "que", "es": "la"}
# Header and footer the fixture's "model" adds to some texts.
HEADER = "以下の文章を要約します。\n"
FOOTER = "\n以上が要約結果になります。"
FORMAT_TEXT = "前置きや後書きを付けずに出力してください。"
# --- end of fixture rules ---


def _by_lang(lang: Column, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(lang == k, F.lit(v)) if out is None else out.when(lang == k, F.lit(v))
    return out


def task_of(prompt_id: Column) -> Column:
    r = prompt_id % 3
    return F.when(r == 0, F.lit(TASKS[0])).when(r == 1, F.lit(TASKS[1])).otherwise(F.lit(TASKS[2]))


def documents(spark: SparkSession, data_dir: str, columns=("doc_id", "text", "lang", "source")) -> DataFrame:
    """The documents scan. Only a read that carries ``text`` is rebalanced
    (see ``read_table``): narrow key/label reads go straight from the scan."""
    key = "doc_id" if "text" in columns else None
    return _memo("documents", spark, data_dir, tuple(columns), build=lambda: read_table(spark, data_dir, "documents", list(columns), key=key))


#: Bytes of the documents' files per partition of ``_by_prompt``: a document
#: becomes 24 results of two texts, and a task's results should fit its memory.
PROMPT_PARTITION_BYTES = 4 << 20


def _by_prompt(docs: DataFrame) -> DataFrame:
    """``docs`` (``task, prompt_id`` and a text) dealt by prompt, so that what
    is derived from a document lies together and its results need no shuffle
    of their own to be grouped or joined by prompt."""
    spark = docs.sparkSession
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // PROMPT_PARTITION_BYTES))
    return docs.repartition(n, "task", "prompt_id")


def prompts(spark: SparkSession, data_dir: str, with_prompts: bool = False, text: bool = True) -> DataFrame:
    """``text=False``: the master without ``base_text`` (and prompts), read
    from the narrow columns only, for constraint joins and key checks."""
    return _memo("prompts", spark, data_dir, with_prompts, text, build=lambda: _prompts(spark, data_dir, with_prompts, text))


def _prompts(spark: SparkSession, data_dir: str, with_prompts: bool = False, text: bool = True) -> DataFrame:
    """The prompt master: ``(task, prompt_id, title, base_text, format,
    char_count, keyword, prohibited_word, min_chars, max_chars,
    char_count_answer, keyword_answer, prohibited_word_answer)`` and, with
    ``with_prompts``, the four rendered ``prompt_{aspect}`` columns."""
    d = documents(spark, data_dir, ("doc_id", "text", "lang", "source") if text else ("doc_id", "lang", "source"))
    pid = F.col("doc_id")
    min_chars = (F.lit(250) * (pid % 5)).cast("int")
    kw = _by_lang(F.col("lang"), KEYWORD_BY_LANG)
    pw = _by_lang(F.col("lang"), PROHIBITED_BY_LANG)
    m = d.select(
        task_of(pid).alias("task"),
        pid.alias("prompt_id"),
        F.col("source").alias("title"),
        *([F.col("text").alias("base_text")] if text else []),
        min_chars.alias("min_chars"),
        (min_chars + 1500).alias("max_chars"),
        kw.alias("keyword_answer"),
        pw.alias("prohibited_word_answer"),
    )
    m = m.select(
        "*",
        F.lit(FORMAT_TEXT).alias("format"),
        F.concat(F.col("min_chars").cast("string"), F.lit("文字以上"), F.col("max_chars").cast("string"), F.lit("文字以下で出力してください。")).alias("char_count"),
        F.concat(F.lit("「"), F.col("keyword_answer"), F.lit("」という語を必ず使ってください。")).alias("keyword"),
        F.concat(F.lit("「"), F.col("prohibited_word_answer"), F.lit("」という語を使わないでください。")).alias("prohibited_word"),
        F.array(F.col("min_chars"), F.col("max_chars")).alias("char_count_answer"),
    )
    return with_prompt_columns(m) if (with_prompts and text) else m


def generated_models() -> list[tuple[int, str]]:
    return model_slice(REGISTRY, *GENERATED)


def base_texts(spark: SparkSession, data_dir: str) -> DataFrame:
    """``task, prompt_id, base_text`` of the prompts, dealt by prompt as
    ``results_by_prompt`` is."""
    d = read_table(spark, data_dir, "documents", ["doc_id", "text"])
    return _by_prompt(d.select(task_of(F.col("doc_id")).alias("task"), F.col("doc_id").alias("prompt_id"), F.col("text").alias("base_text")))


def results_by_prompt(spark: SparkSession, data_dir: str, iters: int = DEFAULT_ITERS) -> DataFrame:
    """``results``, dealt by ``task, prompt_id`` before a text is repeated: for
    queries that group or join whole texts by prompt."""
    return _memo("results_by_prompt", spark, data_dir, iters, build=lambda: _results_of(base_texts(spark, data_dir), iters))


def results(spark: SparkSession, data_dir: str, iters: int = DEFAULT_ITERS) -> DataFrame:
    return _memo("results", spark, data_dir, iters, build=lambda: _results(spark, data_dir, iters))


def result_keys(spark: SparkSession, data_dir: str, iters: int = DEFAULT_ITERS) -> DataFrame:
    """The keys of ``results`` only, from the narrow ``doc_id`` read."""
    return _memo("result_keys", spark, data_dir, iters, build=lambda: _results(spark, data_dir, iters, text=False))


def _results(spark: SparkSession, data_dir: str, iters: int = DEFAULT_ITERS, text: bool = True) -> DataFrame:
    """Generated and cleaned texts, long: one row per ``(task, model,
    prompt_id, aspect, iter)`` with ``raw_text`` and ``clean_text``.

    The fixture's model answers with the whole base text; ``h = (prompt_id+iter+model_idx) % 7``
    adds a header (h=0) or footer (h=1); the cleaner failed for h=6.
    """
    d = documents(spark, data_dir, ("doc_id", "text") if text else ("doc_id",))
    pid = F.col("doc_id")
    return _results_of(d.select(task_of(pid).alias("task"), pid.alias("prompt_id"), *([F.col("text").alias("base_text")] if text else [])), iters)


def _results_of(d: DataFrame, iters: int) -> DataFrame:
    """The results of ``task, prompt_id`` and, where texts are wanted,
    ``base_text``."""
    text = "base_text" in d.columns
    combos = F.expr(
        "array("
        + ", ".join(
            f"named_struct('m', {model_struct_sql(mi, mp)}, 'aspect', {sql_str(a)}, 'iter', {i})"
            for mi, mp in generated_models()
            for a in ASPECTS
            for i in range(iters)
        )
        + ")"
    )
    x = d.select("*", F.explode(combos).alias("c"))
    pid, it, midx = F.col("prompt_id"), F.col("c.iter"), F.col("c.m.model_idx")
    keys = [
        "task",
        F.col("c.m.model_idx").alias("model_idx"),
        F.col("c.m.model_path").alias("model_path"),
        F.col("c.m.model").alias("model"),
        "prompt_id",
        F.col("c.aspect").alias("aspect"),
        it.alias("iter"),
    ]
    if not text:
        return x.select(*keys)
    body = F.col("base_text")
    h = (pid + it + midx) % 7
    raw = F.when(h == 0, F.concat(F.lit(HEADER), body)).when(h == 1, F.concat(body, F.lit(FOOTER))).otherwise(body)
    clean = F.when(h == 6, F.lit(SENTINEL)).otherwise(body)
    return x.select(*keys, raw.alias("raw_text"), clean.alias("clean_text"))


def short_results(spark: SparkSession, data_dir: str) -> DataFrame:
    """``results`` of models that answer with a line naming the text's hash
    and everything a file format has to escape."""
    x = result_keys(spark, data_dir)
    d = documents(spark, data_dir, ("doc_id", "text")).select(F.col("doc_id").alias("prompt_id"), F.md5("text").alias("_md5"))
    raw = F.concat(F.lit('\t"{'), F.col("_md5"), F.lit("}\\\n要約\r'"), F.col("iter").cast("string"))
    return x.join(d, "prompt_id").select(*x.columns, raw.alias("raw_text"), F.when(F.col("iter") == 1, F.lit(SENTINEL)).otherwise(F.col("_md5")).alias("clean_text"))


def gappy_keys(spark: SparkSession, data_dir: str) -> DataFrame:
    """``result_keys`` as an interrupted run leaves them: single requests and
    whole prompts without a result, results given twice, and results of
    prompts that the master does not have."""
    x = result_keys(spark, data_dir)
    pid, it, midx = F.col("prompt_id"), F.col("iter"), F.col("model_idx")
    there = x.where(~(((pid * 7 + it * 3 + midx) % 11 == 0) | ((pid + midx) % 17 == 0)))
    orphans = x.where((pid % 13 == 0) & (it == 0)).withColumn("prompt_id", pid + 1_000_000_000)
    return there.unionByName(there.where(pid % 5 == 0)).unionByName(orphans)


def gappy_prompts(spark: SparkSession, data_dir: str) -> DataFrame:
    """The narrow master with prompts given twice and without a key."""
    m = prompts(spark, data_dir, text=False)
    pid = F.col("prompt_id")
    return m.unionByName(m.where(pid % 19 == 0)).unionByName(m.where(pid % 23 == 0).withColumn("prompt_id", F.lit(None).cast("long")))


def judge_answers(spark: SparkSession, data_dir: str, iters: int = DEFAULT_ITERS) -> DataFrame:
    return _memo("answers", spark, data_dir, iters, build=lambda: _judge_answers(spark, data_dir, iters))


def _judge_answers(spark: SparkSession, data_dir: str, iters: int = DEFAULT_ITERS) -> DataFrame:
    """What the judge model answers, per ``(task, prompt_id, iter)``: the
    first answer from the document's quality label (unlabelled documents
    get an unparseable answer), the fallback answer by a fixed rule."""
    from ..plans.joins import join_small

    d = documents(spark, data_dir, ("doc_id",))
    lab = spark.read.parquet(f"{data_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality")
    x = join_small(d, lab, "doc_id", "left")
    x = x.select("doc_id", "quality", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))).alias("iter"))
    pid, it = F.col("doc_id"), F.col("iter")
    first = (
        F.when(F.col("quality") == 1, F.when((pid + it) % 4 == 0, F.lit("適 切\n")).otherwise(F.lit("適切")))
        .when(F.col("quality") == 0, F.lit("不適切"))
        .otherwise(F.lit("適切です"))
    )
    r = (pid + it) % 5
    second = F.when(r < 2, F.lit(" True")).when(r < 4, F.lit("False"))
    # an answer with everything that a list literal must escape, and a plain one
    second = second.when((pid + it) % 10 == 4, F.lit("判定, \"でき'\\ま\rせん")).otherwise(F.lit("判定できません"))
    return x.select(
        task_of(pid).alias("task"), pid.alias("prompt_id"), it.cast("int").alias("iter"), first.alias("answer"), second.alias("answer_bool")
    )


def talkative_answers(spark: SparkSession, data_dir: str) -> DataFrame:
    """``judge_answers`` of a judge that, where it gives no label, answers
    with a text as long as a document (the prompt's own)."""
    x = judge_answers(spark, data_dir)
    d = documents(spark, data_dir, ("doc_id", "text")).select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("_said"))
    label = F.col("answer_bool").isin(" True", "False")
    said = F.when(label, F.col("answer_bool")).otherwise(F.concat(F.col("answer_bool"), F.lit("\\'\u3000\""), F.col("_said")))
    return x.join(d, "prompt_id").select("task", "prompt_id", "iter", "answer", said.alias("answer_bool"))
