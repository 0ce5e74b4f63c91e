"""Quality judging.

The judged table is long: one row per generated text with ``ok`` (boolean,
NULL when no answer parsed), ``raw`` (the kept answer when unparsed) and
``stage`` (``first``, ``fallback`` or ``unparsed``). Accuracy counts parsed
rows only, per ``(task, model, aspect, iter)``; All-Acc is the mean of the
per-iteration accuracies (a macro mean: their denominators may differ).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import delete_blank, fmt3, judge_bool_label, judge_label
from ..schemas import ASPECTS, DEFAULT_ITERS
from .scores import iter_pivot

JKEYS = ["task", "model", "prompt_id", "aspect", "iter"]


def parse_answers(df: DataFrame, first: str = "answer", second: str = "answer_bool") -> DataFrame:
    """F3-F6 on recorded answers: the first answer's label, else the
    fallback answer's label (only consulted when the first did not parse),
    else the fallback answer kept as raw text with blanks deleted."""
    l1 = judge_label(first)
    l2 = judge_bool_label(second)
    x = df.withColumns({"_l1": l1})
    x = x.withColumn("_l2", F.when(F.col("_l1").isNull(), l2))
    return x.withColumns(
        {
            "ok": F.coalesce(F.col("_l1"), F.col("_l2")),
            "stage": F.when(F.col("_l1").isNotNull(), F.lit("first"))
            .when(F.col("_l2").isNotNull(), F.lit("fallback"))
            .otherwise(F.lit("unparsed")),
            "raw": F.when(F.col("_l1").isNull() & F.col("_l2").isNull(), delete_blank(second)),
        }
    ).drop("_l1", "_l2")


def answer_key(dedupe: bool):
    """The key of a judge request: of the row, or (``dedupe``) of the task
    and both texts, on which alone the question depends."""
    return F.sha2(F.to_json(F.struct("task", "base_text", "text") if dedupe else F.struct(*JKEYS)), 256)


def row_key():
    """The key of a row, as its own keys in plain: unlike a hash they shrink to
    little where rows are kept or shuffled compressed."""
    return F.to_json(F.struct(*JKEYS))


def judge_requests(
    items: DataFrame, is_bool: bool = False, first: DataFrame | None = None, known: DataFrame | None = None, by_row: bool = False
) -> DataFrame:
    """``_k, model_path, prompt, system``: one request per key of ``items``;
    for the fallback question only where the ``first`` answer did not parse;
    none where ``known`` has an answer. Of rows that share a key one is chosen
    on fixed-width values before any text moves.

    ``by_row``: the key is ``row_key``, so every row is a request and none has to
    be chosen; ``task`` and ``prompt_id`` go with it, and ``first`` has them."""
    from ..plans.joins import asked_rows, named_rows
    from ..schemas import ASSISTANT_SYSTEM
    from .prompts import judge_prompt

    asked = None if first is None else first.where(judge_label("text").isNull())
    if by_row:
        picked = items if asked is None else asked_rows(items, asked.select("task", "prompt_id", "_k"))
    else:
        rows = items.withColumn("_row", F.xxhash64(*[F.col(c).cast("string") for c in JKEYS]))
        picked = named_rows(rows, known, None if asked is None else asked.select("_k"))
    prompt = judge_prompt("task", "text", "base_text", is_bool=is_bool)
    cols = ["_k", "task", "prompt_id"] if by_row else ["_k"]
    return picked.select(*cols, F.lit("judge").alias("model_path"), prompt.alias("prompt"), F.lit(ASSISTANT_SYSTEM).alias("system"))


def with_answers(items: DataFrame, first: DataFrame, second: DataFrame, by_row: bool = False) -> DataFrame:
    """The judged rows, from the answers (``_k, text, error``) to both questions;
    ``by_row`` as in ``judge_requests``."""
    from ..plans.joins import with_told

    x = items.select(*JKEYS, "_k")
    at = ["_k", "task", "prompt_id"] if by_row else ["_k"]
    named = lambda answers, text, error: answers.select(*at, F.col("text").alias(text), F.col("error").alias(error))
    both = [named(first, "answer", "error1"), named(second, "answer_bool", "error2")]
    if by_row:
        x = with_told(x, *both)
    else:
        for answers in both:
            x = x.join(answers, "_k", "left")
    return parse_answers(x.drop("_k"))


def judge_with_models(
    items: DataFrame, factory, policy=None, checkpoint: bool = True, skip_dead_letters: bool = False, dedupe: bool = False
) -> DataFrame:
    """ask the judge (``judge_prompt``) for every text; ask again
    with the True/False prompt only for the answers that did not parse.

    ``items``: ``task, model, prompt_id, aspect, iter, text, base_text``.
    Each call's output is checkpointed before it is used again. The
    sentinel text of a failed cleaning is judged like any text (Q8) unless
    ``skip_dead_letters``, which leaves those rows out.

    ``dedupe`` asks once per distinct ``(task, base_text, text)`` (the judge
    prompt depends on nothing else) and joins the answers back to every row
    on a SHA-256 key. Only for a deterministic judge: with sampling, each row
    of the benchmark gets its own answer.
    """
    from ..schemas import SENTINEL
    from .inference import run_model

    if skip_dead_letters:
        items = items.where(F.col("text") != F.lit(SENTINEL))
    items = items.withColumn("_k", answer_key(dedupe) if dedupe else row_key())
    answers = []
    for is_bool in (False, True):
        req = judge_requests(items, is_bool, first=answers[0] if answers else None, by_row=not dedupe)
        carry = [] if dedupe else ["task", "prompt_id"]
        answers.append(run_model(req, factory, policy=policy, keys=["_k"], carry=carry, request_cols=["system"], checkpoint=checkpoint, models=1))
    return with_answers(items, *answers, by_row=not dedupe)


def quality_scores(judged: DataFrame, **more: Column) -> DataFrame:
    """``n`` parsed answers, ``n_ok`` true ones, ``n_unparsed``,
    ``n_fallback`` and ``acc = n_ok / n`` (NULL when nothing parsed), with
    ``more`` aggregates of the same groups by name."""
    return (
        judged.groupBy("task", "model", "aspect", "iter")
        .agg(
            F.count("ok").alias("n"),
            F.count_if(F.col("ok")).alias("n_ok"),
            F.count_if(F.col("ok").isNull()).alias("n_unparsed"),
            F.count_if(F.col("stage") == "fallback").alias("n_fallback"),
            *[c.alias(name) for name, c in more.items()],
        )
        .withColumn("acc", F.try_divide(F.col("n_ok"), F.col("n")))
    )


def quality_all_acc(qs: DataFrame, iters: int = DEFAULT_ITERS) -> DataFrame:
    """F8: ``(acc0 + acc1 + acc2) / 3`` from unrounded accuracies."""
    p = iter_pivot(qs, "acc", iters=iters, prefix="acc")
    total = F.col("acc0")
    for i in range(1, iters):
        total = total + F.col(f"acc{i}")
    return p.select("task", "model", "aspect", (total / F.lit(iters)).alias("all_acc"))


def quality_report_lines(qs: DataFrame, data_num: DataFrame, iters: int = DEFAULT_ITERS) -> DataFrame:
    """the report of one task and model as numbered lines.

    ``data_num``: ``task, model, data_num`` (rows of the judged file).
    Layout: ``Model:``, ``Data Num:``, then per aspect a ``【{a}_wo_hf】``
    header, one ``iterN-Acc: 0.000 (k / n)`` line per iteration, the
    ``All-Acc`` line and a blank line.
    """
    per = iter_pivot(qs.withColumn("v", F.struct("acc", "n_ok", "n")), "v", iters=iters, prefix="v")
    total = F.col("v0.acc")
    for i in range(1, iters):
        total = total + F.col(f"v{i}.acc")
    block = 2 + iters + 1  # header, iterations, All-Acc, blank
    order = F.create_map(*[x for i, a in enumerate(ASPECTS) for x in (F.lit(a), F.lit(i))])
    lines = [F.concat(F.lit("【"), F.col("aspect"), F.lit("_wo_hf】"))]
    for i in range(iters):
        v = F.col(f"v{i}")
        lines.append(
            F.concat(F.lit(f"iter{i}-Acc: "), fmt3(v["acc"]), F.lit(" ("), v["n_ok"].cast("string"), F.lit(" / "), v["n"].cast("string"), F.lit(")"))
        )
    lines.append(F.concat(F.lit("All-Acc: "), fmt3(total / F.lit(iters))))
    lines.append(F.lit(""))
    # lines as columns first: a generator may not hold the SQL function of fmt3
    named = per.select("task", "model", (F.lit(2) + order[F.col("aspect")] * block).alias("base"), *[x.alias(f"_l{j}") for j, x in enumerate(lines)])
    body = named.select(
        "task", "model", "base", F.posexplode(F.array(*[F.col(f"_l{j}") for j in range(len(lines))])).alias("pos", "line")
    ).select("task", "model", (F.col("base") + F.col("pos")).alias("line_no"), "line")
    head = data_num.select(
        "task",
        "model",
        F.posexplode(F.array(F.concat(F.lit("Model: "), F.col("model")), F.concat(F.lit("Data Num: "), F.col("data_num").cast("string")))).alias("line_no", "line"),
    )
    return head.unionByName(body)


def _quoted(text):
    """Backslashes, quotes and line ends as a list literal escapes them."""
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def bool_list_cells(judged: DataFrame) -> DataFrame:
    """one list-literal cell per text and aspect, as the benchmark's
    judge CSV holds it: ``[True, False, '判定できません']`` (iteration
    order; a kept raw answer is quoted). Groups are one text's iterations."""
    elem = (
        F.when(F.col("ok"), F.lit("True"))
        .when(~F.col("ok"), F.lit("False"))
        .otherwise(F.concat(F.lit("'"), _quoted(F.coalesce(F.col("raw"), F.lit(""))), F.lit("'")))
    )
    g = judged.groupBy("task", "model", "prompt_id", "aspect").agg(F.array_sort(F.collect_list(F.struct("iter", elem.alias("e")))).alias("xs"))
    return g.select("task", "model", "prompt_id", "aspect", F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["e"]), ", "), F.lit("]")).alias("cell"))


def judge_table(judged: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """the judge file, one row per prompt and model: ``prompt_id``,
    ``model`` and one list-literal column ``{aspect}_wo_hf`` per aspect (plus
    ``generated_text_id`` when ``ids`` gives it). Built from ``bool_list_cells``
    by a pivot over the four aspects (groups of one prompt)."""
    cells = bool_list_cells(judged)
    wide = cells.groupBy("task", "model", "prompt_id").pivot("aspect", ASPECTS).agg(F.first("cell"))
    wide = wide.select("task", "model", "prompt_id", *[F.col(f"`{a}`").alias(f"{a}_wo_hf") for a in ASPECTS])
    if ids is not None:
        wide = wide.join(ids.select("task", "model", "prompt_id", "generated_text_id"), ["task", "model", "prompt_id"], "left")
    return wide
