"""Header/footer removal.

``rule_clean`` is the offline cleaner: the opening and closing phrases that
the benchmark's cleaning prompts name are removed when they stand at the
very start or end of the text (with the blanks around them); the middle is
never touched, brackets are kept. It is written with ``ltrim``/``rtrim``
of the blank set and ``startswith``/``endswith``, so each text is scanned
once, with no regex backtracking; only a phrase with a free part uses an
anchored regex, and only after a cheap ``endswith`` test passed.

``model_clean`` runs a cleaning model over ``clean_prompt`` requests (D1),
after removing duplicate texts so that a text repeated many times is paid
for once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BLANKS, SENTINEL

# --- Fixed values: phrases named by the cleaning prompts, per task. ---
OPENING = {
    "summary": ["以下の文章を要約します。", "【要約】"],
    "ad_text": ["広告文：", "広告文を作成します"],
    "pros_and_cons": ["そこで、メリットとデメリットをご紹介いたします。", "あなたのご質問にお答えいたします。"],
}
CLOSING = {
    "summary": ["以上が要約結果になります。"],
    "ad_text": ["作成しました。"],
    "pros_and_cons": [],
}
# Closing sentences with a free subject: (fixed tail, anchored regex).
CLOSING_PATTERN = {
    "pros_and_cons": [("に関するメリット・デメリットです。", "以上が[^\\n]*に関するメリット・デメリットです。")],
}
# --- end of fixed values ---

_BL_CLASS = "[ 　\\n\\t]*"


def _strip_opening(t: Column, phrases: list[str]) -> Column:
    if not phrases:
        return t
    lt = F.ltrim(t, F.lit(BLANKS))
    out = t
    for p in reversed(phrases):  # first listed phrase wins, as in an alternation
        out = F.when(lt.startswith(p), F.ltrim(lt.substr(F.lit(len(p) + 1), F.length(lt)), F.lit(BLANKS))).otherwise(out)
    return out


def _strip_closing(t: Column, phrases: list[str], patterns: list[tuple[str, str]]) -> Column:
    if not phrases and not patterns:
        return t
    rt = F.rtrim(t, F.lit(BLANKS))
    out = t
    for tail, rx in reversed(patterns):
        out = F.when(rt.endswith(tail), F.regexp_replace(t, f"{_BL_CLASS}{rx}{_BL_CLASS}\\z", "")).otherwise(out)
    for p in reversed(phrases):
        out = F.when(rt.endswith(p), F.rtrim(rt.substr(F.lit(1), F.length(rt) - len(p)), F.lit(BLANKS))).otherwise(out)
    return out


def rule_clean(task, text) -> Column:
    """Opening then closing phrase removal, per task; other tasks and
    the sentinel are returned unchanged."""
    t = F.col(text) if isinstance(text, str) else text
    k = F.col(task) if isinstance(task, str) else task
    out = t
    for name in OPENING:
        opened = _strip_opening(t, OPENING[name])
        branch = _strip_closing(opened, CLOSING.get(name, []), CLOSING_PATTERN.get(name, []))
        out = F.when(k == name, branch).otherwise(out)
    return F.when(t == F.lit(SENTINEL), t).otherwise(out)


def rule_patterns() -> dict[str, tuple[str | None, str | None]]:
    """The same rules as anchored regexes ``(opening, closing)`` per task
    (used by the Python stand-in cleaner and the SQL oracle)."""
    out = {}
    for name in OPENING:
        op = OPENING[name]
        cl = list(CLOSING.get(name, [])) + [rx for _, rx in CLOSING_PATTERN.get(name, [])]
        o = f"\\A{_BL_CLASS}(?:{'|'.join(op)}){_BL_CLASS}" if op else None
        c = f"{_BL_CLASS}(?:{'|'.join(cl)}){_BL_CLASS}\\z" if cl else None
        out[name] = (o, c)
    return out


def clean_rules(results: DataFrame, out: str = "clean_text") -> DataFrame:
    """D2 over a long table with ``task, raw_text``."""
    return results.withColumn(out, rule_clean("task", "raw_text"))


def text_key() -> Column:
    """The key of a cleaning request: a SHA-256 of ``task`` and ``raw_text``."""
    return F.sha2(F.concat_ws("\u0000", F.col("task"), F.col("raw_text")), 256)


def clean_requests(keyed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``_k, model_path, prompt, system``: one request per distinct ``_k``
    without an answer in ``known``. Which row of a key is asked for is chosen
    on fixed-width values (the smallest hash of the row's own keys), so the
    distinct step aggregates numbers; the text is then fetched by that row."""
    from ..schemas import ASSISTANT_SYSTEM
    from ..plans.joins import named_rows
    from .prompts import clean_prompt

    own = F.xxhash64("model", F.col("prompt_id").cast("string"), "aspect", "iter")
    picked = named_rows(keyed.select("_k", "task", "prompt_id", "raw_text", own.alias("_row")), known)
    return picked.select("_k", F.lit("cleaner").alias("model_path"), clean_prompt("task", "raw_text").alias("prompt"), F.lit(ASSISTANT_SYSTEM).alias("system"))


def with_answers(keyed: DataFrame, answers: DataFrame) -> DataFrame:
    """``clean_text`` (the sentinel after a failed call) and ``clean_error``."""
    ans = answers.select("_k", "text", F.col("error").alias("clean_error"))
    merged = keyed.drop("clean_text", "clean_error").join(ans, "_k", "left")
    return merged.withColumn("clean_text", F.when(F.col("clean_error").isNotNull(), F.lit(SENTINEL)).otherwise(F.col("text"))).drop("_k", "text")


def model_clean(results: DataFrame, factory, policy=None, dedupe: bool = True, checkpoint: bool = True) -> DataFrame:
    """Ask a cleaning model for each raw text (``clean_prompt``).

    With ``dedupe`` the distinct ``(task, raw_text)`` pairs are sent once,
    keyed by a SHA-256 of the pair, and the answers joined back on that key.
    Without it every row is a request. A failed call gives the sentinel text
    and keeps its error.
    """
    from .inference import run_model

    keyed = results.withColumn("_k", text_key())
    if not dedupe:
        keyed = keyed.withColumn("_k", F.sha2(F.concat_ws("\u0000", "_k", "model", F.col("prompt_id").cast("string"), "aspect", F.col("iter").cast("string")), 256))
    done = run_model(clean_requests(keyed), factory, policy=policy, keys=["_k"], request_cols=["system"], checkpoint=checkpoint, models=1)
    return with_answers(keyed, done).withColumnRenamed("clean_error", "error")


class RuleCleanerModel:
    """Stand-in cleaning model: takes the text out of a ``clean_prompt`` and
    applies the same anchored rules as ``rule_clean`` (Python ``re``)."""

    def __init__(self):
        import re

        self.rx = {}
        for task, (o, c) in rule_patterns().items():
            self.rx[task] = (re.compile(o.replace("\\z", "\\Z")) if o else None, re.compile(c.replace("\\z", "\\Z")) if c else None)
        from .prompts import CLEAN_PROMPTS

        self.heads = {t: tpl.split("{generated_result}")[0] for t, tpl in CLEAN_PROMPTS.items()}

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            for task, head in self.heads.items():
                if p.startswith(head):
                    text = p[len(head):-1]  # the template ends with one newline
                    o, c = self.rx[task]
                    if text != SENTINEL:
                        if o is not None:
                            text = o.sub("", text, count=1)
                        if c is not None:
                            text = c.sub("", text, count=1)
                    out.append(text)
                    break
            else:
                out.append(p)
        return out


def rule_cleaner_factory(model_path: str):
    return RuleCleanerModel()
