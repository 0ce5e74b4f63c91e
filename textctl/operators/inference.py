"""Batch inference over rows.

``run_model`` is the one place where Python runs per row: requests keep
the partitioning they come with (no shuffle of prompt texts) and are handed
to ``mapInPandas`` in Arrow batches, so a model holding a third of all
requests is spread over all the tasks that hold them. Requests of more models
than stay loaded (``models`` unknown or above ``_MAX_LOADED``) are sorted by
model inside each partition; of fewer, every batch is dealt to the loaded
models as it comes, and no prompt is kept to be sorted. An explicit ``partitions=n`` hash partitions the
requests on their keys: as many tasks as asked for get work, whatever the
number of models. The model callable is built by ``factory(model_path)``
once per Python worker process (workers are reused across tasks).

A callable answers a list of prompts with a list of the same length; an
element is the text, or an exception for that prompt alone. Prompts are sent
in sub-batches of ``policy.batch``; only prompts that failed are asked
again, after a back-off, until ``policy.max_attempts``. Where the callable
raises for a whole sub-batch, its prompts are asked one by one. Errors that
are not retryable, or retries exhausted, become dead letters with ``text``
NULL. A callable with a true attribute ``takes_requests`` gets dictionaries
(``prompt`` and the ``request_cols``: system message, messages, parameters)
instead of prompts.

``checkpoint=True`` writes the result to the session's checkpoint folder, so
that a later action never calls the model again; a job that writes the
result once itself passes False and reads its own table. A task retry may
repeat calls of that task, never results: keys stay unique.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ASPECTS, DEFAULT_ITERS
from ..sources.registry import model_struct_sql, sql_str, suffix_py
from .prompts import task_prompt


class StopCalls(Exception):
    """Raised by a model callable when no further call may be made (a spent
    quota, a shutdown). The task asks nothing more and ends with the answers
    it has; requests without an answer give no row and stay pending."""


class RetryableError(Exception):
    """Raised by a model callable for a failure worth retrying (rate limit)."""


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 5
    backoff_s: float = 1.0
    max_backoff_s: float = 60.0
    retry_on: tuple = field(default=(RetryableError,))
    batch: int = 64

    def delay(self, attempt: int) -> float:
        return min(self.max_backoff_s, self.backoff_s * (2 ** (attempt - 1)))


NO_WAIT = RetryPolicy(max_attempts=3, backoff_s=0.0, max_backoff_s=0.0)


def _ask(model: Callable, prompts: list) -> list:
    """One call: a text or an exception per prompt."""
    out = list(model(prompts))
    if len(out) != len(prompts):
        raise ValueError("model returned a different number of texts")
    return out


def _answer(model: Callable, prompts: list, policy: RetryPolicy):
    """Texts, errors and attempts of one sub-batch. A prompt's attempts count
    the calls it was part of; 0 if the callable stopped before it."""
    texts, errors, attempts = [None] * len(prompts), [None] * len(prompts), [0] * len(prompts)
    open_, alone = list(range(len(prompts))), False
    for attempt in range(1, policy.max_attempts + 1):
        if attempt > 1 and (delay := policy.delay(attempt - 1)) > 0:
            time.sleep(delay)
        failed = []
        for part in [[i] for i in open_] if alone else [open_]:
            try:
                out = _ask(model, [prompts[i] for i in part])
            except StopCalls:
                return texts, errors, attempts
            except Exception as e:  # noqa: BLE001 - kept as the prompts' error
                out = [e] * len(part)
                if len(part) > 1:  # whose fault it was is not known: each may try again
                    out, alone = [policy.retry_on[0](f"{type(e).__name__}: {e}") if policy.retry_on else e] * len(part), True
            for i, answer in zip(part, out):
                attempts[i] += 1
                if not isinstance(answer, BaseException):
                    texts[i], errors[i] = answer, None
                else:
                    errors[i] = f"{type(answer).__name__}: {answer}"
                    if isinstance(answer, policy.retry_on):
                        failed.append(i)
        open_ = failed
        if not open_:
            break
    return texts, errors, attempts


_LOADED: OrderedDict = OrderedDict()
_MAX_LOADED = 4


def _model(factory, model_path):
    """Models built by ``factory`` stay loaded in the Python worker process
    (workers are reused across tasks), so each is built once per worker. The
    key is the factory object: a module-level factory is the same object in
    every task of the worker; a closure is a new object per task, so it is
    built per task and never shared by mistake. At most ``_MAX_LOADED``
    models are kept (least recently used goes)."""
    key = (factory, model_path)
    m = _LOADED.get(key)
    if m is None:
        m = _LOADED[key] = factory(model_path)
        while len(_LOADED) > _MAX_LOADED:
            _LOADED.popitem(last=False)
    else:
        _LOADED.move_to_end(key)
    return m


def run_model(
    requests: DataFrame,
    factory: Callable[[str], Callable[[list[str]], list[str]]],
    policy: RetryPolicy | None = None,
    keys: list[str] | None = None,
    model_col: str = "model_path",
    prompt_col: str = "prompt",
    carry: list[str] | tuple = (),
    strip_echo: bool = False,
    partitions: int | None = None,
    request_cols: list[str] | tuple = (),
    checkpoint: bool = True,
    models: int | None = None,
) -> DataFrame:
    """``keys + model + carry + text, error, attempts`` per request.

    ``strip_echo`` removes the prompt from the start of an answer that
    repeats it (B10, for completion models that echo their input).
    ``models`` is the number of models the requests name, if known.
    """
    policy = policy or RetryPolicy()
    keys = list(keys or [c for c in requests.columns if c not in (prompt_col, model_col)])
    out_cols = list(dict.fromkeys([*keys, model_col, *carry]))
    extra = [c for c in request_cols if c not in out_cols]
    in_schema = requests.select(*out_cols).schema
    out_schema = T.StructType(
        in_schema.fields
        + [
            T.StructField("text", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("attempts", T.IntegerType()),
        ]
    )
    staged = requests.select(*out_cols, *extra, prompt_col)
    if partitions:
        staged = staged.repartition(partitions, *[F.col(k) for k in keys])
    if models is None or models > _MAX_LOADED:
        staged = staged.sortWithinPartitions(model_col)

    def fn(batches):
        stopped = False
        for pdf in batches:
            if pdf.empty or stopped:
                continue
            parts = []
            for mp, g in pdf.groupby(model_col, sort=False):
                model = _model(factory, mp)
                prompts = g[prompt_col].tolist()
                asked = prompts
                if getattr(model, "takes_requests", False):
                    asked = [{"prompt": p, **r} for p, r in zip(prompts, g[list(request_cols)].to_dict("records"))]
                texts, errors, attempts = [], [], []
                for at in range(0, len(asked), policy.batch):
                    for whole, part in zip((texts, errors, attempts), _answer(model, asked[at : at + policy.batch], policy)):
                        whole.extend(part)
                    if stopped := not all(attempts):
                        break
                if stopped:  # only what was asked becomes rows
                    asked = [n > 0 for n in attempts]
                    g = g.iloc[: len(asked)][asked]
                    texts, errors, attempts, prompts = ([x for x, ok in zip(column, asked) if ok] for column in (texts, errors, attempts, prompts))
                if strip_echo:
                    texts = [t[len(p):] if (t is not None and p is not None and t.startswith(p)) else t for t, p in zip(texts, prompts)]
                o = g[out_cols].copy()
                o["text"] = pd.Series(texts, index=g.index, dtype=object)
                o["error"] = pd.Series(errors, index=g.index, dtype=object)
                o["attempts"] = pd.Series(attempts, index=g.index, dtype="int32")
                parts.append(o)
                if stopped:
                    break
            yield pd.concat(parts)

    out = staged.mapInPandas(fn, out_schema)
    return out.checkpoint(eager=True) if checkpoint else out


def dead_letters(done: DataFrame) -> DataFrame:
    """C4: requests that failed for good."""
    return done.where(F.col("error").isNotNull())


def errors_as_text(done: DataFrame, sentinel: str | None = None) -> DataFrame:
    """The benchmark's way to keep failures in the text column: the
    sentinel text when given, else the error text itself."""
    fill = F.lit(sentinel) if sentinel is not None else F.col("error")
    return done.withColumn("text", F.when(F.col("error").isNotNull(), fill).otherwise(F.col("text")))


def generation_requests(master: DataFrame, models: list[tuple[int, str]], iters: int = DEFAULT_ITERS, aspects=ASPECTS) -> DataFrame:
    """Every prompt x aspect x iteration x model, with the prompt text
    of the aspect (``prompt_{aspect}``). The fan-out is one ``explode`` of a
    literal array (models x aspects x iterations), no join."""
    per_aspect = F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(f"prompt_{a}").alias("prompt")) for a in aspects])
    combos = F.expr(
        "array(" + ", ".join(f"named_struct('m', {model_struct_sql(mi, path)}, 'iter', {it})" for mi, path in models for it in range(iters)) + ")"
    )
    x = master.select("task", "prompt_id", F.explode(per_aspect).alias("p"))
    x = x.select("task", "prompt_id", "p.aspect", "p.prompt", F.explode(combos).alias("c"))
    return x.select(
        "task",
        F.col("c.m.model_idx").alias("model_idx"),
        F.col("c.m.model_path").alias("model_path"),
        F.col("c.m.model").alias("model"),
        "prompt_id",
        "aspect",
        F.col("c.iter").alias("iter"),
        "prompt",
    )


def pending(requests: DataFrame, finished: DataFrame, keys=("task", "model", "prompt_id", "aspect", "iter")) -> DataFrame:
    """Requests with no finished result yet (restart after a failure).
    Anti join on keys only; run the pending ones and append."""
    return requests.join(finished.select(*keys).dropDuplicates(list(keys)), list(keys), "left_anti")


def request_keys(master: DataFrame, models: list[tuple[int, str]], iters: int = DEFAULT_ITERS, aspects=ASPECTS) -> DataFrame:
    """The keys of ``generation_requests`` without any text: the same
    fan-out over ``task, prompt_id`` alone."""
    combos = F.expr(
        "array("
        + ", ".join(
            f"named_struct('m', {model_struct_sql(mi, path)}, 'aspect', '{a}', 'iter', {it})"
            for mi, path in models
            for a in aspects
            for it in range(iters)
        )
        + ")"
    )
    x = master.select("task", "prompt_id", F.explode(combos).alias("c"))
    return x.select("task", F.col("c.m.model").alias("model"), "prompt_id", F.col("c.aspect").alias("aspect"), F.col("c.iter").alias("iter"))


def pending_requests(
    master: DataFrame, models: list[tuple[int, str]], finished: DataFrame, iters: int = DEFAULT_ITERS, aspects=ASPECTS
) -> DataFrame:
    """C8 for a restart: the rows of ``generation_requests`` that have no
    finished result, found on keys alone. The anti join runs on request
    keys; only then is each pending request joined with its prompt row and
    the aspect's ``prompt_{aspect}`` picked, so one copy of a prompt's text
    crosses that join instead of every rendered request."""
    keys = ["task", "model", "prompt_id", "aspect", "iter"]
    open_keys = pending(request_keys(master.select("task", "prompt_id").distinct(), models, iters, aspects), finished, keys)
    return with_prompt(open_keys, master, models, aspects)


def with_prompt(open_keys: DataFrame, master: DataFrame, models: list[tuple[int, str]], aspects=ASPECTS) -> DataFrame:
    """The rows of ``generation_requests`` of some request keys: each joined
    with its prompt row, the aspect's ``prompt_{aspect}`` picked. A master
    without these columns gives its base text and constraints, and the prompt
    is rendered after the join: the text crosses it once, not per aspect."""
    rendered = all(f"prompt_{a}" in master.columns for a in aspects)
    registry = F.expr("map(" + ", ".join(f"{sql_str(suffix_py(path))}, {model_struct_sql(mi, path)}" for mi, path in models) + ")")
    prompt = None
    for a in aspects:
        own = F.col(f"prompt_{a}") if rendered else task_prompt("task", F.col(a).cast("string"), "base_text")
        prompt = F.when(F.col("aspect") == a, own) if prompt is None else prompt.when(F.col("aspect") == a, own)
    cols = [f"prompt_{a}" for a in aspects] if rendered else ["base_text", *aspects]
    rows = open_keys.join(master.select("task", "prompt_id", *cols), ["task", "prompt_id"], "inner")
    m = registry[F.col("model")]
    return rows.select(
        "task",
        m["model_idx"].alias("model_idx"),
        m["model_path"].alias("model_path"),
        "model",
        "prompt_id",
        "aspect",
        "iter",
        prompt.alias("prompt"),
    )


# ---- deterministic stand-in models (tests, offline runs) ----


class EchoModel:
    """Answers with the prompt followed by a line giving its length, like a
    completion model that repeats its input (C2 stand-in)."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [p + "\n応答(" + str(len(p)) + ")" for p in prompts]


def echo_factory(model_path: str) -> Callable:
    return EchoModel()


class FlakyModel:
    """Fails on every attempt for prompts whose length is a multiple of
    ``bad``, fails once on multiples of ``flaky``; else answers
    ``ok:<length>``. Both failures are retryable."""

    def __init__(self, bad: int = 11, flaky: int = 5):
        self.bad, self.flaky, self.seen = bad, flaky, set()

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            if len(p) % self.bad == 0:
                raise RetryableError("overloaded")
            if len(p) % self.flaky == 0 and p not in self.seen:
                self.seen.add(p)
                raise RetryableError("rate limited")
            out.append("ok:" + str(len(p)))
        return out


def flaky_factory(model_path: str) -> Callable:
    return FlakyModel()


class LengthModel:
    """Answers ``ok:<length>``; with ``most``, that many prompts per worker,
    then no call may be made any more."""

    def __init__(self, most: int | None = None):
        self.left = most

    def __call__(self, prompts: list[str]) -> list[str]:
        if self.left is not None:
            if self.left < len(prompts):
                raise StopCalls("quota")
            self.left -= len(prompts)
        return ["ok:" + str(len(p)) for p in prompts]


def length_factory(model_path: str) -> Callable:
    return LengthModel()


def quota_factory(model_path: str) -> Callable:
    return LengthModel(most=1000)
