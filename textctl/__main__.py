"""Command line for the five stages, with the benchmark's options.

    python -m textctl generate --factory mymodels:factory [--task summary] [--model_start_index 0 --model_num 2]
    python -m textctl clean [--cleaner mymodels:cleaner]      # default: the rule cleaner
    python -m textctl score-control
    python -m textctl score-quality --judge mymodels:judge
    python -m textctl leaderboard
    python -m textctl all --factory mymodels:factory --judge mymodels:judge

Every stage runs all tasks and models asked for (``--task``, the model
slice) in one Spark job and leaves the files of others as they are. Models come from the
registry (``MODEL_PATH_0..n`` in the environment); a model is a factory
``module:function`` that takes a model path and returns a callable
``list[str] -> list[str]``. Locally, ``python -m textctl`` starts its own
session; on a cluster, the submitted script calls ``main(argv)``, and the
session it gets is the cluster's.
"""

from __future__ import annotations

import argparse
import importlib
import os

from .schemas import DEFAULT_ITERS, TASKS

STAGES = ["generate", "clean", "score-control", "score-quality", "leaderboard"]


def load(spec: str | None):
    """``module:function`` -> the function (None stays None)."""
    if not spec:
        return None
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"expected module:function, got {spec!r}")
    return getattr(importlib.import_module(module), name)


def parser() -> argparse.ArgumentParser:
    version = os.environ.get("VERSION", "1")
    p = argparse.ArgumentParser(prog="python -m textctl", description="Controlled text generation evaluation on Spark.")
    p.add_argument("stage", choices=[*STAGES, "all"])
    p.add_argument("--master_path", default="datasets", help="folder with one sub-folder of prompts per task")
    p.add_argument("--master_file", default=f"prompts_v{version}.jsonl")
    p.add_argument("--task", action="append", choices=TASKS, help="task to run (repeat for several; default: all)")
    p.add_argument("--master", help="glob of the prompt files (instead of master_path/task/master_file)")
    p.add_argument("--output_path", default="output")
    p.add_argument("--model_start_index", type=int)
    p.add_argument("--model_num", type=int)
    p.add_argument("--iter_num", type=int, default=DEFAULT_ITERS)
    p.add_argument("--use-system-prompt", dest="use_system_prompt", action="store_true")
    p.add_argument("--no-use-system-prompt", dest="use_system_prompt", action="store_false")
    p.set_defaults(use_system_prompt=True)
    p.add_argument("--factory", help="generation model factory, module:function")
    p.add_argument("--cleaner", help="cleaning model factory, module:function (default: rule cleaner)")
    p.add_argument("--judge", help="judge model factory, module:function")
    p.add_argument("--judge-dedupe", dest="judge_dedupe", action="store_true", help="one judge call per distinct text (deterministic judges)")
    p.add_argument("--resume", action="store_true", help="ask models only for what has no stored answer")
    p.add_argument("--strict", action="store_true", help="stop when lines of the prompt master do not parse")
    p.add_argument("--partitions", type=int, help="tasks that call models (default: as the input is split)")
    p.add_argument("--commit-every", dest="commit_every", type=int, help="requests per task: a task's answers are kept the moment it ends")
    p.add_argument("--lenient", action="store_true", help="leaderboard: leave out models with incomplete reports")
    return p


def main(argv: list[str] | None = None) -> None:
    from .plans import jobs
    from .session import get_session
    from .sources.registry import model_slice, registry_paths

    a = parser().parse_args(argv)
    stages = STAGES if a.stage == "all" else [a.stage]
    tasks = a.task or list(TASKS)
    task_glob = tasks[0] if len(tasks) == 1 else "{" + ",".join(tasks) + "}"
    master = a.master or f"{a.master_path.rstrip('/')}/{task_glob}/{a.master_file}"
    models = model_slice(registry_paths(), a.model_start_index, a.model_num)
    if "generate" in stages and not a.factory:
        raise SystemExit("generate needs --factory module:function")
    if "score-quality" in stages and not a.judge:
        raise SystemExit("score-quality needs --judge module:function")

    spark = get_session("textctl")
    out = a.output_path
    for stage in stages:
        if stage == "generate":
            jobs.generate(spark, master, out, load(a.factory), models=models, iters=a.iter_num, use_system=a.use_system_prompt, resume=a.resume, strict=a.strict, partitions=a.partitions, commit_every=a.commit_every)
        elif stage == "clean":
            jobs.clean(spark, out, factory=load(a.cleaner), tasks=a.task, models=models, resume=a.resume, partitions=a.partitions, commit_every=a.commit_every)
        elif stage == "score-control":
            jobs.score_control(spark, master, out, tasks=a.task, models=models, strict=a.strict)
        elif stage == "score-quality":
            jobs.score_quality(spark, master, out, load(a.judge), dedupe=a.judge_dedupe, tasks=a.task, models=models, iters=a.iter_num, resume=a.resume, strict=a.strict, partitions=a.partitions, commit_every=a.commit_every)
        elif stage == "leaderboard":
            jobs.leaderboard(spark, out, strict=not a.lenient, models=models, tasks=a.task, iters=a.iter_num)


if __name__ == "__main__":
    main()
