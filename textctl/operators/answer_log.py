"""Paid answers as an append-only log.

A stage that calls a model appends its answers to a folder, and every task
commits its own: its files appear in the folder the moment the task ends, not
when the stage does. A stage that is killed, or fails in one task, keeps the
answers of all tasks that had ended; a restart asks only for what is not in
the log. ``spread`` deals requests into tasks of at most ``every``, so that
is also the most a task that dies can lose. A callable that must stop
(``inference.StopCalls``) loses nothing: its task ends early with what it has.

Nothing that was paid for is overwritten. A run that starts anew writes which
folders (task, model) it starts anew, and ``visible`` leaves out what
earlier runs answered there. Rows carry their ``run``; runs are numbered by
the time they start.

The commit per task is Spark's own file writer with the committer that moves
a task's files when the task commits (a task commits once, the driver sees to
that). It needs a file system with a rename for files; partial tasks leave
nothing behind. A folder may hold the files of a stage that did not end, so
it has no ``_SUCCESS`` file to wait for: it is read as a log.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TASK_COMMIT = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def new_run() -> str:
    return f"{time.time_ns():020d}"


def _starts(path: str) -> str:
    return f"{path.rstrip('/')}_runs"


def start_anew(scope: DataFrame, path: str, run: str) -> None:
    """Declares that ``run`` answers the (task, model) of ``scope`` anew."""
    scope.select("task", "model", F.lit(run).alias("run")).coalesce(1).write.mode("append").json(_starts(path))


def spread(requests: DataFrame, every: int | None, keys: list[str]) -> DataFrame:
    """``requests`` dealt into tasks of about ``every`` rows each; as they
    are where ``every`` is None."""
    if not every:
        return requests
    n = requests.select(*keys).count()
    return requests.repartition(max(1, math.ceil(n / every)), *keys)


def append(answers: DataFrame, path: str, run: str, by=()) -> None:
    """Adds answers to the log, a task at a time."""
    w = answers.withColumn("run", F.lit(run)).write.mode("append").option(*TASK_COMMIT)
    (w.partitionBy(*by) if by else w).parquet(path)


def visible(spark: SparkSession, path: str) -> DataFrame:
    """The log without what a later run started anew. The starts have a row
    per run, task and model: configuration, whatever the number of answers."""
    rows = spark.read.parquet(path)
    if not exists(spark, _starts(path)):
        return rows
    since = spark.read.schema("task string, model string, run string").json(_starts(path)).groupBy("task", "model").agg(F.max("run").alias("_since"))
    rows = rows.join(F.broadcast(since), ["task", "model"], "left")
    return rows.where(F.col("_since").isNull() | (F.col("run") >= F.col("_since"))).drop("_since")


def successes(spark: SparkSession, path: str) -> DataFrame:
    return visible(spark, path).where(F.col("error").isNull())


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """One row per key: the successful answer, else the last error. Only
    failed requests are compared over runs; a success is asked once."""
    rows = visible(spark, path)
    good = rows.where(F.col("error").isNull())
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("run")))
    bad = rows.where(F.col("error").isNotNull()).withColumn("_n", last).where("_n = 1").drop("_n")
    return good.unionByName(bad.join(good.select(*keys), keys, "left_anti")).drop("run")


def newest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One answer per key of a log whose keys may be asked again: of the last
    run that succeeded, else the last error. The rows of a key are as many
    as the runs that asked it."""
    best = F.max_by(F.struct("*"), F.struct(F.col("error").isNull(), "run"))
    return spark.read.parquet(path).groupBy(key).agg(best.alias("_r")).select("_r.*").drop("run")
