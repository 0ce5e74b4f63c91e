"""Incremental control scoring with Structured Streaming.

Generation writes results batch after batch (the benchmark rewrites its
result file after each aspect). ``stream_ctg_counts`` reads the results
folder as a file stream, applies the same validity expressions (a
stream-static join with the constraint table, size-checked broadcast) and
keeps running counts per ``(task, model, aspect, iter)``; the per-row work
is stateless, the only state is one count triple per group. The query's
progress is kept in a checkpoint folder, so a restarted query resumes
after the last committed file, and the scores equal the batch result over
the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validity import with_validity

RESULTS_LONG = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("model_path", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("prompt_id", T.LongType()),
        T.StructField("aspect", T.StringType()),
        T.StructField("iter", T.IntegerType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("clean_text", T.StringType()),
    ]
)


def read_results_stream(spark: SparkSession, path: str, schema: T.StructType = RESULTS_LONG, max_files: int = 64) -> DataFrame:
    """Long results arriving as parquet files under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_ctg_counts(results_stream: DataFrame, master: DataFrame) -> DataFrame:
    """Running ``n, n_valid, n_undecided, score`` per group (complete or
    update output mode)."""
    v = with_validity(results_stream, master)
    return (
        v.groupBy("task", "model", "aspect", "iter")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("is_valid")).alias("n_valid"),
            F.count_if(F.col("is_valid").isNull()).alias("n_undecided"),
        )
        .withColumn("score", F.try_divide(F.col("n_valid"), F.col("n")))
    )


def start_ctg_counts(spark: SparkSession, results_path: str, master: DataFrame, sink_path: str, checkpoint: str, trigger_once: bool = True):
    """Run the counts into a parquet table rewritten per micro-batch
    (``foreachBatch``, complete mode), with progress in ``checkpoint``."""
    counts = stream_ctg_counts(read_results_stream(spark, results_path), master)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(sink_path)

    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
