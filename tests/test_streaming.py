"""Streaming control counts equal the batch scores over the same files."""

from pyspark.sql import functions as F

from textctl.plans import queries as Q
from textctl.sources import fixtures as fx
from textctl.streaming import RESULTS_LONG, read_results_stream, start_ctg_counts, stream_ctg_counts

from conftest import SF0001


def test_stream_counts_equal_batch(spark, tmp_out):
    res = fx.results(spark, SF0001).select(*RESULTS_LONG.fieldNames())
    # results arrive in two batches (iterations 0-1, then 2)
    res.where(F.col("iter") < 2).write.parquet(f"{tmp_out}/in/b1")
    master = fx.prompts(spark, SF0001, text=False)
    q = start_ctg_counts(spark, f"{tmp_out}/in/*", master, f"{tmp_out}/out", f"{tmp_out}/ckpt")
    q.awaitTermination()
    first = spark.read.parquet(f"{tmp_out}/out")
    assert first.select("iter").distinct().count() == 2
    res.where(F.col("iter") == 2).write.parquet(f"{tmp_out}/in/b2")
    q = start_ctg_counts(spark, f"{tmp_out}/in/*", master, f"{tmp_out}/out", f"{tmp_out}/ckpt")  # resumes
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_out}/out")
    want = Q.scores(spark, SF0001)
    cols = ["task", "model", "aspect", "iter", "n", "n_valid", "n_undecided", "score"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_memory_sink(spark, tmp_out):
    res = fx.results(spark, SF0001).select(*RESULTS_LONG.fieldNames())
    res.write.parquet(f"{tmp_out}/in")
    counts = stream_ctg_counts(read_results_stream(spark, f"{tmp_out}/in"), fx.prompts(spark, SF0001, text=False))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("ctg_counts_test").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) AS c FROM ctg_counts_test").first()["c"] == Q.scores(spark, SF0001).count()
