"""File sources in the benchmark's layout (A1-A5).

All readers take a glob over any number of tasks and models and read it in
one scan with an explicit schema; ``task`` and ``model`` come from the
file path (``_metadata.file_path``), so one job covers every directory.
Malformed JSON lines are kept aside in ``_corrupt_record`` rather than
failing the whole read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.leaderboard import parse_ctg_report, parse_quality_report
from ..schemas import MASTER, RESULTS_CLEAN_WIDE, RESULTS_WIDE

# Path patterns: {root}/{task}/prompts_v{V}.jsonl and
# {root}/{task}/{model}/generated_result/... and .../score/...; folders
# written by ``partitionBy`` (task=..., model=..., iter=...) work as well.
TASK_OF_MASTER = r"/([^/]+)/[^/]*\.jsonl?$"
TASK_MODEL = r"/([^/=]+)/([^/]+)/(?:generated_result|score|analysis)/[^/]+$"


def path_field(path, name: str, layout: str | None = None, group: int = 1):
    """``name=value`` folder of a path, else group ``group`` of ``layout``."""
    part = F.regexp_extract(path, f"/{name}=([^/]+)/", 1)
    if layout is None:
        return F.nullif(part, F.lit(""))
    return F.when(part != "", part).otherwise(F.nullif(F.regexp_extract(path, layout, group), F.lit("")))


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])


def _read_json(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(_with_corrupt(schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(paths)
        .select("*", F.col("_metadata.file_path").alias("_path"))
    )


def read_master(spark: SparkSession, paths) -> DataFrame:
    """A1: prompt master JSON lines; ``task`` from the parent folder."""
    df = _read_json(spark, paths, MASTER)
    return df.withColumn("task", path_field(F.col("_path"), "task", TASK_OF_MASTER)).drop("_path")


def read_results(spark: SparkSession, paths, clean: bool = False) -> DataFrame:
    """A2 / A3: generated (or cleaned, ``*_wo_hf``) result files, wide;
    ``task`` and the directory-safe ``model`` from the path, ``model_path``
    from the file's own ``model`` field."""
    df = _read_json(spark, paths, RESULTS_CLEAN_WIDE if clean else RESULTS_WIDE)
    return (
        df.withColumnRenamed("model", "model_path")
        .withColumn("task", path_field(F.col("_path"), "task", TASK_MODEL, 1))
        .withColumn("model", path_field(F.col("_path"), "model", TASK_MODEL, 2))
        .drop("_path")
    )


def parsed(df: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Rows whose JSON line parsed, without the corrupt-record column. The
    filter also reads the small ``key`` column (an always-true hash test):
    otherwise a later count would prune the scan to the corrupt-record
    column alone, which Spark refuses for raw JSON."""
    always = F.xxhash64(F.col(key)) >= F.lit(-(2**63)).cast("long")
    return df.where(F.col("_corrupt_record").isNull() & always).drop("_corrupt_record")


def quarantine(df: DataFrame) -> DataFrame:
    """Rows whose JSON line did not parse. The filter also refers to the
    parsed columns (a hash compared with the smallest long: always true, but
    not folded away): Spark does not allow a scan of raw JSON that reads the
    corrupt-record column alone."""
    others = [F.col(f"`{c}`") for c in df.columns if c != "_corrupt_record"]
    always = F.xxhash64(*others) >= F.lit(-(2**63)).cast("long")
    return df.where(F.col("_corrupt_record").isNotNull() & always)


def _read_lines(spark: SparkSession, paths) -> DataFrame:
    """Text lines with their position in the file (one task per file: the
    reports are a few lines each, so ``wholetext`` keeps the order)."""
    whole = spark.read.option("wholetext", True).text(paths).select("value", F.col("_metadata.file_path").alias("_path"))
    lines = whole.select("_path", F.posexplode(F.split(F.regexp_replace("value", "\n\\z", ""), "\n")).alias("line_no", "line"))
    return lines.withColumn("task", path_field(F.col("_path"), "task", TASK_MODEL, 1)).withColumn(
        "model", path_field(F.col("_path"), "model", TASK_MODEL, 2)
    )


def read_ctg_reports(spark: SparkSession, paths) -> DataFrame:
    """A4: ``…_ctg_score_{iter}.txt`` files -> ``task, model, iter, aspect, score``."""
    it = path_field(F.col("_path"), "iter", r"_(\d+)\.txt$")
    lines = _read_lines(spark, paths).withColumn("iter", it.cast("int")).drop("_path")
    return parse_ctg_report(lines)


def read_quality_reports(spark: SparkSession, paths) -> DataFrame:
    """A5: ``…_quality_score.txt`` files -> ``task, model, aspect, all_acc``."""
    return parse_quality_report(_read_lines(spark, paths).drop("_path"))
