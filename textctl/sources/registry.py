"""Model registry (A7-A10): numbered model paths, slicing, directory names.

The registry is configuration (the benchmark reads ``MODEL_PATH_0..n``
from the environment), so it lives on the driver as a short list and
enters plans as a literal array; it never needs a join.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = re.compile(r"\AMODEL_PATH_(\d+)\Z")


def registry_paths(env: Mapping[str, str] | None = None) -> list[str]:
    """Entries ``MODEL_PATH_0, 1, ...`` up to the first missing number."""
    env = os.environ if env is None else env
    numbered = {}
    for k, v in env.items():
        m = _KEY.match(k)
        if m:
            numbered[int(m.group(1))] = v
    out = []
    while len(out) in numbered:
        out.append(numbered[len(out)])
    return out


def model_slice(paths: list[str], start_index: int | None = None, num: int | None = None) -> list[tuple[int, str]]:
    """Both arguments (a slice) or neither (all); one alone is an error."""
    indexed = list(enumerate(paths))
    if start_index is None and num is None:
        return indexed
    if start_index is None or num is None:
        raise ValueError("give both start_index and num, or neither")
    return indexed[start_index : start_index + num]


def suffix(model_path) -> Column:
    """Directory-safe model name (``/`` -> ``-``)."""
    c = F.col(model_path) if isinstance(model_path, str) else model_path
    return F.replace(c, F.lit("/"), F.lit("-"))


def suffix_py(model_path: str) -> str:
    return model_path.replace("/", "-")


REGISTRY_SCHEMA = T.StructType(
    [T.StructField("model_idx", T.IntegerType(), False), T.StructField("model_path", T.StringType(), False)]
)


def model_registry(spark: SparkSession, models: list[tuple[int, str]]) -> DataFrame:
    """The registry as a DataFrame ``(model_idx, model_path, model)``."""
    df = spark.createDataFrame(models, REGISTRY_SCHEMA)
    return df.withColumn("model", suffix("model_path"))


def sql_str(s: str) -> str:
    """A Spark SQL string literal (raw string syntax cannot hold a quote,
    so quotes and backslashes are escaped instead)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def model_struct_sql(idx: int, path: str) -> str:
    return f"named_struct('model_idx', {int(idx)}, 'model_path', {sql_str(path)}, 'model', {sql_str(suffix_py(path))})"


def model_struct(idx: int, path: str) -> Column:
    return F.expr(model_struct_sql(idx, path))


def models_literal(models: list[tuple[int, str]]) -> Column:
    """The registry as an array<struct> literal, for fan-out by ``explode``
    (one parsed expression: cheap to build however many models)."""
    return F.expr("array(" + ", ".join(model_struct_sql(i, p) for i, p in models) + ")")


def list_models(results: DataFrame) -> DataFrame:
    """A10: the (task, model) directories that hold results."""
    return results.select("task", "model_path", "model").distinct()


def missing_results(spark: SparkSession, found: DataFrame, tasks: list[str], models: list[tuple[int, str]]) -> DataFrame:
    """``task, model_path, model`` asked for but not in ``found``."""
    wanted = spark.createDataFrame([(t, p, suffix_py(p)) for t in tasks for _, p in models], "task string, model_path string, model string")
    return wanted.join(found.select("task", "model"), ["task", "model"], "left_anti").select("task", "model_path", "model")


def check_inputs(missing: DataFrame, strict: bool = False, limit: int = 20) -> DataFrame:
    """Q16: one policy for missing inputs. ``missing`` is the anti-join
    report (e.g. ``missing_inputs``); with ``strict`` a non-empty report
    raises, naming at most ``limit`` entries, else it is returned to be
    written next to the results."""
    if strict:
        sample = missing.limit(limit).collect()
        if sample:
            raise FileNotFoundError(f"missing inputs: {[tuple(r) for r in sample]}")
    return missing
