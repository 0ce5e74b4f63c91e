"""SparkSession set-up and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this package relies on. AQE re-plans joins and
# coalesces shuffle partitions at run time and splits skewed join
# partitions; speculation stays off because a speculative copy of a task
# that calls a paid model would pay twice.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # batches for model calls are cut by bytes as well as rows: prompts
    # carry whole documents, so 10,000 rows could be gigabytes
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.speculation": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "textctl", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """What every query needs of a session it is given: the checkpoint
    folder, the package on the Python workers, the SQL functions."""
    from .functions.text import register_functions

    ensure_checkpoint_dir(spark)
    ensure_worker_code(spark)
    register_functions(spark)


_SHIPPED: set = set()


def ensure_worker_code(spark: SparkSession) -> None:
    """Make ``textctl`` importable in the Python workers (``mapInPandas``
    callables refer to it): the package is zipped once per application and
    added with ``addPyFile``; Spark serves the file from the driver to every
    executor (as with ``--py-files``), so no executor reads the driver's
    folder. Where the package is installed on the cluster or passed with
    ``--py-files``, set ``spark.textctl.shipCode=false``."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED or sc.getConf().get("spark.textctl.shipCode", "true").lower() == "false":
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="textctl-code-"), "textctl.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names; set one only if unset.

    On a cluster ``spark.checkpoint.dir`` points to shared storage and is
    used as is; if it is unset there, this raises, because a folder on one
    machine is not reliable storage for executors. Only in local mode
    (tests) a fresh folder is made when nothing is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage (model outputs are checkpointed there)")
        configured = tempfile.mkdtemp(prefix="textctl-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
