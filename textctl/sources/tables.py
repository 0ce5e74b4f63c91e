"""Parquet tables of a data folder, read with column pruning and, when the
scan cannot use the cluster, a single rebalance on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def target_partitions(spark: SparkSession) -> int:
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(spark.sparkContext.defaultParallelism, min(shuffle, 4 * spark.sparkContext.defaultParallelism))


def read_table(spark: SparkSession, data_dir: str, name: str, columns=None, key: str | None = None) -> DataFrame:
    """Read ``{data_dir}/{name}.parquet``.

    ``columns`` prunes the scan. With ``key`` set, the rows are hash
    partitioned on it, but only when the table is made of fewer files than
    the cluster has task slots: a small file with a single row group is
    read by one task however it is split, and the text work after the scan
    would then run on one core. A large table (many files) is read as is,
    so no full shuffle of the text is added at scale.
    """
    df = spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    if key is not None:
        slots = spark.sparkContext.defaultParallelism
        if len(df.inputFiles()) < slots:
            df = df.repartition(target_partitions(spark), key)
    return df
