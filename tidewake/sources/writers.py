"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sink_parquet(df: DataFrame, path: str, partition_by=(), mode="overwrite") -> str:
    """Zstd parquet; the committer publishes files only when the job has finished."""
    w = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def sink_bucketed(df: DataFrame, path: str, key: str, n: int) -> str:
    """N hash buckets of a key as partitions; rows of a bucket keep all writers busy."""
    d = df.withColumn("bucket", F.pmod(F.hash(key), F.lit(n)))
    # the salt spreads a hot bucket over several files
    d = d.repartition("bucket", F.pmod(F.xxhash64(*d.columns), F.lit(8)))
    return sink_parquet(d, path, "bucket")


def sink_report(df: DataFrame, path: str, fmt="csv") -> str:
    """A small result table as a single CSV or JSON file."""
    w = df.repartition(1).write.mode("overwrite")
    (w.option("header", True).csv if fmt == "csv" else w.json)(path)
    return path
