"""Tables whose changes become visible in one step, and ingestion that resumes by the shards already covered.

A table is a folder.  A job writes its files into a folder of its own below it (``v-<id>``), where no reader looks, and then
publishes them by creating one empty file ``_commits/<number>-<id>``: creating a file is atomic on every file system, so a reader
sees the state before or after, never a part.  A job that dies before that step leaves the old state; what it wrote stays unseen
until ``expire`` removes it.  The files are written, listed and read by Spark; only names of commits pass through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def commits(spark: SparkSession, path: str) -> list[str]:
    """Ids of the published writes, oldest first."""
    return [n.split("-", 1)[1] for n in _names(spark, f"{path}/_commits") if not n.startswith((".", "_")) and "-" in n]


def stage(df: DataFrame, path: str, partition_by=()) -> str:
    """Writes the rows where no reader looks; gives the id to publish."""
    version = uuid.uuid4().hex
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(f"{path}/v-{version}")
    return version


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Makes a staged write visible."""
    fs, folder = _folder(spark, f"{path}/_commits")
    fs.mkdirs(folder)
    name = f"{len(commits(spark, path)):012d}-{version}"
    if not fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, name)):
        raise RuntimeError(f"{name} is published already")


def replace_table(df: DataFrame, path: str, partition_by=()) -> str:
    """Replaces the table at ``path`` in one step; its old rows may be part of ``df``."""
    version = stage(df, path, partition_by)
    publish(df.sparkSession, path, version)
    return version


def read_table(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    """The last published state of a table that ``replace_table`` writes."""
    found = commits(spark, path)
    if not found:
        raise FileNotFoundError(f"nothing is published at {path}")
    df = spark.read.parquet(f"{path}/v-{found[-1]}")
    return df.select(*cols) if cols else df


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes the files of all but the last ``keep`` published states and of writes that were never published; gives their number.

    For tables that ``replace_table`` writes; run it while no writer is at work.
    """
    wanted = {f"v-{v}" for v in commits(spark, path)[-keep:]}
    gone = [n for n in _names(spark, path) if n.startswith("v-") and n not in wanted]
    for n in gone:
        fs, p = _folder(spark, f"{path}/{n}")
        fs.delete(p, True)
    return len(gone)


def list_shards(spark: SparkSession, source: str, pattern="*.parquet") -> DataFrame:
    """(shard): path of every matching file below ``source``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(source)
    return files.select(F.col("path").alias("shard"))


def covered(spark: SparkSession, path: str) -> DataFrame:
    """(shard): the ledger of shards that published runs have taken."""
    found = commits(spark, path)
    if not found:
        return spark.createDataFrame([], "shard string")
    return spark.read.parquet(*[f"{path}/ledger-{v}" for v in found])


def stage_new_shards(spark: SparkSession, source: str, path: str, pattern="*.parquet", transform=None) -> tuple[str | None, int]:
    """Writes the rows of shards that the ledger does not hold, and their ledger, both unseen; (id, number of shards)."""
    new = [r["shard"] for r in list_shards(spark, source, pattern).join(covered(spark, path), "shard", "left_anti").orderBy("shard").collect()]  # names of files
    if not new:
        return None, 0
    rows = spark.read.parquet(*new)
    version = stage(transform(rows) if transform else rows, path)
    spark.createDataFrame([(x,) for x in new], "shard string").coalesce(1).write.parquet(f"{path}/ledger-{version}")
    return version, len(new)


def take_new_shards(spark: SparkSession, source: str, path: str, pattern="*.parquet", transform=None) -> int:
    """Adds the shards below ``source`` that are not covered yet; gives their number.

    Rows and ledger become visible together, so a run that fails repeats no row and loses no shard.
    """
    version, n = stage_new_shards(spark, source, path, pattern, transform)
    if version:
        publish(spark, path, version)
    return n


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All rows of published runs."""
    return spark.read.parquet(*[f"{path}/v-{v}" for v in commits(spark, path)])
