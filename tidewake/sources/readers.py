"""Scans.  Filters stay on plain columns so parquet statistics can prune row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import content_id


def scan_parquet(spark: SparkSession, path, cols: list[str] | None = None) -> DataFrame:
    """Parquet file or folder of shards, reading only ``cols``."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*cols) if cols else df


def scan_trades(spark, path, ids: DataFrame, key: str, ts: str, lo, hi, cols=None) -> DataFrame:
    """Rows with lo <= ts < hi whose key is in ``ids``.

    The time bounds are pushed to the scan; the key test is a semi join whose small side the
    planner may broadcast or turn into a bloom filter.
    """
    df = scan_parquet(spark, path, cols).where((F.col(ts) >= lo) & (F.col(ts) < hi))
    return filter_in(df, key, ids)


def filter_in(df: DataFrame, col: str, ids: DataFrame, id_col: str | None = None) -> DataFrame:
    """Rows whose value is in the id table."""
    keys = ids.select(F.col(id_col or col).alias("_id"))
    return df.join(keys, F.col(col) == F.col("_id"), "left_semi")


def scan_csv(spark, path, schema: str, sep=",", header=True, rename: dict[str, str] | None = None,
             encoding="UTF-8", pattern: str | None = None, multiline=False) -> DataFrame:
    """Delimited text with a fixed schema; ``rename`` maps localized headers.

    ``sep=';'`` reads semicolon files, ``sep='\\t', header=False`` headerless tab files, and one
    call per exported sheet replaces a workbook.  ``multiline`` reads quoted values with line breaks.
    """
    r = spark.read.option("sep", sep).option("header", header).option("encoding", encoding).option("multiLine", multiline)
    r = r.option("enforceSchema", "true").schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    df = r.csv(path)
    return df.withColumnsRenamed(rename) if rename else df


def scan_csv_dir(spark, path, schema: str, pattern="*.csv", **kw) -> DataFrame:
    """Every matching file of a folder as one table, with its file name."""
    d = scan_csv(spark, path, schema, pattern=pattern, **kw)
    return d.withColumn("source_file", F.col("_metadata.file_name"))


def scan_json(spark, path, schema: str, multiline=False) -> DataFrame:
    """JSON records with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def document_columns(df: DataFrame, path_col: str, root: str, text_col: str) -> DataFrame:
    """Id, relative path, folder label, first heading and metadata flag of (path, text) rows."""
    rel = F.regexp_replace(F.col(path_col), "^.*?" + root.rstrip("/") + "/", "")
    h1 = F.regexp_extract(text_col, r"(?m)^\s{0,3}#\s+(.+?)\s*$", 1)
    name = F.regexp_extract(rel, r"([^/]+)$", 1)
    return df.select(
        content_id(rel).alias("doc_id"), rel.alias("relative_path"),
        F.when(rel.contains("/"), F.regexp_extract(rel, r"^([^/]+)/", 1)).otherwise("root").alias("folder_label"),
        name.alias("filename"), F.when(h1 != "", h1).alias("top_heading"),
        F.lower(name).rlike("^(readme|index|_)").alias("is_metadata"), F.col(text_col).alias("text"),
    )


def scan_documents(spark, root: str, ext="md") -> DataFrame:
    """One row per file below ``root``; files are read whole by the executors."""
    d = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{ext}").text(root, wholetext=True)
        .select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    )
    return document_columns(d, "path", root, "text")
