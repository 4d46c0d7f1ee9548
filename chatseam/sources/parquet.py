"""Parquet scans, file facts and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatseam.schema import CANONICAL_COLUMNS, CANONICAL_SCHEMA
from chatseam.sources.listing import directory_exists, hidden_beside, path_exists, remove_directory, replace_directory


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan with an optional projection, which reaches the files' column readers."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no Parquet data at {path}")
    data = spark.read.parquet(path)
    return data.select(*columns) if columns else data


def list_parquet_files(spark: SparkSession, directory: str) -> DataFrame:
    """``path, modified, length`` of all Parquet files below a directory, oldest first."""
    if not directory_exists(spark, directory):
        raise NotADirectoryError(directory)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(directory)
    )
    return files.select("path", F.col("modificationTime").alias("modified"), "length").orderBy("modified", "path")


def parquet_info(spark: SparkSession, path: str) -> DataFrame:
    """``path, rows, columns, size_mb`` per file. No data column is read."""
    data = read_parquet(spark, path)
    columns = F.array(*[F.lit(name) for name in data.columns])
    return (
        data.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("path", "rows", columns.alias("columns"), F.round(F.col("size") / 1_048_576, 2).alias("size_mb"))
    )


def parquet_totals(spark: SparkSession, path: str) -> DataFrame:
    """:func:`parquet_info` of all files of one path together: one row, also where there is no row or no file."""
    name = path.rstrip("/")
    columns = F.array(*[F.lit(column) for column in read_parquet(spark, path).columns])
    return parquet_info(spark, path).agg(
        F.lit(name).alias("path"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        columns.alias("columns"), F.coalesce(F.sum("size_mb"), F.lit(0.0)).alias("size_mb"),
    )


def write_parquet(
    data: DataFrame,
    path: str,
    compression: str = "snappy",
    overwrite: bool = True,
    partition_by: Sequence[str] = (),
) -> str:
    """Write a directory of Parquet files; without ``overwrite`` an existing path is an error.

    The files are written beside the path and take its place when they are complete, so
    what was there before survives a run that fails.
    """
    spark = data.sparkSession
    if not overwrite and path_exists(spark, path):
        raise FileExistsError(f"{path} exists and overwrite is off")
    writer = data.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    new = hidden_beside(path)
    try:
        writer.parquet(new)
    except Exception:
        remove_directory(spark, new)
        raise
    replace_directory(spark, new, path)
    return path


def corpus_path(output_dir: str, dataset: str) -> str:
    return f"{output_dir.rstrip('/')}/dataset={dataset}"


def write_corpus(checked: DataFrame, output_dir: str, dataset: str) -> str:
    """Write validated rows of one corpus, good and rejected ones in a single pass.

    Each corpus owns its ``dataset=`` directory, so a re-run replaces that corpus
    alone; ``status`` below it keeps rejected rows out of reads by partition pruning.
    """
    status = F.when(F.size("errors") == 0, F.lit("valid")).otherwise(F.lit("rejected"))
    rows = checked.select(*CANONICAL_COLUMNS, "errors").drop("dataset").withColumn("status", status)
    return write_parquet(rows, corpus_path(output_dir, dataset), partition_by=("status",))


def read_status(spark: SparkSession, output_dir: str) -> DataFrame:
    """Rows of both kinds with ``errors`` and ``status``, below an output or a corpus directory."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CANONICAL_SCHEMA)
    return spark.read.schema(f"{schema}, errors array<string>, status string").parquet(output_dir)


def read_corpora(spark: SparkSession, output_dir: str) -> DataFrame:
    """Canonical messages of every corpus written below ``output_dir``."""
    return read_status(spark, output_dir).where("status = 'valid'").select(*CANONICAL_COLUMNS)


def read_rejected(spark: SparkSession, output_dir: str) -> DataFrame:
    return read_status(spark, output_dir).where("status = 'rejected'").select(*CANONICAL_COLUMNS, "errors")
