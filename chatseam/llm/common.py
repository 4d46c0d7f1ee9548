"""What several operators share: words, stored intermediate tables, distributed prefix sums."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable
from types import ModuleType
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

T = TypeVar("T")

# A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine's only where none is named."""
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
    return context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def stored(frame: DataFrame) -> DataFrame:
    """Write a frame as a table of the shared folder and read it back.

    This ends the lineage: later jobs read files that outlive any executor, and the rows are
    computed once. The files go when the application ends.
    """
    spark = frame.sparkSession
    path = _passing_folder(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def stored_in_buckets(frame: DataFrame, key: str, buckets: int) -> DataFrame:
    """The same as a bucketed table: joins on ``key`` with as many partitions read it without a shuffle."""
    spark = frame.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    frame.write.bucketBy(buckets, key).option("path", _passing_folder(spark)).saveAsTable(name)
    kept = spark.table(name)
    # The catalog forgets the name; the files and what was read of their layout stay.
    spark.sql(f"DROP TABLE {name}")
    return kept


def _passing_folder(spark: SparkSession) -> str:
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def carried(documents: DataFrame, *needed: str) -> DataFrame:
    """``text``, the needed columns, and all columns but the text in one that no name can clash with."""
    rest = [F.col(f"`{name}`") for name in documents.columns if name != "text"]
    return documents.select("text", *needed, F.struct(*rest).alias("_rest"))


def restored(columns: list[str], text: Column | None = None) -> list[Column]:
    """The columns as they were, with another text if one is given."""
    text = F.col("text") if text is None else text
    return [text.alias("text") if name == "text" else F.col("_rest").getField(name).alias(name) for name in columns]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(seed: int, *columns: str) -> Column:
    """60 hash-random bits of the columns, in a form that other SQL engines can compute too."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def with_sum_before(
    rows: DataFrame, group: str, key: str, value: Column, into: str, ties: tuple[str, ...] = (), bits: int = 12
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same group that come earlier by ``key``.

    ``key`` holds 60 uniformly random bits. Its top ``bits`` name a range of keys, so a group of
    any size is 2**bits pieces of nearly equal size. The sums of pieces are one small row each; the
    running sum within a piece needs only its own rows. No task sees a whole group.
    """
    pieces = rows.withColumns({"_piece": F.shiftright(key, 60 - bits), "_value": value})
    in_group = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        pieces.groupBy(group, "_piece")
        .agg(F.sum("_value").alias("_sum"))
        .select(group, "_piece", F.coalesce(F.sum("_sum").over(in_group), F.lit(0)).alias("_start"))
    )
    in_piece = Window.partitionBy(group, "_piece").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        pieces.join(starts, [group, "_piece"])
        .withColumn(into, F.col("_start") + F.sum("_value").over(in_piece) - F.col("_value"))
        .drop("_piece", "_value", "_start")
    )


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of few rows, so that long ones don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def per_worker(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from one task to the next, made on first use: tokenizers and what they remember.

    Functions travel by value, so their own module's globals are new in every task.
    """
    kept = sys.modules.setdefault("chatseam_worker_state", ModuleType("chatseam_worker_state")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
