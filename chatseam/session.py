"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they may be applied to a session somebody else built.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of failing the document.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the library's semantics depend on and return the session."""
    for key, value in REQUIRED_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def spread(data: DataFrame) -> DataFrame:
    """Use all cores on an input that arrives in fewer partitions than there are cores.

    A single small file is one task, however costly its rows are to process.
    Input that already fills the cluster, which any large table does, is
    returned as it is.
    """
    cores = data.sparkSession.sparkContext.defaultParallelism
    return data if data.rdd.getNumPartitions() >= cores else data.repartition(cores)


def saved(frame: DataFrame) -> DataFrame:
    """Write a frame as a table of the cluster's checkpoint folder and read it back.

    This ends the lineage: rows are computed once, and later rounds read files that outlive any
    executor. Only a local session may go without ``spark.checkpoint.dir``. The files go when the
    application ends.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints"))
        folder = context.getCheckpointDir()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(frame.schema).parquet(path)
