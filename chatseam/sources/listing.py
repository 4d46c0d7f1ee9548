"""File names and sizes through Hadoop's file system API: metadata, never content."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileEntry:
    path: str
    length: int


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def directory_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def qualified(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _file_system(spark, path)
    return fs.makeQualified(hadoop_path).toUri().toString()


def escape_glob(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def replace_directory(spark: SparkSession, new: str, path: str) -> None:
    """Put a finished directory in the place of another; the old one goes last.

    If this dies halfway, one of both is complete beside ``path``, in a hidden directory.
    """
    fs, target = _file_system(spark, path)
    _, source = _file_system(spark, new)
    _, aside = _file_system(spark, hidden_beside(path))
    replaced = fs.exists(target)
    if replaced and not fs.rename(target, aside):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(source, target):
        if replaced:
            fs.rename(aside, target)
        raise OSError(f"{new} could not be renamed to {path}")
    if replaced:
        fs.delete(aside, True)


def remove_directory(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def hidden_beside(path: str) -> str:
    """A new name in the same folder that readers of the folder leave out."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_{name.replace('=', '-')}-{uuid.uuid4().hex}" if folder else f"_{name}-{uuid.uuid4().hex}"


def list_files(spark: SparkSession, directory: str, suffix: str, recursive: bool = False) -> list[FileEntry]:
    """Files whose name ends with ``suffix``, sorted by path; empty if there is no such directory."""
    if not directory_exists(spark, directory):
        return []
    fs, hadoop_path = _file_system(spark, directory)
    found = []
    iterator = fs.listFiles(hadoop_path, recursive)
    while iterator.hasNext():
        status = iterator.next()
        name = status.getPath().getName()
        if name.endswith(suffix) and not name.startswith(("_", ".")):
            found.append(FileEntry(status.getPath().toString(), status.getLen()))
    return sorted(found, key=lambda entry: entry.path)


def read_first_record(spark: SparkSession, path: str, is_complete, most_lines: int) -> str | None:
    """Leading lines of one file until ``is_complete(text)``, for CSV headers; null after ``most_lines``."""
    fs, hadoop_path = _file_system(spark, path)
    jvm = spark._jvm
    reader = jvm.java.io.BufferedReader(
        jvm.java.io.InputStreamReader(fs.open(hadoop_path), jvm.java.nio.charset.StandardCharsets.UTF_8)
    )
    try:
        text = ""
        for _ in range(most_lines):
            if (line := reader.readLine()) is None:
                break
            text = f"{text}\n{line}" if text else line
            if is_complete(text):
                return text
        return None
    finally:
        reader.close()
