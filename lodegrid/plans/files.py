"""Small files by Hadoop's file systems, which driver and executors see alike."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder."""
    at, fs = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file, None without one."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _at(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def below(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(folder, file) of the files in the folders of a folder."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return []
    return [(d.getPath().getName(), f.getPath().getName()) for d in fs.listStatus(at) if d.isDirectory() for f in fs.listStatus(d.getPath()) if f.isFile()]


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, False)
