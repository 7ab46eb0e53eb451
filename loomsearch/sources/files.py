"""Small files and folders on whatever file system a path is on, by Hadoop's API."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    _, fs, where = _at(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    jvm, fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it and then renamed over it, in one step, so that a reader finds the old or the new text whatever fails."""
    jvm, fs, where = _at(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(where), how)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    _, fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def remove(spark: SparkSession, path: str) -> None:
    _, fs, where = _at(spark, path)
    fs.delete(where, True)
