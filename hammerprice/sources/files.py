"""Files of any store that Spark reads, by Hadoop's file systems: names, texts, claims."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, hidden ones left out; none if it isn't there."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    return [n for n in (s.getPath().getName() for s in fs.listStatus(p)) if not n.startswith(".") and n != "_SUCCESS"]


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not exist yet; False if it does. Of two at once one wins, as far as
    the store's own create-without-overwrite is atomic (HDFS and stores with conditional writes)."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def drop(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.delete(p, True)


def listed(spark: SparkSession, path: str, pattern: str = "*.{csv,tsv,txt}") -> DataFrame:
    """``path, size, modified`` of the files of a folder and those below; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
