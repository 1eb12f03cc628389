"""Files of the shared folder, through the file system that Spark itself uses for their path."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _hadoop(spark, path)
    return files.exists(target)


def committed(spark: SparkSession, path: str) -> bool:
    """True once a write there is complete: Spark leaves `_SUCCESS` last."""
    return exists(spark, f"{path}/_SUCCESS")


def delete(spark: SparkSession, path: str) -> None:
    target, files = _hadoop(spark, path)
    files.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none if there is no such folder."""
    target, files = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def modified(spark: SparkSession, path: str) -> int:
    target, files = _hadoop(spark, path)
    return files.getFileStatus(target).getModificationTime()


def stamp(spark: SparkSession, path: str) -> str:
    """Size and time of a file."""
    target, files = _hadoop(spark, path)
    status = files.getFileStatus(target)
    return f"{status.getLen()} {status.getModificationTime()}"


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder to a path where nothing is yet; False, and no move, where something is."""
    fs = spark._jvm.org.apache.hadoop.fs
    origin, goal = fs.Path(source), fs.Path(target)
    context = fs.FileContext.getFileContext(goal.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(origin), context.makeQualified(goal), plain)
    except Py4JJavaError:
        if not exists(spark, target):
            raise
        return False
    return True
