"""Small files and shared folders on whatever file system Spark uses."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written aside and renamed over what is there, so that a reader sees the old or the new text."""
    jvm = spark._jvm
    p, fs = _at(spark, path)
    aside, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, p, how)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted."""
    p, fs = _at(spark, pattern)
    return sorted(x.getPath().toString() for x in fs.globStatus(p) or ())


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """False if there is nothing to rename, or something is there already."""
    p, fs = _at(spark, old)
    return fs.rename(p, _at(spark, new)[0])


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename into a folder that is made if it is not there; fails if nothing was renamed."""
    p, fs = _at(spark, new)
    fs.mkdirs(p.getParent())
    if not rename(spark, old, new):
        raise OSError(f"{old} was not renamed to {new}")


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or the warehouse where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/augury-{uuid.uuid4().hex}"
