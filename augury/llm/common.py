"""Shared helpers: table reading, the shared scratch folder, Arrow row mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from augury.sources import files

#: A key of more than one in so many rows is hot.
HOT = 1000
#: Rows turned into Python objects at once inside a task.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    That is ``spark.checkpoint.dir``; where it is unset (tests), a folder of the
    warehouse, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if "://" not in root and root.startswith("/"):
        root = f"file://{root}"
    elif root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    return f"{root.rstrip('/')}/augury-{uuid.uuid4().hex}"


def materialise(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    A lost executor then costs no recomputation of what lies before this point.  The path
    is added to ``made``, for ``discard`` when nothing reads it any more.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove what ``materialise`` wrote there."""
    for path in paths:
        files.delete(spark, path)


@contextmanager
def rows_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """Send at most ``n`` rows to Python at once, for what is computed inside: rows with whole texts or sets may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def join_spread(rows: DataFrame, groups: DataFrame, keys: list[str], value: str, n_rows: int, spread: Column) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row per key; ``many``, how many rows have it; ``value``), as column ``value``.

    Rows of one key would meet in one task.  Fewer than ``HOT`` keys can have more than
    1 / HOT of all rows: these are broadcast, and their rows go on under a key of their own,
    a text made of ``spread``.  The first key is a text; ``groups`` should be written down.
    """
    hot = groups.filter(F.col("many") * HOT > n_rows).select(*keys, F.struct(value).alias("__hot"))
    cool = groups.filter(F.col("many") * HOT <= n_rows).select(F.col(keys[0]).alias("__key"), *keys[1:], F.struct(value).alias("__cool"))
    out = rows.join(F.broadcast(hot), keys, "left")
    out = out.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(keys[0])).otherwise(F.concat(F.lit("#"), spread.cast("string"))))
    out = out.join(cool, ["__key", *keys[1:]], "left")
    return out.withColumn(value, F.coalesce("__hot", "__cool")[value]).drop("__key", "__hot", "__cool")


def _text_column(df: DataFrame, column: str) -> int:
    return df.columns.index(column)


def filter_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``df`` that a function of ``column``'s values, which ``make()`` gives each task, keeps.

    Batches stay as Arrow; a few hundred values at a time are Python objects.
    """
    at = _text_column(df, column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for b in batches:
            told = [bool(x) for k in range(0, b.num_rows, ROWS_AT_ONCE) for x in keep(b.column(at).slice(k, ROWS_AT_ONCE).to_pylist())]
            yield b.filter(pa.array(told, pa.bool_()))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, df.schema)


def map_column(df: DataFrame, column: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``df`` with ``column`` mapped, a few hundred values at a time, to values of the same type."""
    at = _text_column(df, column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = make()
        for b in batches:
            # each slice goes on by itself, so that no batch is held twice
            for k in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(k, ROWS_AT_ONCE)
                columns = list(part.columns)
                columns[at] = pa.array(change(columns[at].to_pylist()), part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, df.schema)


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[list[list]], Iterator[tuple]]]) -> DataFrame:
    """Map ``columns`` of ``df`` through Python, a few hundred rows at a time.

    ``make()`` runs once per task and returns a function from column lists to output
    tuples (any number for each input row); it holds whatever state the task needs.
    If that function has a method ``finish``, its tuples end the task's output.
    """
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def packed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield from packed(list(run([part.column(i).to_pylist() for i in range(len(columns))])))
        if hasattr(run, "finish"):
            yield from packed(list(run.finish()))
        pa.default_memory_pool().release_unused()

    return df.select(*columns).mapInArrow(task, kind)
