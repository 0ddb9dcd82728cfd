"""Panels, trades, signals and gate documents from files.

Paths are on any file system that Spark reads.
"""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.schemas import PANEL, SIGNAL, TRADE, struct
from augury.sources import files


def read_panel(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    """A panel by suffix: .parquet (or a folder) or .csv; other suffixes are a ValueError, a missing file a FileNotFoundError.

    With ``features`` of the feature columns only these are read.
    """
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    suffix = PurePosixPath(path).suffix
    if suffix == ".csv":
        header = spark.read.csv(path, header=True).columns
        kinds = {f.name: f.dataType.simpleString() for f in struct(PANEL)}
        schema = ", ".join(f"`{c}` {kinds.get(c, 'double' if c.startswith('feature_') else 'string')}" for c in header)
        out = spark.read.csv(path, header=True, schema=schema)
    elif suffix in (".parquet", ""):
        out = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown panel format {suffix!r}: use .parquet or .csv")
    return out if features is None else out.select(*[c for c in out.columns if not c.startswith("feature_") or c in features])


def _read_listed(spark: SparkSession, path: str, name: str, row: str, strict: bool = False) -> DataFrame:
    """Rows of {"name": [...]}, of a document or of each document of a folder; none if the file or the key is missing.

    With ``strict`` an unknown key of a row is an error, raised when rows are read.
    """
    if not files.exists(spark, path):
        return spark.createDataFrame([], struct(row))
    kind = f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in row.split(', '))}>>"
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    if strict:
        known = F.array(*[F.lit(f.name) for f in struct(row)])
        keys = F.flatten(F.transform(F.from_json("value", f"{name} array<map<string,string>>")[name], lambda m: F.map_keys(m)))
        odd = F.array_except(F.coalesce(keys, F.expr("cast(array() as array<string>)")), known)
        text = text.withColumn("value", F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit(f"unknown keys in {name}: "), F.array_join(odd, ", ")))).otherwise(F.col("value")))
    return text.select(F.from_json("value", f"{name} {kind}")[name].alias(name)).select(F.inline(name))


def _read_lines(spark: SparkSession, path: str, row: str, strict: bool = False) -> DataFrame:
    """A row of each line, so that a file of any size is split over tasks; none if nothing is there.

    Empty lines are skipped; a line that is no JSON object, or with ``strict`` has an
    unknown key, is an error, raised when rows are read.
    """
    if not files.exists(spark, path):
        return spark.createDataFrame([], struct(row))
    line = spark.read.option("recursiveFileLookup", "true").text(path).filter("trim(value) <> ''")
    keys = F.json_object_keys("value")
    wrong = F.when(keys.isNull(), F.lit("a line is no JSON object"))
    if strict:
        odd = F.array_except(keys, F.array(*[F.lit(f.name) for f in struct(row)]))
        wrong = wrong.when(F.size(odd) > 0, F.concat(F.lit("unknown keys: "), F.array_join(odd, ", ")))
    line = line.withColumn("value", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("value")))
    return line.select(F.from_json("value", struct(row), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_trades_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trades of a file or folder of JSON lines, the layout for large stores."""
    return _read_lines(spark, path, TRADE)


def read_signals_lines(spark: SparkSession, path: str) -> DataFrame:
    """Signals of JSON lines; a key that no signal has is an error."""
    return _read_lines(spark, path, SIGNAL, strict=True)


def read_trades_json(spark: SparkSession, path: str) -> DataFrame:
    return _read_listed(spark, path, "trades", TRADE)


def read_signals_json(spark: SparkSession, path: str) -> DataFrame:
    """Signals; a key that no signal has is an error."""
    return _read_listed(spark, path, "signals", SIGNAL, strict=True)


def read_gate_json(path: str, spark: SparkSession | None = None) -> dict:
    return json.loads(files.read_text(spark or SparkSession.active(), path))
