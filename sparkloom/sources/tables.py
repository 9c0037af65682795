"""Sources and sinks of feature tables, panels, predictions and metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    """A table that cannot be read as asked."""


def read_table(spark: SparkSession, path: str | None) -> DataFrame:
    """Parquet (.parquet, .pq or a folder of it), JSON lines or CSV with a header; numbers that are NaN become null."""
    if not path:
        raise SourceError("no path is given")
    low = path.rstrip("/").lower()
    try:
        if low.endswith((".parquet", ".pq")):
            df = spark.read.parquet(path)
        elif low.endswith((".json", ".jsonl", ".ndjson")):
            df = spark.read.json(path)
        else:
            df = spark.read.csv(path, header=True, inferSchema=True)
    except Exception as error:
        raise SourceError(f"{path} cannot be read: {str(error).splitlines()[0]}") from error
    return without_nan(df)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of JSON-like rows; a key that a row lacks is null there."""
    if not rows:
        raise SourceError("one row is needed at least")
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names, samplingRatio=1.0) if any(any(r.get(n) is not None for r in rows) for n in names) else spark.createDataFrame([tuple(None for _ in names) for _ in rows], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to null in float and double columns, decimals to double."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header if the path ends so, else Parquet."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if path.lower().endswith(".csv") else writer.parquet(path)


def write_metadata(spark: SparkSession, data: dict, path: str) -> None:
    """A JSON document as a text file, by Spark's own writer, so any store works."""
    spark.createDataFrame([(json.dumps(data, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))
