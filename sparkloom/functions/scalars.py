"""Column functions: hashed orders, date parts, Fourier terms, holidays, name cleaning."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a column name must not hold.
NAME_CHARS = "[]<>{}\"':,"


def hashed(key: Column, salt: str | int) -> Column:
    """A text to order rows by that looks random and is the same in every run and engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{salt}")))


def stable_key(df: DataFrame, name: str = "__rid") -> DataFrame:
    """df with a key for each row, from its content and its number among equal rows."""
    from pyspark.sql import Window

    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    order = Window.partitionBy("__content").orderBy(F.lit(1))
    return df.withColumn("__content", content).withColumn(name, F.concat_ws("-", "__content", F.row_number().over(order))).drop("__content")


def clean_names(columns: list[str]) -> dict[str, str]:
    """Old to new names: odd characters become _, a name that is taken gets a number; names that clash without regard to case are an error."""
    low = [c.lower() for c in columns]
    if twice := sorted({c for c in columns if low.count(c.lower()) > 1}):
        raise ValueError(f"columns share a name: {', '.join(twice)}")
    out: dict[str, str] = {}
    used: set[str] = set()
    for c in columns:
        base = re.sub("[" + re.escape(NAME_CHARS) + "]", "_", c)
        name, k = base, 1
        while name.lower() in used or (name != c and name.lower() in low):
            name, k = f"{base}_{k}", k + 1
        used.add(name.lower())
        out[c] = name
    return out


def date_parts(ts: Column) -> dict[str, Column]:
    """The seven numeric parts of a time; Monday is 0."""
    return {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "dayofweek": F.weekday(ts), "hour": F.hour(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"), "epoch_days": F.unix_date(ts.cast("date")),
    }


def fourier(t: Column, period: float, terms: int = 3) -> dict[str, Column]:
    """sin and cos of 2 pi k t / period for k up to terms."""
    out = {}
    for k in range(1, terms + 1):
        angle = F.lit(2 * math.pi * k / period) * t
        out |= {f"sin{k}": F.sin(angle), f"cos{k}": F.cos(angle)}
    return out


def us_holidays(first: int, last: int) -> list[str]:
    """Days (ISO) of the US federal holidays of the years first to last, by their rules."""
    from datetime import date, timedelta

    def nth(year: int, month: int, weekday: int, n: int) -> date:
        day = date(year, month, 1)
        return day + timedelta((weekday - day.weekday()) % 7 + 7 * (n - 1))

    out = set()
    for y in range(first, last + 1):
        may = date(y, 5, 31)
        fixed = [date(y, 1, 1), date(y, 7, 4), date(y, 11, 11), date(y, 12, 25)] + ([date(y, 6, 19)] if y >= 2021 else [])
        out |= {*fixed, nth(y, 1, 0, 3), nth(y, 2, 0, 3), may - timedelta(may.weekday()), nth(y, 9, 0, 1), nth(y, 10, 0, 2), nth(y, 11, 3, 4)}
    return sorted(d.isoformat() for d in out)


def holiday_flags(df: DataFrame, ds: str, days: list[str]) -> DataFrame:
    """df with is_holiday, day_before_holiday and day_after_holiday (0 or 1). The calendar has a few rows a year and is broadcast."""
    spark: SparkSession = df.sparkSession
    rows = spark.createDataFrame([(d,) for d in days], "h string").select(F.to_date("h").alias("h"))
    out = df
    for name, shift in (("is_holiday", 0), ("day_before_holiday", -1), ("day_after_holiday", 1)):
        flags = F.broadcast(rows.select(F.date_add("h", shift).alias("__h"), F.lit(1).alias(name)).distinct())
        out = out.join(flags, F.col(ds).cast("date") == F.col("__h"), "left").drop("__h").na.fill(0, [name])
    return out


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType) and not isinstance(kind, T.BooleanType)
