"""Profile of a feature table, guardrail flags, and the recipe that is replayed at scoring."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.scalars import clean_names, date_parts, hashed, is_number


@dataclass(frozen=True)
class Limits:
    """When a column is flagged; shares are of rows, or of non-null values for near_constant."""

    missing: float = 0.95
    near_constant: float = 0.995
    unique_id: float = 0.999
    many_levels: int = 50
    text_length: float = 60.0
    max_text: int = 3
    sniffed: int = 500


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, v, n): how often each value of each column stands, as text. Partial counts come first, so a column's values never meet in one task unreduced."""
    columns = columns or df.columns
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    return long.groupBy("feature", "v").agg(F.count("*").alias("n"))


def missing_unique(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, n_rows, n_missing, n_unique), one pass: null counts and exact distinct counts of all columns."""
    return value_counts(df, columns).groupBy("feature").agg(*_missing_unique())


def _missing_unique() -> list[Column]:
    return [F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_missing"), F.count("v").alias("n_unique")]


def top_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, n, top_n, top_share): the commonest value's share of the non-null ones."""
    by_value = value_counts(df, columns).filter("v is not null")
    return by_value.groupBy("feature").agg(F.sum("n").alias("n"), F.max("n").alias("top_n"), (F.max("n") / F.sum("n")).alias("top_share"))


def text_length(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, avg_length) of text columns."""
    sums = df.agg(*[F.avg(F.length(F.col(f"`{c}`"))).alias(c) for c in columns])
    return sums.unpivot([], columns, "feature", "avg_length")


def profile(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(feature, dtype, n_rows, missing_pct, n_unique, top_share, avg_length, flags) of every column."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    kinds = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), isinstance(f.dataType, T.StringType), isinstance(f.dataType, T.IntegralType), isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))) for f in df.schema.fields],
        "feature string, dtype string, is_text boolean, is_whole boolean, is_time boolean",
    )
    there = F.when(F.col("v").isNotNull(), F.col("n"))
    base = value_counts(df).groupBy("feature").agg(*_missing_unique(), (F.max(there) / F.sum(there)).alias("top_share"))  # one pass
    lengths = text_length(df, strings) if strings else df.sparkSession.createDataFrame([], "feature string, avg_length double")
    joined = base.join(F.broadcast(kinds), "feature").join(lengths, "feature", "left")
    return flagged(joined, limits)


def flagged(joined: DataFrame, limits: Limits = Limits()) -> DataFrame:
    share = F.col("n_unique") / F.col("n_rows")
    rules = [
        ("mostly_missing", F.col("n_missing") / F.col("n_rows") >= limits.missing),
        ("constant", (F.col("n_unique") <= 1) | (F.coalesce("top_share", F.lit(1.0)) >= limits.near_constant)),
        ("id_like", (share >= limits.unique_id) & ~F.col("is_time") & (F.col("is_text") | F.col("is_whole"))),
        ("free_text", F.col("is_text") & (F.col("avg_length") >= limits.text_length)),
        ("many_levels", F.col("is_text") & (F.col("n_unique") > limits.many_levels)),
        ("datetime", F.col("is_time")),
    ]
    flags = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return joined.select(
        "feature", "dtype", "n_rows", (F.col("n_missing") / F.col("n_rows") * 100).alias("missing_pct"), "n_unique", "top_share", "avg_length", flags.alias("flags")
    )


def time_share(df: DataFrame, column: str, order: list[str], sniffed: int = 500) -> DataFrame:
    """(n, with_mark, parsed): of the first values by the order columns, how many look like a time and how many parse."""
    first = df.filter(F.col(column).isNotNull()).orderBy(*order).limit(sniffed).select(F.col(column).cast("string").alias("v"))
    return first.agg(
        F.count("*").alias("n"), F.count_if(F.col("v").rlike("[-/:]")).alias("with_mark"), F.count(F.try_to_timestamp("v")).alias("parsed")
    )


def without_repeats(df: DataFrame, order: list[str], of: list[str]) -> DataFrame:
    """One row, the first by order, for each combination of the columns of. With of=all columns Spark's own dropDuplicates does the same."""
    rank = F.row_number().over(Window.partitionBy(*of).orderBy(*order))
    return df.withColumn("__n", rank).filter("__n = 1").drop("__n")


@dataclass
class Recipe:
    """What was done to the columns, as data; expressions() is the one way it is applied, at training and at scoring."""

    renamed: dict[str, str] = field(default_factory=dict)
    dates: dict[str, list[str]] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    booleans: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        return cls(**json.loads(text))

    def columns(self) -> list[Column]:
        """Of a raw table, the columns that models read."""
        raw = {new: old for old, new in self.renamed.items()}
        out: list[Column] = []
        for f in self.features:
            c = F.col(f"`{raw.get(f, f)}`")
            if f in self.dates:
                ts = F.try_to_timestamp(c.cast("string"))
                out += [date_parts(ts)[p].cast("double").alias(f"{f}__{p}") for p in self.dates[f]]
            elif f in self.texts:
                out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f))
            elif f in self.levels:
                out.append(c.cast("string").alias(f))
            elif f in self.booleans:
                out.append(c.cast("int").cast("double").alias(f))
            else:
                out.append(c.cast("double").alias(f))
        return out

    def missing(self, df: DataFrame) -> list[str]:
        raw = {new: old for old, new in self.renamed.items()}
        return [raw.get(f, f) for f in self.features if raw.get(f, f) not in df.columns]


def prepared(df: DataFrame, target: str, drop: list[str] = (), keep: list[str] = (), limits: Limits = Limits()) -> tuple[Recipe, list[dict]]:
    """The recipe of a raw table and its profile's rows, by the guardrails: mostly missing, constant and id-like columns go, unless kept."""
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    if df.filter(F.col(f"`{target}`").isNotNull()).limit(1).count() == 0:
        raise ValueError("every target is missing")
    names = clean_names(df.columns)
    candidates = [c for c in df.columns if c != target and c not in drop]
    known = df.filter(F.col(f"`{target}`").isNotNull()).select(*[F.col(f"`{c}`").alias(names[c]) for c in candidates])
    rows = [r.asDict() for r in profile(known, limits).collect()]  # a row for each column
    hard, texts = {"mostly_missing", "constant", "id_like"}, 0
    recipe = Recipe(renamed={o: n for o, n in names.items() if o != n and o in candidates})
    kinds = {f.name: f.dataType for f in known.schema.fields}
    by_name = {r["feature"]: r for r in rows}
    for c in candidates:
        f = names[c]
        flags, forced = set(by_name[f]["flags"]), c in keep or f in keep
        times = "datetime" in flags or (isinstance(kinds[f], T.StringType) and not forced and not flags & {"mostly_missing", "constant"} and _is_time(known, f, limits))
        if flags & (hard - {"id_like"} if times else hard) and not forced:  # dates that hardly repeat are no ids
            continue
        if times:
            if not forced:
                recipe.dates[f] = list(date_parts(F.lit(None)))
            else:
                recipe.levels.append(f)
        elif "free_text" in flags:
            if texts >= limits.max_text:
                continue
            texts += 1
            recipe.texts.append(f)
        elif isinstance(kinds[f], T.BooleanType):
            recipe.booleans.append(f)
        elif not is_number(kinds[f]):
            recipe.levels.append(f)
        recipe.features.append(f)
    if not recipe.features:
        raise ValueError("no feature is left: " + "; ".join(f"{r['feature']}: {', '.join(r['flags'])}" for r in rows))
    return recipe, rows


def _is_time(df: DataFrame, column: str, limits: Limits) -> bool:
    key = "__sniff"  # a value's place among the others says nothing of its form: values come in a hashed order
    n, mark, parsed = time_share(df.select(column, hashed(F.col(f"`{column}`"), "sniff").alias(key)), column, [key], limits.sniffed).first()
    return n > 0 and mark > 0.9 * n and parsed > 0.95 * n
