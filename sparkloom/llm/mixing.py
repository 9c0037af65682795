"""Mixing sources to target weights by Poisson replication.

Every document is repeated K times, K drawn from a Poisson distribution whose mean is
the rate that brings its source to its target share. The draw inverts the distribution
at a uniform number hashed from the seed and doc_id, so a run can be repeated and a lost
task draws the same copies again. A global shuffle then spreads sources and copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import packed, unpacked

#: A mean above this is split into equal parts, each drawn by itself; the sum has the same distribution.
PART = 16.0
#: Steps of an inverted distribution of mean 16 at most: beyond, less than 2 ** -52 of it is left.
STEPS = 72
#: Source tables of up to so many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def uniform(seed: int, key: Column, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), key, *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def rates(docs: DataFrame, weights: dict[str, float] | None, source: str) -> DataFrame:
    """(skey, n, rate, parts, cdf) of each source. Without weights all sources get equal shares."""
    counts = docs.groupBy(source_key(F.col(source)).alias("skey")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        given = [(("n" if k is None else f"s{k}"), float(v)) for k, v in weights.items()]
        if any(v < 0 for _, v in given):
            raise ValueError("weights are 0 or more")
        weighted = counts.join(docs.sparkSession.createDataFrame(given, "skey string, w double"), "skey", "left").na.fill(0.0, ["w"])
    all_n, all_w = weighted.agg(F.sum("n").cast("double"), F.sum("w")).first()
    share = F.col("w") / F.lit(all_w) if all_w else F.lit(0.0)
    rated = weighted.select("skey", "n", (share * F.lit(all_n or 0.0) / F.col("n")).alias("rate"))
    mean = F.col("rate") / F.col("parts")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c")),
        lambda s, i: F.struct((s["p"] * mean / i).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / i)).alias("c")),
        lambda s: s["c"],
    )
    return rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")).withColumn("cdf", steps)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """docs with each row repeated as drawn, globally shuffled; adds copy_no (from 0) and mix_key.

    weights: target share of each source (any scale); a source without one gets none.
    None: equal shares. The expected number of rows is that of docs.
    Nulls: a null source is a source of its own (weights key None), a null key draws as the
    text "null". Rows with the same key draw the same count. An empty table gives an empty
    one. Columns of docs named copy_no or mix_key are replaced. Empty and very long texts
    are carried as they are.
    """
    table = rates(docs, weights, source)
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = packed(docs).select("row", source_key(F.col(f"row.`{source}`")).alias("skey"))
    name = F.coalesce(F.col(f"row.`{key}`").cast("string"), F.lit("null"))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda s, j: s + F.size(F.filter("cdf", lambda c: c <= uniform(seed, name, j.cast("string")))),
    )
    # a single part is the common case and needs no loop
    one = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    counted = (
        rows.join(table.select("skey", "parts", "cdf"), "skey")
        .withColumn("u", uniform(seed, name, F.lit("1")))
        .withColumn("k", F.when(F.col("parts") == 1, one).otherwise(drawn))
    )
    copies = counted.filter("k > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("k") - 1).cast("array<long>")).alias("copy_no"))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), name, F.col("copy_no").cast("string"))))
    kept = [c for c in docs.columns if c not in ("copy_no", "mix_key")]
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key").select(*unpacked("row", kept), "copy_no", "mix_key")


def oracle(seed: int = 7, table: str = "documents") -> str:
    """DuckDB SQL of mix() with equal shares."""
    return f"""
with recursive n as (select coalesce('s' || source, 'n') skey, count(*) n from {table} group by 1),
e as (select skey, (1.0::double / (select count(*) from n)) * (select sum(n) from n)::double / n rate from n),
r as (select skey, rate / greatest(ceil(rate / {PART}), 1) m, greatest(ceil(rate / {PART}), 1)::int parts from e),
c(skey, m, i, p, c) as (
  select skey, m, 0, exp(-m), exp(-m) from r
  union all
  select skey, m, i + 1, p * m / (i + 1), c + p * m / (i + 1) from c where i < {STEPS}),
d as (select *, row_number() over () rid, coalesce('s' || source, 'n') skey, coalesce(doc_id::varchar, 'null') nm from {table}),
u as (select rid, skey, ('0x' || substr(md5('{seed}:' || nm || ':' || j), 1, 13))::bigint::double / 4503599627370496.0 v from (select rid, skey, nm, unnest(range(1, parts + 1)) j from d join r using (skey))),
k as (select rid, count(*) k from u join c on u.skey = c.skey and c.c <= u.v group by 1)
select doc_id, "text", lang, source, n_chars, j::bigint copy_no, md5('order{seed}:' || nm || ':' || j) mix_key
from (select d.*, unnest(range(k)) j from d join k using (rid))"""
