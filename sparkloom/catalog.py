"""The registered queries of the modelling and forecasting operators, with their oracle SQL.

Doubles are rounded in both engines, as their sums run in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.scalars import clean_names, date_parts, fourier, holiday_flags, us_holidays
from sparkloom.operators import association, drift, encode, forecast, metrics, panel, profile, reconcile, season, select, split, target
from sparkloom.session import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name, with DuckDB SQL of the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.round(c, digits).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(c) for c in df.columns])


# --- profile and guardrails


@query("""
select feature, count(*) n_rows, count(*) filter (v is null) n_missing, count(distinct v) n_unique from (
  unpivot (select o_orderkey::varchar a, o_custkey::varchar b, o_orderstatus c, o_orderpriority d from orders) on a, b, c, d into name f value v)
  join (values ('a','o_orderkey'), ('b','o_custkey'), ('c','o_orderstatus'), ('d','o_orderpriority')) m(f, feature) using (f) group by 1""")
def profile_missing_unique(spark, sf):
    return profile.missing_unique(read(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""
select feature, sum(n)::bigint n, max(n) top_n, round(max(n) / sum(n), 6) top_share from (
  select 'l_returnflag' feature, l_returnflag v, count(*) n from lineitem group by 2 union all
  select 'l_linestatus', l_linestatus, count(*) from lineitem group by 2 union all
  select 'l_linenumber', l_linenumber::varchar, count(*) from lineitem group by 2) group by 1""")
def profile_top_share(spark, sf):
    return rounded(profile.top_share(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]))


@query("""
with s as (
  select 'p_partkey' feature, 'bigint' dtype, count(*) n_rows, count(distinct p_partkey) n_unique, null::double avg_length, max(c) top from (select p_partkey, count(*) over (partition by p_partkey) c from part) union all
  select 'p_name', 'string', count(*), count(distinct p_name), avg(length(p_name)), max(c) from (select p_name, count(*) over (partition by p_name) c from part) union all
  select 'p_brand', 'string', count(*), count(distinct p_brand), avg(length(p_brand)), max(c) from (select p_brand, count(*) over (partition by p_brand) c from part) union all
  select 'p_type', 'string', count(*), count(distinct p_type), avg(length(p_type)), max(c) from (select p_type, count(*) over (partition by p_type) c from part) union all
  select 'p_size', 'int', count(*), count(distinct p_size), null, max(c) from (select p_size, count(*) over (partition by p_size) c from part) union all
  select 'p_retailprice', 'double', count(*), count(distinct p_retailprice), null, max(c) from (select p_retailprice, count(*) over (partition by p_retailprice) c from part))
select feature, dtype, n_rows, 0.0::double missing_pct, n_unique, round(top / n_rows, 6) top_share, round(avg_length, 6) avg_length,
  concat_ws(',', case when n_unique <= 1 or top / n_rows >= .995 then 'constant' end, case when n_unique / n_rows >= .999 and dtype in ('bigint', 'int', 'string') then 'id_like' end,
    case when avg_length >= 60 then 'free_text' end, case when dtype = 'string' and n_unique > 50 then 'many_levels' end) flags from s""")
def profile_flags(spark, sf):
    return rounded(profile.profile(read(spark, sf, "part"))).withColumn("flags", F.concat_ws(",", "flags"))


@query("""
select o_orderkey, year(d)::int "year", month(d)::int "month", day(d)::int "day", (isodow(d) - 1)::int dayofweek, hour(d)::int "hour", (isodow(d) >= 6)::int is_weekend,
  date_diff('day', date '1970-01-01', d::date)::int epoch_days from (select o_orderkey, o_orderdate d from orders)""")
def date_decompose(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in date_parts(F.col("o_orderdate")).items()])


@query("""
select 'events.ts' feature, count(*) n, count(*) filter (regexp_matches(v, '[-/:]')) with_mark, count(try_cast(v as timestamp)) parsed from (select ts::varchar v from events order by event_id limit 500)
union all select 'documents.source', count(*), count(*) filter (regexp_matches(source, '[-/:]')), count(try_cast(source as timestamp)) from (select source from documents order by doc_id limit 500)""")
def datetime_sniff(spark, sf):
    a = profile.time_share(read(spark, sf, "events"), "ts", ["event_id"]).select(F.lit("events.ts").alias("feature"), "*")
    b = profile.time_share(read(spark, sf, "documents"), "source", ["doc_id"]).select(F.lit("documents.source").alias("feature"), "*")
    return a.unionByName(b)


@query("""select 'text' feature, round(avg(length(text)), 6) avg_length, avg(length(text)) >= 60 is_text from documents
union all select 'source', round(avg(length(source)), 6), avg(length(source)) >= 60 from documents""")
def text_stats(spark, sf):
    found = profile.text_length(read(spark, sf, "documents"), ["text", "source"])
    return found.select("feature", F.round("avg_length", 6).alias("avg_length"), (F.col("avg_length") >= 60).alias("is_text"))


@query("""select min(doc_id) doc_id, n_chars from documents group by text, n_chars""")
def dedup_rows(spark, sf):
    return profile.without_repeats(read(spark, sf, "documents"), ["doc_id"], ["text"]).select("doc_id", "n_chars")


@query("""select doc_id, lang from documents where lang in (select lang from documents group by 1 having count(*) >= (select count(*) / 8 from documents))""")
def rare_class_filter(spark, sf):
    docs = read(spark, sf, "documents")
    return target.without_rare(docs, "lang", -(-docs.count() // 8)).select("doc_id", "lang")


@query("""select o_orderkey, o_orderstatus, (dense_rank() over (order by o_orderstatus) - 1)::int code from orders""")
def label_encode(spark, sf):
    return target.labelled(read(spark, sf, "orders"), "o_orderstatus").select("o_orderkey", "o_orderstatus", "code")


@query("""select o_orderstatus "class", count(*) n, round(max(count(*)) over () / count(*), 6) imbalance from orders group by 1""")
def class_imbalance(spark, sf):
    return rounded(target.class_counts(read(spark, sf, "orders"), "o_orderstatus"))


_STATS = """
with q as (select quantile_cont({y}, .25) a, quantile_cont({y}, .75) b from {t}),
s as (select '{n}' feature, count(*) n, avg({y}) mean, median({y}) median, stddev_pop({y}) sd, skewness({y}) skew,
  count(*) filter ({y} < a - 3 * (b - a) or {y} > b + 3 * (b - a)) / count(*) outlier_share, count(*) filter ({y} = 0) / count(*) zero_share, min({y}) > 0 positive,
  bool_and({y} = floor({y})) whole, count(distinct {y}) n_distinct, min({y}) low from (select {y}::double {y} from {t}) t, q)"""
_ROUND = "feature, n, round(mean, 4) mean, round(median, 4) median, round(sd, 4) sd, round(skew, 4) skew, round(outlier_share, 6) outlier_share, round(zero_share, 6) zero_share, positive, whole, n_distinct, round(low, 4) low"


def _stats(spark, sf, t, y):
    s = target.statistics(read(spark, sf, t), y)
    return s.select(F.lit(f"{t}.{y}").alias("feature"), "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sd", "skew")], F.round("outlier_share", 6).alias("outlier_share"), F.round("zero_share", 6).alias("zero_share"), "positive", "whole", "n_distinct", F.round("low", 4).alias("low"))


@query(_STATS.format(y="o_totalprice", t="orders", n="orders.o_totalprice") + f" select {_ROUND} from s")
def target_stats(spark, sf):
    return _stats(spark, sf, "orders", "o_totalprice")


_RULES = """ select feature, case when abs(skew) > 2 or outlier_share > .01 then 'MAE' else 'RMSE' end metric,
  case when whole and low >= 0 and n_distinct <= least(100, greatest(10, n * .05)) then 'poisson' when zero_share > .05 and skew > 1 and low >= 0 then 'tweedie'
    when positive and skew > 2 then 'gamma' when positive and skew > 1 then 'log_target' else 'squared' end objective from s"""


@query(
    "select * from (" + _STATS.format(y="value", t="events", n="events.value") + _RULES + ") union all select * from (" + _STATS.format(y="l_quantity", t="lineitem", n="lineitem.l_quantity") + _RULES + ")"
)
def metric_and_objective(spark, sf):
    a = target.decided(_stats(spark, sf, "events", "value"))
    b = target.decided(_stats(spark, sf, "lineitem", "l_quantity"))
    return a.unionByName(b).select("feature", "metric", "objective")


# --- splits, folds, samples

_HASH = "md5({k}::varchar || '-{s}')"


@query(f"""select o_orderkey, o_orderstatus, case when row_number() over (partition by o_orderstatus order by {_HASH.format(k="o_orderkey", s=42)}, o_orderkey) <= round(count(*) over (partition by o_orderstatus) * .2)
  then 'holdout' else 'train' end split from orders""")
def split_stratified(spark, sf):
    return split.stratified_holdout(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query("""select o_orderkey, case when row_number() over (order by o_orderdate, o_orderkey) <= count(*) over () - greatest(1, floor(count(*) over () * .2)) then 'train' else 'holdout' end split from orders""")
def split_time(spark, sf):
    return split.time_holdout(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "split")


@query(f"""with g as (select o_custkey, row_number() over (order by {_HASH.format(k="o_custkey", s=42)}, o_custkey) r, count(*) over () n from (select distinct o_custkey from orders))
select o_orderkey, o_custkey, case when r <= floor(n * .2 + .5) then 'holdout' else 'train' end split from orders join g using (o_custkey)""")
def split_group(spark, sf):
    return split.group_holdout(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "o_custkey", "split")


@query(f"""select doc_id, quality, ((row_number() over (partition by quality order by {_HASH.format(k="doc_id", s=42)}, doc_id) - 1) % 5)::int fold from labels""")
def kfold_assign(spark, sf):
    return split.folds(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", 5, "quality")


@query(f"""select doc_id, quality, ((row_number() over (partition by quality order by {_HASH.format(k="doc_id", s=1042)}, doc_id) - 1) % 5)::int fold from labels""")
def kfold_fresh(spark, sf):
    return split.folds(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", 5, "quality", 1042)


@query(f"""select o_orderkey, o_custkey, (('0x' || substr({_HASH.format(k="o_custkey", s=42)}, 1, 8))::bigint % 5)::int fold from orders""")
def group_folds(spark, sf):
    return split.group_folds(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@query("""select o_orderkey, greatest(0, ceil((row_number() over (order by o_orderdate, o_orderkey) - (n - 3 * (n // 4))) / (n // 4)))::int block from (select *, count(*) over () n from orders)""")
def time_folds(spark, sf):
    return split.time_folds(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "block")


@query("""with r as (select o_orderkey, o_orderdate, row_number() over (order by o_orderdate nulls last, o_orderkey) k, count(*) over () n from orders),
t as (select *, count(*) over () m from r where k <= n - greatest(1, floor(n * .2)::bigint)), f as (select *, greatest(0, ceil((k - (m - 5 * (m // 6))) / (m // 6)))::int fold from t)
select i::int fold, count(*) filter (fold < i) n_train, count(*) filter (fold = i) n_test, max(o_orderdate) filter (fold < i)::timestamp last_train, min(o_orderdate) filter (fold = i)::timestamp first_test
from f, (select unnest(range(1, 6)) i) group by 1""")
def cv_time_expanding(spark, sf):
    from sparkloom.operators import models

    rows = split.time_holdout(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 0.2).filter("split = 'train'")
    rows = settled(split.time_folds(rows, "o_orderdate", "o_orderkey", 5).withColumnRenamed("block", "fold"))
    out = None
    for i, (train, test) in enumerate(models.trials_of(rows, 5, ahead=True), 1):
        one = train.agg(F.count("*").alias("n_train"), F.max("o_orderdate").alias("last_train")).crossJoin(test.agg(F.count("*").alias("n_test"), F.min("o_orderdate").alias("first_test")))  # a row each
        one = one.withColumn("fold", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with f as (select o_custkey, (('0x' || substr({_HASH.format(k="o_custkey", s=42)}, 1, 8))::bigint % 5)::int a, (('0x' || substr({_HASH.format(k="o_custkey", s=1042)}, 1, 8))::bigint % 5)::int b from orders)
select b fold, count(*) n, count(distinct o_custkey) groups, count(*) filter (a = b) same_as_before from f group by 1""")
def cv_group_fresh(spark, sf):
    first = split.group_folds(read(spark, sf, "orders").select("o_custkey"), "o_custkey").withColumnRenamed("fold", "a")
    fresh = split.group_folds(first, "o_custkey", 5, 1042)
    return fresh.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"), F.count_if(F.col("a") == F.col("fold")).alias("same_as_before"))


@query("""select l_orderkey, l_linenumber, l_returnflag from (select *, row_number() over (partition by l_returnflag order by md5(l_orderkey || '-' || l_linenumber || '-42'), l_orderkey, l_linenumber) r,
  count(*) over (partition by l_returnflag) s, count(*) over () n from lineitem) where r <= ceil(s * 1000 / n)""")
def stratified_sample(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return split.stratified_sample(rows, ["l_orderkey", "l_linenumber"], "l_returnflag", 1000)


# --- associations

_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]
_SPEARMAN = " union all ".join(
    f"select '{a}' f1, '{b}' f2, count(*) n, corr(x, y) rho from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2 x, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2 y from lineitem)"
    for a, b in _PAIRS
)


@query(f"select f1, f2, n, round(rho, 6) rho from ({_SPEARMAN})")
def spearman_pairs(spark, sf):
    return rounded(association.spearman_pairs(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(f"select f1, f2, round(rho, 6) rho from ({_SPEARMAN}) where abs(rho) >= .5")
def corr_prune_pairs(spark, sf):
    found = association.spearman_pairs(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(found.filter(F.abs("rho") >= 0.5).select("f1", "f2", "rho"))


@query("""with b as (select c_mktsegment, count(*) n, avg(o_totalprice) m, var_pop(o_totalprice) v from orders join customer on o_custkey = c_custkey group by 1),
s as (select sum(n)::bigint n, count(*) levels, sum(n * m * m) / sum(n) - (sum(n * m) / sum(n)) ** 2 between_, sum(n * v) / sum(n) within_ from b)
select n, levels, round(between_ / (between_ + within_), 6) eta2 from s""")
def assoc_eta(spark, sf):
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(association.association(rows, "c_mktsegment", "o_totalprice"))


def _binned(column: str, table: str, bins: int = 10) -> str:
    shares = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""e as (select list_distinct(quantile_cont({column}, [{shares}])) e from {table}), es as (select list_sort(e) e from e),
  binned as (select t.*, len(list_filter(e[2:len(e) - 1], lambda x: {column} > x)) bin from {table} t, es)"""


@query(f"with {_binned('o_totalprice', 'orders')} select bin::int bin, count(*) n, round(min(o_totalprice), 2) low, round(max(o_totalprice), 2) high from binned group by 1")
def quantile_bins(spark, sf):
    rows = association.quantile_bins(read(spark, sf, "orders"), "o_totalprice")
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.max("o_totalprice"), 2).alias("high"))


@query("""with l as (select l_extendedprice y, * from lineitem), g as (select 'l_returnflag' feature, count(*) n, avg(y) m, var_pop(y) v from l group by l_returnflag union all select 'l_linestatus', count(*), avg(y), var_pop(y) from l group by l_linestatus),
e as (select feature, sum(n * m * m) / sum(n) - (sum(n * m) / sum(n)) ** 2 b, sum(n * v) / sum(n) w from g group by 1),
r as (select corr(x, y) rho from (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 y from l)),
s as (select feature, round(b / (b + w), 6) score, null::double spearman from e union all select 'l_quantity', null, round(rho, 6) from r union all select 'gross', null, 1.0 union all select 'minus', null, -1.0)
select feature, score::double score, spearman, case when coalesce(score, 0) >= .95 or coalesce(abs(spearman), 0) >= .98 then case when feature = 'minus' then 'protected' else 'leak' end else 'ok' end flag from s""")
def leakage_decision(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", (F.col("l_extendedprice") * 1.2).alias("gross"), (-F.col("l_extendedprice")).alias("minus"), F.col("l_extendedprice").alias("y"))
    none = F.lit(None).cast("double")
    eta = association.explained(rows, [], ["l_returnflag", "l_linestatus"], "y").select("feature", F.round("eta2", 6).alias("score"), none.alias("spearman"))
    rho = association.spearman_with(rows, ["l_quantity", "gross", "minus"], "y").select(F.col("f1").alias("feature"), none.alias("score"), F.round("rho", 6).alias("spearman"))
    return association.leakage(eta.unionByName(rho), ["minus"])


# --- encoders


@query("""with n as (select n_name, count(*) n from customer join nation on c_nationkey = n_nationkey group by 1), k as (select *, n >= (select quantile_cont(n, .5) from n) often from n)
select c_custkey, case when often then n_name else '__rare' end level from customer join nation on c_nationkey = n_nationkey join k using (n_name)""")
def onehot_rare_pool(spark, sf):
    rows = read(spark, sf, "customer").join(F.broadcast(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    half = rows.groupBy("n_name").count().agg(F.percentile("count", F.lit(0.5))).first()[0]
    return encode.rare_pooled(rows, "n_name", half).select("c_custkey", "level")


@query(f"""with f as (select o_orderkey, c_nationkey, o_totalprice, ((row_number() over (order by {_HASH.format(k="o_orderkey", s=42)}, o_orderkey) - 1) % 5)::int fold from orders join customer on o_custkey = c_custkey),
p as (select fold, ((select sum(o_totalprice) from f) - sum(o_totalprice)) / ((select count(*) from f) - count(*)) prior from f group by 1),
b as (select c_nationkey, fold, sum(o_totalprice) s, count(*) n from f group by 1, 2),
e as (select c_nationkey, fold, (sum(s) over (partition by c_nationkey) - s + 10 * prior) / (sum(n) over (partition by c_nationkey) - n + 10) encoded from b join p using (fold))
select o_orderkey, fold, round(encoded, 2) encoded from f join e using (c_nationkey, fold)""")
def target_encode_oof(spark, sf):
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "o_totalprice")
    return rounded(encode.target_means(split.folds(rows, "o_orderkey"), "c_nationkey", "o_totalprice", "fold").select("o_orderkey", "fold", "encoded"), 2)


@query("""with w as (select item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) w from benchmark), c as (select item_id, (('0x' || substr(md5(w), 1, 8))::bigint % 256)::int bucket, count(*) c from w where w <> '' group by 1, 2)
select item_id, bucket, round(c / sqrt(sum(c * c) over (partition by item_id)), 6) weight from c""")
def hash_text_buckets(spark, sf):
    return rounded(encode.hashed_words(read(spark, sf, "benchmark"), "item_id", "text"))


@query("""with w as (select item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') w from benchmark),
t as (select distinct item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) term from w), c as (select term, count(*) df from t group by 1)
select term, df, round(ln((1.0 + (select count(*) from benchmark)) / (1.0 + df)) + 1, 6) idf from c order by df desc, term limit 200""")
def tfidf_terms(spark, sf):
    return rounded(encode.term_weights(read(spark, sf, "benchmark"), "item_id", "text", 2, 200))


@query("""select quality "class", count(*) n, round((select count(*) from labels) / ((select count(distinct quality) from labels) * count(*)), 6) weight from labels group by 1""")
def class_weights(spark, sf):
    return rounded(encode.class_weights(read(spark, sf, "labels"), "quality"))


@query("""with h as (select p_partkey, case when p_partkey % 7 = 0 then null else p_size end::double x from part), f as (select p_partkey, x is null miss, coalesce(x, (select median(x) from h)) x from h)
select p_partkey, miss::int p_size__missing, round((x - (select avg(x) from f)) / (select stddev_pop(x) from f), 6) p_size from f""")
def impute_scale(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"))
    return rounded(encode.imputed_scaled(rows, ["p_size"]).select("p_partkey", "p_size__missing", "p_size"))


@query("""select c_mktsegment, count(*) n, round(regr_slope(o_totalprice, c_acctbal), 4) slope, round(regr_intercept(o_totalprice, c_acctbal), 2) intercept, round(regr_r2(o_totalprice, c_acctbal), 6) r2
  from orders join customer on o_custkey = c_custkey group by 1""")
def linear_fit_groups(spark, sf):
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y, x = "o_totalprice", "c_acctbal"
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


# --- scores of predictions

_SCORED = "s as (select doc_id, quality y, least(n_chars / 6000.0::double, 1.0::double) p from labels join documents using (doc_id))"


def _scored(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "n_chars")
    p = F.least(F.col("n_chars").cast("double") / F.lit(6000.0), F.lit(1.0))
    return read(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), p.alias("p"))


def _priced(spark, sf):
    by = read(spark, sf, "orders")
    means = by.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("p"))
    return by.join(means, "o_orderpriority").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("y"), "p")


_PRICED = "s as (select o_orderkey, o_orderstatus, o_totalprice y, avg(o_totalprice) over (partition by o_orderpriority) p from orders)"


@query(f"with {_PRICED} select o_orderstatus, count(*) n, round(sqrt(avg((y - p) ** 2)), 2) rmse, round(avg(abs(y - p)), 2) mae, round(median(abs(y - p)), 2) median_ae, round(1 - avg((y - p) ** 2) / var_pop(y), 6) r2 from s group by 1")
def metrics_regression(spark, sf):
    return rounded(metrics.regression(_priced(spark, sf), "y", "p", ["o_orderstatus"]).withColumn("r2", F.round("r2", 6)), 6).select("o_orderstatus", "n", *[F.round(c, 2).alias(c) for c in ("rmse", "mae", "median_ae")], "r2")


@query(f"""with {_SCORED}, q as (select *, least(greatest(p, 1e-15), 1 - 1e-15) q, (p >= .5)::int h from s),
c as (select count(*) n, sum(h * y) tp, sum(h * (1 - y)) fp, sum((1 - h) * y) fn, sum((1 - h) * (1 - y)) tn, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) logloss, avg((p - y) ** 2) brier from q),
r as (select rank() over (order by p) + (count(*) over (partition by p) - 1) / 2 r, y from s), a as (select (sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) auc from r)
select n, round(logloss, 6) logloss, round(brier, 6) brier, round((tp + tn) / n, 6) accuracy, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) balanced_accuracy, round(auc, 6) auc from c, a""")
def metrics_binary(spark, sf):
    rows = _scored(spark, sf)
    return rounded(metrics.binary(rows, "y", "p").crossJoin(metrics.auc(rows, "y", "p")))  # a row each



@query("""with c as (select o_orderpriority, o_orderstatus, count(*) n from orders group by 1, 2), g as (select unnest(['F', 'O', 'P']) k),
p as (select o_orderpriority, k, coalesce(sum(n) filter (o_orderstatus = k), 0) / sum(n) p from c, g group by 1, 2),
r as (select o_orderkey, o_orderstatus, k, p from orders join p using (o_orderpriority)), t as (select o_orderkey, max_by(k, (p, -ascii(k))) k from r group by 1),
a as (select k, y, rank() over (partition by k order by p) + (count(*) over (partition by k, p) - 1) / 2 r from (select k, p, (o_orderstatus = k)::int y from r)),
u as (select k, (sum(r) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) a from a group by 1)
select (select count(*) from orders) n, round((select avg(-ln(least(greatest(p, 1e-15), 1 - 1e-15))) from r where k = o_orderstatus), 6) logloss,
  round((select avg((t.k = o.o_orderstatus)::int) from orders o join t using (o_orderkey)), 6) accuracy, round((select avg(a) from u), 6) macro_auc""")
def metrics_multiclass(spark, sf):
    orders = read(spark, sf, "orders")
    shares = orders.groupBy("o_orderpriority").agg(F.array(*[F.count_if(F.col("o_orderstatus") == c) / F.count("*") for c in "FOP"]).alias("shares"))
    return rounded(metrics.multiclass(orders.join(shares, "o_orderpriority"), "o_orderstatus", "shares", list("FOP")))


@query("""with c as (select o_orderpriority, o_orderstatus, count(*) n from orders group by 1, 2), p as (select o_orderpriority, o_orderstatus, n / sum(n) over (partition by o_orderpriority) p from c)
select 'shares' model, round(-avg(-ln(least(greatest(p, 1e-15), 1 - 1e-15))), 6) score from orders join p using (o_orderpriority, o_orderstatus)""")
def multiclass_score(spark, sf):
    from sparkloom.operators import models

    orders = read(spark, sf, "orders")
    label = F.coalesce(*[F.when(F.col("o_orderstatus") == c, F.lit(float(i))) for i, c in enumerate("FOP")])
    shares = orders.groupBy("o_orderpriority").agg(F.array(*[F.count_if(F.col("o_orderstatus") == c) / F.count("*") for c in "FOP"]).alias("s"))
    found = models.score(orders.join(shares, "o_orderpriority").select(label.alias("label"), "s"), "classification")
    return spark.createDataFrame([("shares", round(found, 6))], "model string, score double")


@query(f"with {_SCORED} select y actual, count(*) filter (p < .5) n_0, count(*) filter (p >= .5) n_1 from s group by 1")
def confusion_matrix(spark, sf):
    return metrics.confusion(_scored(spark, sf).withColumn("h", (F.col("p") >= 0.5).cast("int")), "y", "h", [0, 1])


@query(f"""with {_SCORED}, h as (select y, (p >= .5)::int h from s), c as (select unnest([0, 1]) c)
select c "class", count(*) filter (y = c) support, round(coalesce(count(*) filter (y = c and h = c) / nullif(count(*) filter (h = c), 0), 0), 6) "precision",
  round(coalesce(count(*) filter (y = c and h = c) / nullif(count(*) filter (y = c), 0), 0), 6) recall, round(coalesce(2 * count(*) filter (y = c and h = c) / nullif(count(*) filter (y = c) + count(*) filter (h = c), 0), 0), 6) f1 from h, c group by 1""")
def class_report(spark, sf):
    return rounded(metrics.class_report(_scored(spark, sf).withColumn("h", (F.col("p") >= 0.5).cast("int")), "y", "h"))


@query(f"""with {_SCORED}, c as (select p score, sum(y) pos, sum(1 - y) neg from s group by 1)
select round(score, 6) score, round(sum(pos) over w / sum(pos) over (), 6) tpr, round(sum(neg) over w / sum(neg) over (), 6) fpr from c window w as (order by score desc)""")
def roc_points(spark, sf):
    return rounded(metrics.roc(_scored(spark, sf), "y", "p"))


_SWEEP = f"""with {_SCORED}, t as (select unnest(range(5, 96)) t), c as (select t / 100 threshold, sum((p >= t / 100)::int * y)::bigint tp, sum((p >= t / 100)::int * (1 - y))::bigint fp,
  sum((p < t / 100)::int * y)::bigint fn, sum((p < t / 100)::int * (1 - y))::bigint tn from s, t group by t),
w as (select threshold, tp, fp, fn, tn, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::double f1, ((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2)::double balanced_accuracy from c)"""


@query(_SWEEP + " select round(threshold, 6) threshold, tp, fp, fn, tn, round(f1, 6) f1, round(balanced_accuracy, 6) balanced_accuracy from w")
def threshold_sweep(spark, sf):
    return rounded(metrics.sweep(_scored(spark, sf), "y", "p"))


@query(_SWEEP + " select round(threshold, 6) threshold, round(balanced_accuracy, 6) balanced_accuracy from w order by w.balanced_accuracy desc, w.threshold limit 1")
def best_threshold(spark, sf):
    return rounded(metrics.best_threshold(metrics.sweep(_scored(spark, sf), "y", "p"), "balanced_accuracy").select("threshold", "balanced_accuracy"))


@query(f"with {_SCORED}, b as (select *, ntile(10) over (order by p desc, doc_id) bin from s) select bin::int bin, count(*) n, round(avg(p), 6) mean_predicted, round(avg(y), 6) mean_actual from b group by 1")
def lift_table(spark, sf):
    return rounded(metrics.lift(_scored(spark, sf), "y", "p", "doc_id"))


@query(f"with {_SCORED}, {_binned('p', 's')} select bin::int bin, count(*) n, round(avg(p), 6) predicted, round(avg(y), 6) observed from binned group by 1")
def calibration_table(spark, sf):
    return rounded(metrics.calibration(_scored(spark, sf), "y", "p"))


@query(f"""with {_SCORED}, r as (select (p - y) ** 2 v, b, ('0x' || substr(md5(doc_id || ':' || b || '-boot'), 1, 8))::bigint / 4294967296.0::double u from s, range(100) t(b)),
w as (select b, v, (u >= 0.36787944117144233)::int + (u >= 0.7357588823428847)::int + (u >= 0.9196986029286058)::int + (u >= 0.9810118431238462)::int + (u >= 0.9963401531726563)::int + (u >= 0.9994058151824183)::int w from r),
m as (select b, sum(v * w) / sum(w) m from w group by 1)
select round((select avg((p - y) ** 2) from s), 6) point, round(quantile_cont(m, .025), 6) low, round(quantile_cont(m, .975), 6) high, count(*) n_resamples from m""")
def bootstrap_ci(spark, sf):
    rows = _scored(spark, sf)
    return rounded(metrics.bootstrap(rows, "doc_id", (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))))


# --- drift

_SHARES = ", ".join(str(i / 10) for i in range(11))
_PSI_NUM = f"""e as (select list_sort(list_distinct(quantile_cont(value, [{_SHARES}]))) e from ref), k as (select unnest(range(len(e) - 1)) bin from e),
b as (select 'r' side, len(list_filter(e[2:len(e) - 1], lambda x: value >= x)) bin from ref, e union all select 'n', len(list_filter(e[2:len(e) - 1], lambda x: value >= x)) from new, e),
h as (select k.bin, greatest(count(*) filter (side = 'r') / (select count(*) from ref), 1e-4) p, greatest(count(*) filter (side = 'n') / (select count(*) from new), 1e-4) q from k left join b using (bin) group by 1),
z as (select p / sum(p) over () p, q / sum(q) over () q from h)"""
_HALVES = "ref as (select * from events where ts < timestamp '2024-01-16'), new as (select * from events where ts >= timestamp '2024-01-16')"
_STATUS = "case when psi < .1 then 'OK' when psi < .25 then 'MODERATE DRIFT' else 'MAJOR DRIFT' end status"


def _halves(spark, sf):
    events = read(spark, sf, "events")
    at = F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    return events.filter(F.col("ts") < at), events.filter(F.col("ts") >= at)


@query(f"with {_HALVES}, {_PSI_NUM}, s as (select sum((q - p) * ln(q / p)) psi from z) select 'value' feature, round(psi, 6) psi, {_STATUS} from s")
def psi_numeric(spark, sf):
    return rounded(drift.numeric_psi(*_halves(spark, sf), "value"))


_PSI_LEVEL = """c as (select 'r' side, event_type v from ref union all select 'n', event_type from new),
h as (select v, greatest(count(*) filter (side = 'r') / (select count(*) from ref), 1e-4) p, greatest(count(*) filter (side = 'n') / (select count(*) from new), 1e-4) q from c group by 1),
z as (select p / sum(p) over () p, q / sum(q) over () q from h)"""


@query(f"with {_HALVES}, {_PSI_LEVEL}, s as (select sum((q - p) * ln(q / p)) psi from z) select 'event_type' feature, round(psi, 6) psi, {_STATUS} from s")
def psi_categorical(spark, sf):
    return rounded(drift.level_psi(*_halves(spark, sf), "event_type"))


_SHIFTED = "ref as (select * from events where ts < timestamp '2024-01-16'), new as (select event_id, ts, value + 10 as value, event_type from events where ts >= timestamp '2024-01-16')"


@query(
    f"select * from (with {_SHIFTED}, {_PSI_NUM}, s as (select sum((q - p) * ln(q / p)) psi from z) select 'value' feature, round(psi, 6) psi, {_STATUS} from s) "
    f"union all select * from (with {_SHIFTED}, {_PSI_LEVEL}, s as (select sum((q - p) * ln(q / p)) psi from z) select 'event_type' feature, round(psi, 6) psi, {_STATUS} from s) union all select 'gone', null, 'MISSING COLUMN'"
)
def psi_report(spark, sf):
    ref, new = _halves(spark, sf)
    return rounded(drift.report(ref.withColumn("gone", F.lit(1.0)), new.withColumn("value", F.col("value") + 10), ["value", "gone"], ["event_type"]))


# --- panels


def weekly(spark, sf) -> DataFrame:
    """(series, ds, y): weekly quantity by return flag."""
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("ds"))
    return rows.agg(F.sum("l_quantity").alias("y"))


def weekly_regular(spark, sf) -> DataFrame:
    return panel.regular(weekly(spark, sf), "W")


_WEEKLY = """w as (select l_returnflag series, date_trunc('week', l_shipdate)::timestamp ds, sum(l_quantity) y from lineitem group by 1, 2),
g as (select series, unnest(generate_series(min(ds), max(ds), interval 7 day)) ds from w group by 1), j as (select g.series, g.ds, y from g left join w using (series, ds)),
k as (select *, last_value(y ignore nulls) over b y0, last_value(case when y is not null then ds end ignore nulls) over b t0, first_value(y ignore nulls) over a y1, first_value(case when y is not null then ds end ignore nulls) over a t1 from j
  window b as (partition by series order by ds rows between unbounded preceding and current row), a as (partition by series order by ds rows between current row and unbounded following)),
p as (select series, ds, coalesce(y, y0 + (y1 - y0) * epoch(ds - t0) / epoch(t1 - t0)) y, y is null y_was_filled from k)"""


@query("select event_type series, date_trunc('day', ts)::timestamp ds, count(*) n, round(sum(value), 4) y from events group by 1, 2")
def panel_daily(spark, sf):
    days = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("series"), days.alias("ds")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("y"))


@query(f"with {_WEEKLY} select series, ds, round(y, 4) y, y_was_filled from p")
def panel_grid_fill(spark, sf):
    return rounded(weekly_regular(spark, sf), 4)


@query(f"with {_WEEKLY} select series, count(*) n, min(ds) \"first\", max(ds) \"last\", round(avg(y), 4) mean, round(avg(y_was_filled::int) * 100, 6) filled_pct from p group by 1")
def panel_summary(spark, sf):
    s = panel.summary(weekly_regular(spark, sf))
    return s.select("series", "n", "first", "last", F.round("mean", 4).alias("mean"), F.round("filled_pct", 6).alias("filled_pct"))


def orders_daily(spark, sf) -> DataFrame:
    rows = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ds"))
    return rows.agg(F.count("*").cast("double").alias("y"))


@query("""with d as (select o_orderpriority series, date_trunc('day', o_orderdate) ds, count(*)::double y from orders group by 1, 2),
s as (select series, count(distinct ds) n, date_diff('day', min(ds), max(ds)) + 1 n_grid, stddev_pop(y) sd from d group by 1)
select series, n, n_grid::int n_grid, round(1 - n / n_grid, 6) gap, round(sd, 6) sd, case when n < 3 then 'too few times' when 1 - n / n_grid > .1 then 'too many gaps' when n_grid < 38 then 'too short' when sd = 0 then 'constant' end reason from s""")
def panel_guardrails(spark, sf):
    return rounded(panel.guarded(orders_daily(spark, sf), "D", 14))


@query("""select o_orderstatus ds, 'n' series, count(*)::double y from orders group by 1 union all select o_orderstatus, 'high', count(*) filter (o_totalprice > 200000) from orders group by 1""")
def wide_to_long(spark, sf):
    wide = read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("ds")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("o_totalprice") > 200000).cast("double").alias("high"))
    return panel.wide_to_long(wide, "ds", ["n", "high"])


@query(f"with {_WEEKLY} select ds, round(max(y) filter (series = 'A'), 4) a, round(max(y) filter (series = 'N'), 4) n, round(max(y) filter (series = 'R'), 4) r from p group by 1")
def long_to_wide(spark, sf):
    wide = panel.long_to_wide(weekly_regular(spark, sf), ["A", "N", "R"])
    return rounded(wide.select("ds", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r")), 4)


@query(f"""with {_WEEKLY}, d as (select series, (epoch(ds) - epoch(lag(ds) over (partition by series order by ds)))::bigint s from w), c as (select series, s, count(*) n from d where s > 0 group by 1, 2)
select series, s as "seconds" from (select *, row_number() over (partition by series order by n desc, s) r from c) where r = 1""")
def freq_infer(spark, sf):
    return panel.inferred_steps(weekly(spark, sf))


@query("select unnest(['D', 'W', 'MS', 'min', 'min30', 'h2']) step, unnest(['7,365', '52', '12', '60,1440', '2,48', '12,84']) seasons")
def season_candidates(spark, sf):
    asked = [("D", "D", 1), ("W", "W", 1), ("MS", "MS", 1), ("min", "min", 1), ("min30", "min", 30), ("h2", "h", 2)]
    return spark.createDataFrame([(name, ",".join(map(str, panel.season_candidates(step, k)))) for name, step, k in asked], "step string, seasons string")


def _edges(spark, sf) -> DataFrame:
    nations = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")).unionAll(read(spark, sf, "region").select(F.lit("TOTAL").alias("parent"), F.col("r_name").alias("child")))


@query("""select r_name node, n_name leaf from nation join region on n_regionkey = r_regionkey union select 'TOTAL', n_name from nation union select n_name, n_name from nation""")
def hierarchy_closure(spark, sf):
    return panel.closure(spark, _edges(spark, sf))


def nation_years(spark, sf) -> DataFrame:
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("series"), F.year("o_orderdate").alias("ds")).agg(F.count("*").cast("double").alias("y"))


_YEARS = """y as (select n_name, r_name, year(o_orderdate)::int ds, count(*)::double y from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3)"""


@query(f"""with {_YEARS} select n_name series, ds, y from y union all select r_name, ds, sum(y) from y join (select n_regionkey, r_name, count(*) k from nation join region on n_regionkey = r_regionkey group by 1, 2) using (r_name) group by r_name, ds, k having count(*) = k
union all select 'TOTAL', ds, sum(y) from y group by ds having count(*) = (select count(*) from nation)""")
def hierarchy_rollup(spark, sf):
    return panel.with_parents(nation_years(spark, sf), _edges(spark, sf))


# --- seasons, features, calendars


def _strength_sql(m: int) -> str:
    return f"""n as (select *, row_number() over (partition by series order by ds) - 1 "at", avg(y) over f trend, count(y) over f inf from p window f as (partition by series order by ds rows between {m // 2} preceding and {(m + 1) // 2 - 1} following)),
d as (select series, "at", y, case when inf >= {max(3, m // 2)} then y - trend end d from n), r as (select *, d - avg(d) over (partition by series, "at" % {m}) r from d),
v as (select series, count(*) n, count(d) ok, var_pop(d) vd, var_pop(r) vr, stddev_pop(y) sd from r group by 1)
select series, n, round(case when n >= {3 * m} and sd > 0 and ok >= {3 * m // 2} and {m} < ok then greatest(0, (greatest(0, 1 - vr / vd) - {m}::double / ok) / (1 - {m}::double / ok)) else 0 end, 6) strength from v"""


@query(f"with {_WEEKLY}, {_strength_sql(52)}")
def season_strength(spark, sf):
    return rounded(season.strength(weekly_regular(spark, sf), 52))


@query(f"with {_WEEKLY}, {_strength_sql(4)}")
def season_strength_even(spark, sf):
    return rounded(season.strength(weekly_regular(spark, sf), 4))


_LAGS = "lag(y, 1) over o y_lag1, lag(y, 7) over o y_lag7, case when count(y) over b = 7 then avg(y) over b end y_mean7, case when count(y) over b = 7 then stddev_samp(y) over b end y_sd7"


@query(f"""with {_WEEKLY}, l as (select series, ds, {_LAGS} from p window o as (partition by series order by ds), b as (partition by series order by ds rows between 7 preceding and 1 preceding))
select series, ds, round(y_lag1, 4) y_lag1, round(y_lag7, 4) y_lag7, round(y_mean7, 4) y_mean7, round(y_sd7, 4) y_sd7 from l""")
def lag_roll_features(spark, sf):
    return rounded(forecast.lag_features(weekly_regular(spark, sf), [1, 7], [7]).drop("y", "y_was_filled"), 4)


@query("""select distinct d ds, round(sin(2 * pi() * t / 365.25), 6) + 0.0::double sin1, round(cos(2 * pi() * t / 365.25), 6) + 0.0::double cos1, round(sin(4 * pi() * t / 365.25), 6) + 0.0::double sin2, round(cos(4 * pi() * t / 365.25), 6) + 0.0::double cos2
from (select o_orderdate::date d, date_diff('day', date '1970-01-01', o_orderdate::date)::double t from orders)""")
def fourier_features(spark, sf):
    days = read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("ds")).distinct()
    return rounded(days.select("ds", *[c.alias(n) for n, c in fourier(F.unix_date("ds").cast("double"), 365.25, 2).items()]))


_DAYS = ", ".join(f"(date '{d}')" for d in us_holidays(1995, 2001))


@query(f"""with h as (select * from (values {_DAYS}) v(h)), d as (select distinct o_orderdate::date ds from orders)
select ds, (ds in (select h from h))::int is_holiday, (ds + 1 in (select h from h))::int day_before_holiday, (ds - 1 in (select h from h))::int day_after_holiday from d""")
def holiday_flags_daily(spark, sf):
    return holiday_flags(read(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("ds")).distinct(), "ds", us_holidays(1995, 2001))


# --- forecasts and backtests

HORIZON, FOLDS, SEASON = 4, 3, 52
_Z = forecast.z_of(0.90)
_FOLDS = f"""{_WEEKLY}, c as (select k fold, (select max(ds) from p) - ({FOLDS} + 1 - k) * {HORIZON} * interval 7 day cutoff from (select unnest(range(1, {FOLDS} + 1)) k)),
f as (select fold, series, ds, y, y_was_filled, ds <= cutoff is_train from p, c),
q as (select *, case when not is_train then row_number() over (partition by fold, series, is_train order by ds) end step from f),
t as (select *, y - lag(y) over o d1, y - lag(y, {SEASON}) over o d52, row_number() over o at_, count(*) over (partition by fold, series) size from q where is_train window o as (partition by fold, series order by ds)),
m as (select fold, series, count(*) n, max_by(y, ds) l, min_by(y, ds) fst, stddev_pop(d1) s1, stddev_pop(d52) sm, list(y order by ds) ys, avg(abs(d52)) scale from t group by 1, 2),
h as (select *, unnest(range(1, {HORIZON} + 1)) h from m),
b as (select 'Naive' model, fold, series, h, l yhat, {_Z} * s1 * sqrt(h) w from h union all
  select 'Drift', fold, series, h, l + (l - fst) / (n - 1) * h, {_Z} * s1 * sqrt(h * (1 + h / (n - 1))) from h union all
  select 'SeasonalNaive', fold, series, h, ys[len(ys) - {SEASON} + (h - 1) % {SEASON} + 1], {_Z} * sm * sqrt(floor((h - 1) / {SEASON}) + 1) from h),
a as (select fold, series, step, y from q where not is_train and step <= {HORIZON} and not y_was_filled),
e as (select model, fold, series, h, y, yhat, w, abs(y - yhat) e, scale from a join b using (fold, series) join m using (fold, series) where step = h),
s as (select model, fold, series, count(*) n, avg(e) / max(scale) mase, avg(2 * e / (abs(y) + abs(yhat))) smape, sum(e) / sum(abs(y)) wape, sqrt(avg(e * e)) rmse, avg(e) mae, avg((abs(y - yhat) <= w)::int) coverage from e group by 1, 2, 3)"""


def _folds(spark, sf) -> DataFrame:
    p = weekly_regular(spark, sf)
    return forecast.folded(p, forecast.cutoffs(p, "W", HORIZON, FOLDS))


def _backtest(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = _folds(spark, sf)
    return rows, forecast.baselines(rows, HORIZON, SEASON)


def _model(name: str):
    def run(spark, sf):
        _, found = _backtest(spark, sf)
        return rounded(found.filter(F.col("model") == name), 4)

    run.__name__ = {"Naive": "fc_naive", "SeasonalNaive": "fc_snaive", "Drift": "fc_drift"}[name]
    query(f"with {_FOLDS} select model, fold::int fold, series, h::int step, round(yhat, 4) yhat, round(yhat - w, 4) lo, round(yhat + w, 4) hi from b where model = '{name}'")(run)


for _name in ("Naive", "SeasonalNaive", "Drift"):
    _model(_name)


@query(f"with {_FOLDS} select model, fold::int fold, series, n, round(mase, 6) mase, round(smape, 6) smape, round(wape, 6) wape, round(rmse, 4) rmse, round(mae, 4) mae, round(coverage, 6) coverage from s")
def backtest_metrics(spark, sf):
    s = forecast.scored(*_backtest(spark, sf), HORIZON, SEASON)
    return s.select("model", "fold", "series", "n", *[F.round(c, 4 if c in ("rmse", "mae") else 6).alias(c) for c in forecast.METRICS])


@query(f"""with {_FOLDS}, o as (select model, fold, avg(mase) mase, avg(smape) smape, avg(wape) wape, avg(rmse) rmse, avg(mae) mae, avg(coverage) coverage from s group by 1, 2)
select model, round(avg(mase), 6) mase, round(avg(smape), 6) smape, round(avg(wape), 6) wape, round(avg(rmse), 4) rmse, round(avg(mae), 4) mae, round(avg(coverage), 6) coverage from o group by 1""")
def backtest_leaderboard(spark, sf):
    board = forecast.leaderboard(forecast.scored(*_backtest(spark, sf), HORIZON, SEASON))
    return board.select("model", *[F.round(c, 4 if c in ("rmse", "mae") else 6).alias(c) for c in forecast.METRICS])


@query(f"with {_FOLDS} select 'Blend' model, fold::int fold, series, h::int step, round(avg(yhat), 4) yhat from b where model in ('Naive', 'SeasonalNaive') group by 2, 3, 4")
def blend_mean(spark, sf):
    _, found = _backtest(spark, sf)
    return rounded(forecast.blended(found, ["Naive", "SeasonalNaive"]).drop("lo", "hi"), 4)


@query(f"with {_FOLDS} select model, fold::int fold, series, h::int step, round(e, 4) error from e")
def residual_steps(spark, sf):
    return rounded(forecast.residuals(*_backtest(spark, sf), HORIZON), 4)


_WIDTHS = f"""qs as (select model, series, h, count(*) n, quantile_cont(e, .9) q from e group by 1, 2, 3), ps as (select model, h, count(*) n, quantile_cont(e, .9) q from e group by 1, 2),
ts as (select model, series, sum(n) total from qs group by 1, 2), us as (select ts.model, ts.series, ps.h, case when total >= {HORIZON} then coalesce(qs.n, 0) else ps.n end n, case when total >= {HORIZON} then qs.q else ps.q end q
  from ts join ps using (model) left join qs on qs.model = ts.model and qs.series = ts.series and qs.h = ps.h),
wd as (select model, series, h, n, max(q) over (partition by model, series order by h) width, case when n > 0 then n / (n + 1) end attainable from us)"""


@query(f"with {_FOLDS}, {_WIDTHS} select model, series, h::int step, n::bigint n, round(width, 4) width, round(attainable, 6) attainable from wd")
def half_widths(spark, sf):
    rows, found = _backtest(spark, sf)
    w = forecast.half_widths(forecast.residuals(rows, found, HORIZON))
    return w.select("model", "series", "step", "n", F.round("width", 4).alias("width"), F.round("attainable", 6).alias("attainable"))


@query(f"with {_FOLDS}, {_WIDTHS} select model, series, h::int step, round(yhat, 4) yhat, round(yhat - width, 4) lo, round(yhat + width, 4) hi from b join wd using (model, series, h) where fold = {FOLDS}")
def residual_bands(spark, sf):
    rows, found = _backtest(spark, sf)
    w = forecast.half_widths(forecast.residuals(rows, found, HORIZON))
    return rounded(forecast.banded(found.filter(F.col("fold") == FOLDS).drop("fold"), w).select("model", "series", "step", "yhat", "lo", "hi"), 4)


@query(f"""with {_FOLDS}, x as (select model, fold, avg(mase) v from s group by 1, 2), mm as (select model, avg(v) m from x group by 1), best as (select model from mm order by m, model limit 1),
pr as (select x.model, avg(x.v) m, avg(y.v) bm, stddev_samp(x.v - y.v) / sqrt(count(*)) band from x join x y on x.fold = y.fold and y.model = (select model from best) group by 1),
z as (select *, case model when 'Naive' then 1 when 'SeasonalNaive' then 2 else 3 end complexity, m - bm <= band near from pr)
select model, complexity, round(m, 6) mean, round(band, 6) band, model = (select model from best) is_best, row_number() over (order by near desc, complexity, m, model) = 1 is_picked from z""")
def parsimony_select(spark, sf):
    scores = forecast.scored(*_backtest(spark, sf), HORIZON, SEASON).groupBy("model", "fold").agg(F.avg("mase").alias("score"))
    size = F.when(F.col("model") == "Naive", 1).when(F.col("model") == "SeasonalNaive", 2).otherwise(3)
    return rounded(select.picked_table(scores.withColumn("complexity", size)))


# --- reconciliation


def _incoherent(spark, sf) -> DataFrame:
    """Predictions (ds, series, yhat) of nations, regions and the total that do not add up: last year's values, parents off by a tenth."""
    years = panel.with_parents(nation_years(spark, sf), _edges(spark, sf))
    low = read(spark, sf, "nation").select(F.col("n_name").alias("leaf"))
    marked = years.join(low, years.series == low.leaf, "left")
    return marked.select("ds", "series", F.when(F.col("leaf").isNull(), F.col("y") * 1.1).otherwise(F.col("y")).alias("yhat"))


_INCOHERENT = f"""{_YEARS}, i as (select ds, n_name series, y yhat from y union all select ds, r_name, sum(y) * 1.1 from y join (select r_name, count(*) k from nation join region on n_regionkey = r_regionkey group by 1) using (r_name) group by r_name, ds, k having count(*) = k
union all select ds, 'TOTAL', sum(y) * 1.1 from y group by ds having count(*) = (select count(*) from nation))"""


def _summing(spark, sf):
    edges = [(r.parent, r.child) for r in _edges(spark, sf).collect()]
    names = sorted({x for e in edges for x in e})
    return names, *reconcile.summing(edges, names)


@query(f"""with {_INCOHERENT}, lf as (select ds, n_name, r_name, y from y) select ds, n_name series, round(y, 6) yhat from lf
union all select ds, r_name, round(sum(y), 6) from lf where (ds, r_name) in (select (ds, series) from i) group by 1, 2 union all select ds, 'TOTAL', round(sum(y), 6) from lf where ds in (select ds from i where series = 'TOTAL') group by 1""")
def recon_bottom_up(spark, sf):
    names, leaves, matrix = _summing(spark, sf)
    return rounded(reconcile.applied(_incoherent(spark, sf), reconcile.projection(matrix, leaves, names, "bottom_up"), names))


@query(f"""with {_INCOHERENT}, ed as (select r_name parent, n_name child from nation join region on n_regionkey = r_regionkey union all select 'TOTAL', r_name from region),
s as (select parent, i.ds, sum(yhat) s from i join ed on i.series = child group by 1, 2) select parent, round(avg(abs(s - yhat)) / (avg(abs(yhat)) + 1e-12), 6) gap from s join i on i.series = parent and i.ds = s.ds group by 1""")
def coherency_gap(spark, sf):
    return rounded(reconcile.coherency_gap(_incoherent(spark, sf), _edges(spark, sf)))


# Closed forms for this tree of 5 regions with 5 nations each: with B the regions' blocks of ones and J all ones,
# (I + B + J)^-1 = I - B/6 - J/186, and (I + B/5 + J/25)^-1 = I - B/10 - J/150.
_TREE = """with {i}, z as (select ds, n_name, r_name, y.y + r.yhat / {r} + t.yhat / {t} z from y join i r using (ds) join i t using (ds) where r.series = r_name and t.series = 'TOTAL'),
lf as (select ds, n_name, r_name, z - sum(z) over (partition by ds, r_name) / {b} - sum(z) over (partition by ds) / {j} v from z)
select ds, n_name series, round(v, 4) yhat from lf union all select ds, r_name, round(sum(v), 4) from lf group by 1, 2 union all select ds, 'TOTAL', round(sum(v), 4) from lf group by 1"""


@query(_TREE.format(i=_INCOHERENT, r="1.0::double", t="1.0::double", b=6, j=186))
def recon_ols(spark, sf):
    names, leaves, matrix = _summing(spark, sf)
    return rounded(reconcile.applied(_incoherent(spark, sf), reconcile.projection(matrix, leaves, names, "ols"), names), 4)


@query(_TREE.format(i=_INCOHERENT, r="5.0::double", t="25.0::double", b=10, j=150))
def recon_wls(spark, sf):
    names, leaves, matrix = _summing(spark, sf)
    return rounded(reconcile.applied(_incoherent(spark, sf), reconcile.projection(matrix, leaves, names, "wls_struct"), names), 4)


@query()
def recon_mint(spark, sf):
    names, leaves, matrix = _summing(spark, sf)
    rows = _incoherent(spark, sf)
    errors = rows.select(F.col("ds").alias("fold"), F.lit(1).alias("step"), "series", (F.col("yhat") * 0.05 * F.sin(F.col("ds").cast("double") + F.length("series"))).alias("error"))
    return rounded(reconcile.applied(rows, reconcile.projection(matrix, leaves, names, "mint_shrink", reconcile.error_matrix(errors, names)), names))


# With two observations a series' errors give its variance alone: here that of as many leaves as it has.
@query(_TREE.format(i=_INCOHERENT, r="5.0::double", t="25.0::double", b=10, j=150))
def recon_mint_diagonal(spark, sf):
    import numpy as np

    names, leaves, matrix = _summing(spark, sf)
    apart = np.sqrt(matrix.sum(axis=1))
    return rounded(reconcile.applied(_incoherent(spark, sf), reconcile.projection(matrix, leaves, names, "mint_shrink", np.stack([apart, -apart])), names), 4)


# --- explanation and blends, with models whose predictions SQL can give


@query("""with g as (select o_orderstatus, o_orderpriority, avg(o_totalprice) p from orders group by 1, 2), k as (select o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
  row_number() over (order by md5(o_orderkey || '-own'), o_orderkey) a, row_number() over (order by md5(o_orderkey || '-p'), o_orderkey) b from orders), o as (select avg((o_totalprice - p) ** 2) m from orders join g using (o_orderstatus, o_orderpriority))
select 'o_orderpriority' feature, round((avg((x.o_totalprice - p) ** 2) - (select m from o)) / 1e6, 2) importance from k x join k y on x.a = y.b join g on x.o_orderstatus = g.o_orderstatus and y.o_orderpriority = g.o_orderpriority""")
def perm_importance_md5(spark, sf):
    from sparkloom.operators import models

    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("label"))
    means = F.broadcast(rows.groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("label").alias("p")))  # fifteen cells
    loss = lambda df: models.score(df.join(means, ["o_orderstatus", "o_orderpriority"]), "regression") ** 2
    found = loss(models.permuted(rows, "o_orderkey", "o_orderpriority", "p")) - loss(rows)
    return spark.createDataFrame([("o_orderpriority", round(found / 1e6, 2))], "feature string, importance double")


_LINE = "r as (select regr_slope(o_totalprice, c_acctbal) a, regr_intercept(o_totalprice, c_acctbal) b from orders join customer on o_custkey = c_custkey)"


def _line(spark, sf):
    """A least squares line as a pipeline, its columns and rows."""
    from sparkloom.operators import models

    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_acctbal", F.col("o_totalprice").alias("label"))
    columns = models.Columns(["c_acctbal"])
    return models.fitted(rows, columns, models.roster("regression")["Ridge"], {"reg": 0.0}), columns, rows


@query(f"""with {_LINE}, g as (select distinct unnest(quantile_cont(c_acctbal, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) x from orders join customer on o_custkey = c_custkey)
select round(x, 2) x, round(a * x + b, 2) mean_prediction from g, r""")
def pdp_grid(spark, sf):
    from sparkloom.operators import models

    model, columns, rows = _line(spark, sf)
    return rounded(models.partial_dependence(model, rows, columns, "regression", "c_acctbal"), 2)


@query(f"with {_LINE} select o_orderkey, round(a * c_acctbal + b, 2) p from orders join customer on o_custkey = c_custkey, r")
def ml_least_squares(spark, sf):
    from sparkloom.operators import models

    model, columns, rows = _line(spark, sf)
    return models.predicted(model, rows, columns, "regression").select("o_orderkey", F.round("p", 2).alias("p"))


@query(f"""with {_LINE}, x as (select abs(a) * abs(c_acctbal - avg(c_acctbal) over ()) d from orders join customer on o_custkey = c_custkey, r) select 'c_acctbal' feature, round(avg(d), 2) contribution from x""")
def linear_contributions(spark, sf):
    from sparkloom.operators import models

    model, columns, rows = _line(spark, sf)
    return spark.createDataFrame([(f, round(v, 2)) for f, v in models.contributions(model, rows, columns)], "feature string, contribution double")


def _votes(spark, sf) -> DataFrame:
    """(o_orderkey, p): the mean of two models, each the mean of an order's cell."""
    from sparkloom.operators import models

    orders = read(spark, sf, "orders")
    parts = [orders.join(orders.groupBy(c).agg(F.avg("o_totalprice").alias("p")), c).select("o_orderkey", "p") for c in ("o_orderpriority", "o_orderstatus")]
    return models.voted(parts, "o_orderkey")


@query("""with p as (select o_orderkey, avg(o_totalprice) over (partition by o_orderpriority) a, avg(o_totalprice) over (partition by o_orderstatus) b from orders) select o_orderkey, round((a + b) / 2, 2) vote from p""")
def stack_vote_avg(spark, sf):
    return _votes(spark, sf).select("o_orderkey", F.round("p", 2).alias("vote"))


# --- events: windows, sessions, JSON; vectors


@query("""select event_type, time_bucket(interval 1 hour, ts)::timestamp start, count(*) n, round(sum(value), 4) total from events group by 1, 2""")
def tumbling_windows(spark, sf):
    rows = read(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    by = rows.groupBy("event_type", F.window("t", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end nw from events), s as (select *, sum(nw) over (partition by user_id order by ts) k from g)
select user_id, min(ts) start, count(*) n, round(sum(value), 4) total from s group by user_id, k""")
def session_windows(spark, sf):
    rows = read(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    by = rows.groupBy("user_id", F.session_window("t", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""select (props::json ->> 'k')::int k, count(*) n, round(avg(value), 6) mean from events group by 1""")
def json_props(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return read(spark, sf, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""with c as (select label, i, avg(embedding[i]::double) m from embeddings, range(1, 65) t(i) group by 1, 2), s as (select vec_id, e.label, c.label predicted, sum((embedding[i]::double - m) ** 2) d from embeddings e, c group by 1, 2, 3),
r as (select *, row_number() over (partition by vec_id order by d, predicted) k from s) select vec_id, label, predicted from r where k = 1""")
def embeddings_centroid_label(spark, sf):
    rows = read(spark, sf, "embeddings")
    long = rows.select("label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    all_means = means.agg(F.array_sort(F.collect_list(F.struct("label", F.transform("c", lambda x: x["m"]).alias("m")))).alias("all")).first()["all"]  # a row for each label
    table = F.array(*[F.struct(F.lit(r["label"]).alias("label"), F.array(*[F.lit(x) for x in r["m"]]).alias("m")) for r in all_means])
    distance = lambda m: F.aggregate(F.zip_with("embedding", m, lambda a, b: (a.cast("double") - b) ** 2), F.lit(0.0), lambda s, x: s + x)
    nearest = F.array_min(F.transform(table, lambda c: F.struct(distance(c["m"]).alias("d"), c["label"].alias("label"))))
    return rows.select("vec_id", "label", nearest["label"].alias("predicted"))


@query("""select old, new from (values ('x[1]<weird>', 'x_1__weird_'), ('x,2', 'x_2'), ('plain', 'plain'), ('y:', 'y_'), ('y_', 'y__1')) v(old, new) where old <> 'y_' union all select 'y__1', 'y__1'""")
def name_cleaning(spark, sf):
    return spark.createDataFrame(list(clean_names(["x[1]<weird>", "x,2", "plain", "y:", "y__1"]).items()), "old string, new string")


# --- regressors, calendars and matrices of forecasts


@query(f"""with {_WEEKLY}, x as (select series, ds, case when month(ds) % 3 = 0 then month(ds) end promo from p)
select series, ds, coalesce(last_value(promo ignore nulls) over (partition by series order by ds rows between unbounded preceding and current row),
  first_value(promo ignore nulls) over (partition by series order by ds rows between current row and unbounded following))::int promo from x""")
def regressor_fill(spark, sf):
    rows = weekly_regular(spark, sf).select("series", "ds", F.when(F.month("ds") % 3 == 0, F.month("ds")).alias("promo"))
    return panel.filled_regressors(rows, ["promo"])


@query("""with f as (select o_orderpriority, min((o_orderdate, o_orderkey)) a from orders group by 1) select o_orderpriority, (row_number() over (order by a) - 1)::int code from f""")
def categorical_codes(spark, sf):
    return panel.codes(read(spark, sf, "orders"), "o_orderpriority", ["o_orderdate", "o_orderkey"])


@query(f"with {_FOLDS} select fold::int fold, cutoff::timestamp cutoff from c")
def backtest_cutoffs(spark, sf):
    p = weekly_regular(spark, sf)
    return forecast.cutoffs(p, "W", HORIZON, FOLDS)


@query(f"""with {_WEEKLY} select distinct ds, (isodow(ds) - 1)::int dayofweek, month(ds)::int "month", day(ds)::int "day", round(sin(2 * pi() * dayofyear(ds) / 365.25), 6) + 0.0::double sin1, round(cos(2 * pi() * dayofyear(ds) / 365.25), 6) + 0.0::double cos1 from p""")
def calendar_features(spark, sf):
    days = weekly_regular(spark, sf).select("ds").distinct()
    parts = date_parts(F.col("ds"))
    return rounded(days.select("ds", *[parts[p].alias(p) for p in ("dayofweek", "month", "day")], *[c.alias(n) for n, c in fourier(F.dayofyear("ds").cast("double"), 365.25, 1).items()]))


@query("""select c_custkey, (c_mktsegment = 'BUILDING')::int building, (c_mktsegment = 'MACHINERY')::int machinery from customer""")
def one_hot_columns(spark, sf):
    rows = read(spark, sf, "customer")
    hot = encode.one_hot(rows, "c_mktsegment", ["BUILDING", "MACHINERY"])
    return rows.select("c_custkey", *hot).toDF("c_custkey", "building", "machinery")


@query(f"""with {_FOLDS}, x as (select fold, h, series, e from e where model = 'Naive' and not (series = 'A' and h = 2))
select fold::int fold, h::int step, round(coalesce(max(e) filter (series = 'A'), (select avg(e) from x i where i.fold = x.fold and series = 'A')), 4) a, round(max(e) filter (series = 'N'), 4) n, round(max(e) filter (series = 'R'), 4) r from x group by 1, 2, x.fold""")
def fold_error_matrix(spark, sf):
    rows, found = _backtest(spark, sf)
    errors = forecast.residuals(rows, found.filter(F.col("model") == "Naive"), HORIZON).filter(~((F.col("series") == "A") & (F.col("step") == 2)))
    x = reconcile.error_matrix(errors, ["A", "N", "R"])
    keys = [(k, h) for k in range(1, FOLDS + 1) for h in range(1, HORIZON + 1)]
    return rounded(spark.createDataFrame([(k, h, *map(float, v)) for (k, h), v in zip(keys, x)], "fold int, step int, a double, n double, r double"), 4)


@query("""select 'Vote' model, count(*) n, round(sqrt(avg((y - (a + b) / 2) ** 2)), 2) rmse from (select o_totalprice y, avg(o_totalprice) over (partition by o_orderpriority) a, avg(o_totalprice) over (partition by o_orderstatus) b from orders)""")
def vote_score(spark, sf):
    votes = _votes(spark, sf).join(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return metrics.regression(votes, "o_totalprice", "p").select(F.lit("Vote").alias("model"), "n", F.round("rmse", 2).alias("rmse"))


# --- fitted models: no SQL form, tested for their accuracy


def _quality(spark, sf) -> DataFrame:
    docs = read(spark, sf, "documents")
    rows = read(spark, sf, "labels").join(docs, "doc_id")
    symbols = F.length("text") - F.length(F.regexp_replace("text", r"[^\w\s.,]", ""))
    made = rows.select(F.col("doc_id").cast("string").alias("__rid"), F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("n_chars"), (symbols / F.length("text")).alias("symbols"), "lang")
    # texts are read once; models go over the few numbers of a row many times, in as many parts as there are cores, or more where rows are many
    made = settled(made)
    parts = max(spark.sparkContext.defaultParallelism, made.count() // 250_000)
    return settled(split.folds(made, "__rid", 3, "label").repartition(parts, "__rid"))


def _fit_query(name: str, family: str):
    from sparkloom.operators import models

    def run(spark, sf):
        columns = models.Columns(["n_chars", "symbols"], ["lang"])
        rows = _quality(spark, sf)
        out = models.out_of_fold(rows, columns, models.roster("classification")[family], "classification", 3)
        return out.select(F.col("__rid").cast("long").alias("doc_id"), "label", F.round("p", 4).alias("p"))

    run.__name__ = name
    query()(run)


for _n, _f in (("ml_logreg", "LogisticRegression"), ("ml_rf", "RandomForest"), ("ml_gbt", "GradientBoosting")):
    _fit_query(_n, _f)


@query()
def ml_glm_poisson(spark, sf):
    from sparkloom.operators import models

    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    rows = lines.select(F.col("l_orderkey").cast("string").alias("__rid"), F.col("n").cast("double").alias("label"), F.col("q").alias("q"))
    columns = models.Columns(["q"])
    model = models.fitted(rows, columns, models.roster("regression", objective="poisson")["PoissonGLM"])
    return metrics.regression(models.predicted(model, rows, columns, "regression"), "label", "p")


_LARGE = "select l_orderkey, count(*) n, (sum(l_quantity) > 80)::int large from lineitem group by 1"


def _large_orders(spark, sf) -> DataFrame:
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("n"), (F.sum("l_quantity") > 80).cast("double").alias("large"))
    return lines.withColumn("__rid", F.col("l_orderkey").cast("string"))


# With one feature of two values, a model with a constant gives each of them its mean.
@query(f"with o as ({_LARGE}) select large, count(*) n, round(avg(n), 3) p from o group by 1")
def ml_glm_poisson_cells(spark, sf):
    from sparkloom.operators import models

    rows, columns = _large_orders(spark, sf).withColumnRenamed("n", "label"), models.Columns(["large"])
    model = models.fitted(rows, columns, models.roster("regression", objective="poisson")["PoissonGLM"], {"reg": 0.0})
    found = models.predicted(model, rows, columns, "regression").groupBy("large").agg(F.count("*").alias("n"), F.round(F.avg("p"), 3).alias("p"))
    return found.select(F.col("large").cast("int").alias("large"), "n", "p")


@query(f"with o as ({_LARGE}) select large, count(*) n, round(avg((n > 4)::int), 3) p from o group by 1")
def ml_logreg_cells(spark, sf):
    from sparkloom.operators import models

    rows, columns = _large_orders(spark, sf).withColumn("label", (F.col("n") > 4).cast("double")), models.Columns(["large"])
    model = models.fitted(rows, columns, models.roster("classification")["LogisticRegression"], {"reg": 0.0})
    found = models.predicted(model, rows, columns, "classification").groupBy("large").agg(F.count("*").alias("n"), F.round(F.avg("p"), 3).alias("p"))
    return found.select(F.col("large").cast("int").alias("large"), "n", "p")


def _fc_query(name: str, model: str):
    from sparkloom.operators import statmodels

    def run(spark, sf):
        rows = _folds(spark, sf)
        found = statmodels.forecasts(forecast.training(rows), model, HORIZON, SEASON)
        return forecast.leaderboard(forecast.scored(rows, found, HORIZON, SEASON))

    run.__name__ = name
    query()(run)


for _n, _f in (("fc_ets", "ETS"), ("fc_theta", "Theta"), ("fc_arima", "ARIMA"), ("fc_harmonic", "Harmonic")):
    _fc_query(_n, _f)


@query()
def fc_global_gbt(spark, sf):
    from sparkloom.operators import globalml

    return globalml.forecast(weekly_regular(spark, sf), "W", 2, 4, trees=10, depth=3)
