"""Exact top-k search by inner product, by the three-phase uniform threshold algorithm.

The components of a vector are dealt to m lists; an object's score is the sum of its
partial scores, one from each list. For every query:

1. every list of a block of rows gives its k best partial scores; the objects seen there
   are scored, and the k-th best score over all blocks is a safe cutoff c: k objects reach it.
2. the cutoff goes back to all blocks, and each list gives all entries with a partial score
   of at least c / m. An object in none of the lists has a score under c.
3. objects whose known partial scores, plus c / m for each list that did not name them,
   stay under c are dropped; the remaining scores are resolved exactly.

In the second phase lists are read one after the other: what a list can add to a score is at
most the product of both norms there, so the pairs that cannot reach the cutoff any more are
not scored further.

Rows and queries are dealt in blocks; each block of rows meets each block of queries once
a phase, by an equal join on the block's number. A block gives k rows a query at most,
the best by score and then key, so ties and equal vectors do not swell the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import lean, ship, written

K, LISTS = 20, 2
#: Rows of a block at most, on the mean; queries likewise.
ROWS, QUERIES = 4096, 1024
#: Scores held at once in a task.
SCORES = 4 << 20


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as double; null for a vector that is null or holds a null, NaN or infinity."""
    whole = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() gives a long; from 2 ** 53 on a double is whole anyway
    return F.when(whole, F.transform(vector, lambda x: F.when(F.abs(F.lit(scale) * x) < 2.0**53, F.floor(F.lit(scale) * x.cast("double")).cast("double")).otherwise(F.lit(scale) * x.cast("double"))))


def in_blocks(rows: DataFrame, name: str, mean: int) -> tuple[DataFrame, int]:
    """((name, rids, ids, matrix, width), number of blocks): the rows (rid, id, v) in blocks, dealt by hash; rows that repeat are dealt apart."""
    n = rows.count()
    blocks = max(1, -(-n // mean))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "rid"), F.lit(blocks)).cast("int"))
    packs = dealt.groupBy(name).agg(F.collect_list(F.struct("rid", "id", "v")).alias("p"))
    return packs.select(name, F.col("p.rid").alias("rids"), F.col("p.id").alias("ids"), F.flatten("p.v").alias("matrix"), F.size(F.element_at("p.v", 1)).alias("width")), blocks


def _sides(batch: pa.RecordBatch, i: int) -> Iterator[tuple]:
    """(rids, ids, rows, rids of queries, queries, their places), rows in order of id and then rid."""
    width = batch.column("width")[i].as_py()
    rids, ids, q_rids = (np.asarray(batch.column(c)[i].values) for c in ("rids", "ids", "q_rids"))
    rows, queries = (np.asarray(batch.column(c)[i].values).reshape(len(x), width) for c, x in (("matrix", ids), ("q_matrix", q_rids)))
    order = np.lexsort((rids, ids))
    rids, ids, rows = rids[order], ids[order], rows[order]
    step = max(1, SCORES // max(1, len(ids)))
    for at in range(0, len(q_rids), step):
        yield rids, ids, rows, q_rids[at : at + step], queries[at : at + step], slice(at, at + step)


def _cuts(width: int, lists: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, width, min(lists, max(1, width)) + 1).astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def _partial(rows: np.ndarray, queries: np.ndarray, lists: int) -> list[np.ndarray]:
    """Partial scores (queries x rows) of each list; exact, as sums of whole numbers below 2 ** 53."""
    return [queries[:, a:b] @ rows[:, a:b].T for a, b in _cuts(rows.shape[1], lists)]


def _best(score: np.ndarray, open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query place, row place) of each query's k best open entries by score, then place (rows are in order of id)."""
    q, r = np.nonzero(open_)
    order = np.lexsort((r, -score[q, r], q))
    q, r = q[order], r[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], r[rank < k]


def seen_locally(batches: Iterator[pa.RecordBatch], k: int, lists: int) -> Iterator[pa.RecordBatch]:
    """Phase 1, a block of rows and one of queries: the k best scores of the objects that head a list, for each query."""
    for batch in batches:
        for i in range(batch.num_rows):
            for rids, _, rows, q_rids, queries, _ in _sides(batch, i):
                parts = _partial(rows, queries, lists)
                total = sum(parts)
                open_ = np.zeros(total.shape, dtype=bool)
                own = rids[None, :] == q_rids[:, None]
                for p in parts:
                    p[own] = -np.inf
                    head = np.argpartition(-p, min(k, p.shape[1] - 1), axis=1)[:, :k] if p.shape[1] > k else np.arange(p.shape[1])[None].repeat(len(p), 0)
                    np.put_along_axis(open_, head, True, axis=1)
                q, r = _best(total, open_ & ~own, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_rids[q]), pa.array(total[q, r])], ["q_rid", "score"])


def remaining(rows: np.ndarray, queries: np.ndarray, lists: int, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, score) of all pairs whose score reaches the query's cutoff.

    A list's partial scores are worked out while a pair can still reach the cutoff with what
    the norms allow the lists that are left; whole numbers, so a bound that is rounded has room.
    """
    cuts = _cuts(rows.shape[1], lists)
    bounds = [np.sqrt((queries[:, a:b] ** 2).sum(axis=1))[:, None] * np.sqrt((rows[:, a:b] ** 2).sum(axis=1))[None] * (1 + 1e-9) + 1e-3 for a, b in cuts]
    score = np.zeros((len(queries), len(rows)))
    open_ = sum(bounds) >= cut[:, None]
    for n, (a, b) in enumerate(cuts):
        rest = sum(bounds[n + 1 :]) if n + 1 < len(cuts) else 0.0
        some = np.flatnonzero(open_.any(axis=0))
        if 16 * np.count_nonzero(open_) < open_.size:  # few pairs are left: one by one
            q, r = np.nonzero(open_)
            score[q, r] += np.einsum("ij,ij->i", queries[q, a:b], rows[r, a:b])
        else:
            score[:, some] += queries[:, a:b] @ rows[some, a:b].T
        open_ &= score + rest >= cut[:, None]
    q, r = np.nonzero(open_)
    return q, r, score[q, r]


def resolved(batches: Iterator[pa.RecordBatch], k: int, lists: int) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: the entries that reach the cutoff, with exact scores; of a block the k best for each query."""
    for batch in batches:
        for i in range(batch.num_rows):
            cut = np.asarray(batch.column("cut")[i].values, dtype=np.float64)
            for rids, ids, rows, q_rids, queries, part in _sides(batch, i):
                q, r, score = remaining(rows, queries, lists, cut[part])
                other = rids[r] != q_rids[q]
                q, r, score = q[other], r[other], score[other]
                order = np.lexsort((r, -score, q))
                q, r, score = q[order], r[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([pa.array(q_rids[q[best]]), pa.array(ids[r[best]]), pa.array(rids[r[best]]), pa.array(score[best].astype(np.int64))], ["q_rid", "vec_id", "rid", "score"])


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, lists: int = LISTS, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but its own, by inner product of floor(64 * x).

    Scores are exact while they stay under 2 ** 53. Ties go to the smaller key; fewer rows than k give all. Vectors that are null or hold a
    null or non-finite component take no part, nor do rows with a null key. Every vector has
    the same number of components, else the query fails. Rows that repeat a key are rows of
    their own: each that asks has its own list, in which the others may stand. An empty table
    gives an empty one.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), quantised(F.col(f"`{vector}`")).alias("v"), is_query.alias("asks"))
    # written with the number of each row, so that it stays what it is
    whole = written(whole.filter("id is not null and v is not null").withColumn("rid", F.monotonically_increasing_id()), "topk-vectors")
    blocks, _ = in_blocks(whole.select("rid", "id", "v"), "rb", rows)
    asks, n_asks = in_blocks(whole.filter("asks").select("rid", "id", "v"), "qb", queries)
    asks = written(asks.select("qb", F.col("rids").alias("q_rids"), F.col("matrix").alias("q_matrix")), "topk-queries")
    dealt = written(blocks, "topk-blocks").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
    meeting = dealt.join(asks, "qb").repartition("rb", "qb")
    sides = ["rids", "ids", "matrix", "width", "q_rids", "q_matrix"]
    heads = meeting.select(*sides).mapInArrow(lean(lambda b: seen_locally(b, k, lists)), "q_rid long, score double")
    order = Window.partitionBy("q_rid").orderBy(F.desc("score"))
    last = heads.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).groupBy("q_rid").agg(F.min("score").alias("low"), F.max("n").alias("n"))
    cut = last.select(F.col("q_rid").alias("c_rid"), F.when(F.col("n") == k, F.col("low")).alias("cut"))
    named = asks.select("qb", F.posexplode("q_rids").alias("at", "c_rid")).join(cut, "c_rid", "left")
    cuts = named.groupBy("qb").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("cut", F.lit(float("-inf"))).alias("cut")))), lambda x: x["cut"]).alias("cut"))
    second = meeting.join(written(cuts, "topk-cuts"), "qb").repartition("rb", "qb")
    found = second.select(*sides, "cut").mapInArrow(lean(lambda b: resolved(b, k, lists)), "q_rid long, vec_id long, rid long, score long")
    rank = F.row_number().over(Window.partitionBy("q_rid").orderBy(F.desc("score"), "vec_id", "rid"))
    ranked = found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
    ids = whole.filter("asks").select(F.col("rid").alias("q_rid"), F.col("id").alias("query_id"))
    return ranked.join(ids, "q_rid").select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 20, k: int = K, table: str = "embeddings") -> str:
    """DuckDB SQL of the op3 query."""
    return f"""
with v as (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v from {table}
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.rid q, a.vec_id query_id, b.rid, b.vec_id, list_inner_product(a.v, b.v)::bigint score from v a join v b on a.vec_id % {every} = 0 and a.rid <> b.rid),
r as (select *, row_number() over (partition by q order by score desc, vec_id, rid) rank from s)
select query_id, rank::int rank, vec_id, score from r where rank <= {k}"""
