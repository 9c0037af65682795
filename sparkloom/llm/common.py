"""What the corpus operators share: tables, the shared folder, shipping code, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import shipped

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch: whole texts are long, and a worker holds a batch at a time.
BATCH_ROWS = 1000
#: Smallest neighbours are broadcast up to this many nodes.
NODES = 100_000
#: White space as the text contracts use it: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset (local tests), a temporary folder is chosen and set; a cluster
    has to name one, since a machine's own folder is not seen by the other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/sparkloom/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this package in the shared folder. Not while a result that reads them is still wanted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/sparkloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, and takes smaller Arrow batches for the session, unless the user has chosen: texts are long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    shipped(spark)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null gives the empty text.

    The plain lower() is several times as fast and equal to it for pure ASCII texts.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.bit_length(text) == 8 * F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def packed(df: DataFrame, *names: str) -> DataFrame:
    """df as one struct column ``row`` beside the named columns, so that no extra column can clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(row: str, columns: list[str]) -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]


def small_or_not(table: DataFrame, rows: int, weight: Column | None = None) -> DataFrame:
    """A written table, marked for broadcast if it has rows rows at most (by weight, if rows hold arrays); a larger one is joined by a shuffle, where hot keys are split."""
    if weight is None:
        small = table.limit(rows + 1).count() <= rows
    else:
        small = (table.agg(F.sum(weight)).first()[0] or 0) <= rows
    return F.broadcast(table) if small else table


def in_parts(texts, most: int = 2 << 20):
    """(slice, texts) of an Arrow column, in parts of about most bytes: a worker then holds one part's Python strings, not a batch's."""
    import pyarrow.compute as pc

    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += n
        if size >= most or i == len(texts) - 1:
            yield slice(start, i + 1), texts[start : i + 1].to_pylist()
            start, size = i + 1, 0


def fixed(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns computed once, here.

    A filter that stands above is otherwise pushed below the projections that make them,
    with their expressions put in; within a lambda, an array's expression is then worked out
    anew for each element of another. A generator is not passed by filters.
    """
    others = [c for c in df.columns if c not in names]
    made = df.select(*others, F.explode(F.array(F.struct(*names))).alias("made"))
    return made.select(*others, *[F.col("made").getField(n).alias(n) for n in names])


def components(edges: DataFrame, tag: str, rounds: int = 40) -> DataFrame:
    """Connected components of an edge table (a, b), of any comparable type: (node, component).

    Alternating large-star and small-star steps on links from a larger to a smaller node; each
    round is written to the shared folder, so no lineage grows and nothing is gathered on the
    driver. Smallest neighbours come from partial minima and are a written table, so that the
    links of a hub meet its one row by a broadcast (of a counted size) or a join whose hot keys
    are split. component is the smallest node reachable. Nodes without an edge do not appear;
    null ends, loops and repeated edges count for nothing; an empty table gives an empty one.
    """
    links = written(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        f"{tag}-links",
    )

    def lowest(links: DataFrame) -> DataFrame:
        return written(links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), f"{tag}-lowest")

    for _ in range(rounds):
        # large star: a node's larger neighbours go to the smallest node next to it
        low = lowest(links)
        if links.count() == low.count() and low.join(low.select(F.col("m").alias("n")).distinct(), "n", "left_semi").isEmpty():
            break
        low = small_or_not(low, NODES)
        large = written(links.join(low, F.col("b") == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), f"{tag}-links")
        # small star: its smaller neighbours and itself go to the smallest of them
        low = small_or_not(lowest(large), NODES)
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        links = written(small.select("e.a", "e.b").filter("a <> b").distinct(), f"{tag}-links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def lean(work):
    """work over batches, after which the worker gives the memory that it no longer uses back to the machine."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            released()

    return run


def released() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with every C library
        pass
