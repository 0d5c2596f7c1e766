"""What the operators share: the shared folder, written tables, checked broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers, and stored bytes, that may be broadcast; beyond that the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share. Only where that is
    unset in a local session (as in tests) is a temporary folder made and set; a cluster has to name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: it is computed once, and a lost executor
    costs only the tasks that were running. The table stays until ``release`` names it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        store, where = _path(spark, t._written)
        store.delete(where, True)


class Scratch:
    """The tables one call of an operator writes. Leaving the block deletes them all, but for those that
    ``keep`` names, which the operator's result reads; so a result never depends on what others delete."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.tables)

    def write(self, df: DataFrame) -> DataFrame:
        out = written(df)
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        release(self.spark, *tables)
        self.tables = [t for t in self.tables if all(t is not x for x in tables)]

    def keep(self, table: DataFrame) -> DataFrame:
        self.tables = [t for t in self.tables if t is not table]
        return table


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its files and its rows are few; else leave the join to Spark.

    The row count comes from the files' footers."""
    store, where = _path(df.sparkSession, df._written)
    small = store.getContentSummary(where).getLength() <= most and df.count() <= rows
    return F.broadcast(df) if small else df


def quoted(name: str) -> str:
    """A column's name as F.col takes it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def free(name: str, taken: list[str]) -> str:
    """The name, with as many marks before it as it takes not to be one of those taken, whatever their case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges stay as they are; each step is a
    grouped minimum and a join, and its result is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = e.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        out = e.join(low, "a")
        moved = out.where(F.col("b") > F.col("a")) if large else out
        moved = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            moved = moved.union(low.select("a", F.col("low").alias("b")))
        return moved.where("a <> b").distinct()

    edges = written(edges.where("a <> b").select("a", "b").distinct())
    mark = None
    while not edges.isEmpty():
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
        old, edges = edges, written(star(star(edges, True), False))
        release(edges.sparkSession, old)
    out = written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct()))
    release(edges.sparkSession, edges)
    return out
