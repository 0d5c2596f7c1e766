"""A stored index for radius search: built once, appended to and deleted from, probed without shuffling it.

Distinct words are stored by their bands, rows by their word, both in bucketed tables; so a probe shuffles only the
queries and what they hit. A row's word and band are known when it is written, so appending is a plain
write of new files. Deleting writes the ids that are gone, which are taken off the hits; ``compact`` rewrites the
tables without them.

A word that very many rows share is one row of the words and is dealt over SALTS buckets of the rows.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hamming
from .similarity import banded

#: Parts that the rows of one word are dealt over.
SALTS = 16


class RadiusIndex:
    """Rows of id and w (a 64-bit word) under a name in the session's catalog.

    radius is the largest that can be asked for. An id may have several words; deleting an id takes all rows it has
    until then, and it may be appended again. Calls that write are made one at a time."""

    def __init__(self, spark: SparkSession, name: str, radius: int, buckets: int = 64):
        self.spark, self.radius, self.buckets = spark, radius, buckets
        self.words, self.rows, self.gone = f"{name}_words", f"{name}_rows", f"{name}_gone"

    def append(self, signatures: DataFrame) -> None:
        now = time.time_ns()
        some = signatures.select("id", "w").where("w is not null")
        words = banded(some.select("w").distinct(), self.radius)
        self._write(words.select("band", "bits", "w"), self.words, ["band", "bits"])
        rows = some.select("w", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), "id", F.lit(now).alias("written"))
        self._write(rows, self.rows, ["w", "salt"])

    def delete(self, ids: DataFrame) -> None:
        ids.select("id", F.lit(time.time_ns()).alias("deleted")).write.mode("append").saveAsTable(self.gone)

    def _write(self, df: DataFrame, table: str, by: list[str], mode: str = "append") -> None:
        # One file a bucket and write, not one for each task.
        df.repartition(self.buckets, *by).write.mode(mode).format("parquet").bucketBy(self.buckets, *by).saveAsTable(table)

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.spark.catalog.tableExists(self.gone):
            return rows
        last = self.spark.table(self.gone).groupBy("id").agg(F.max("deleted").alias("deleted"))
        return rows.join(last, "id", "left").where(F.col("deleted").isNull() | (F.col("written") > F.col("deleted"))).drop("deleted")

    def near(self, words: DataFrame, radius: int) -> DataFrame:
        """(wq, w, distance): stored words within the radius of the words wq; a word may stand there though all its rows are gone."""
        if radius > self.radius:
            raise ValueError(f"the index is for radius {self.radius} at most")
        asked = banded(words.select(F.col("wq").alias("w")), self.radius).withColumnRenamed("w", "wq")
        hit = asked.join(self.spark.table(self.words), ["band", "bits"]).withColumn("distance", hamming(F.col("wq"), F.col("w")))
        return hit.where(F.col("distance") <= radius).select("wq", "w", "distance").distinct()

    def search(self, queries: DataFrame, radius: int | None = None, k: int | None = None) -> DataFrame:
        """(query, id, distance) of the rows within a radius of each query (id and w), the k nearest if given."""
        asked = queries.select(F.col("id").alias("query"), F.col("w").alias("wq")).where("wq is not null")
        met = self.near(asked.select("wq").distinct(), self.radius if radius is None else radius)
        salted = met.select("w").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = self._live(self.spark.table(self.rows).join(salted, ["w", "salt"])).select("w", "salt", "id").distinct()
        if k is not None:
            # No query can take more than k rows of one word, so each part of a word gives k at most.
            ranks = Window.partitionBy("w", "salt").orderBy("id")
            rows = rows.withColumn("r", F.row_number().over(ranks)).where(F.col("r") <= k)
        found = asked.join(met, "wq").join(rows, "w").groupBy("query", "id").agg(F.min("distance").alias("distance"))
        if k is None:
            return found
        best = Window.partitionBy("query").orderBy("distance", "id")
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")

    def compact(self) -> None:
        """Write the tables anew, without what is gone and without repeated words."""
        rows = self._live(self.spark.table(self.rows)).select("w", "salt", "id", "written")
        old = {"words": self.words, "rows": self.rows, "gone": self.gone}
        mark = time.time_ns()
        self._write(rows, f"{self.rows}_{mark}", ["w", "salt"])
        kept = self.spark.table(f"{self.rows}_{mark}")
        self._write(banded(kept.select("w").distinct(), self.radius).select("band", "bits", "w"), f"{self.words}_{mark}", ["band", "bits"])
        for name in old.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for name in (self.rows, self.words):
            self.spark.sql(f"ALTER TABLE {name}_{mark} RENAME TO {name}")

    def drop(self) -> None:
        for name in (self.words, self.rows, self.gone):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
