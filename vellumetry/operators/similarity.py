"""Search of 64-bit signatures within a Hamming radius, without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hamming

#: Largest radius for bands of at least eight bits.
BANDED_RADIUS = 7


def banded(df: DataFrame, radius: int) -> DataFrame:
    """One row a band. Of radius + 1 bands at least one is equal for two words within the radius."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    bands = [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("w", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 63 else -1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return df.withColumn("b", F.explode(F.array(*bands))).select("*", "b.band", "b.bits").drop("b")


def near_words(signatures: DataFrame, radius: int) -> DataFrame:
    """(wa, wb, na, nb, distance): the distinct words wa <= wb within the radius, and how many rows have each.

    signatures has id and w, and is the membership of the words. However many rows share a word (blank pages
    all share one), it is compared once and makes one row with itself. Rows are counted before the words are
    banded, so no row count makes a band large. Exact for every radius; up to BANDED_RADIUS the bands are
    selective."""
    words = signatures.groupBy("w").agg(F.count("*").alias("n"))
    cut = banded(words, radius)
    left, right = (cut.select(F.col("w").alias(f"w{x}"), F.col("n").alias(f"n{x}"), "band", "bits") for x in "ab")
    near = left.join(right, ["band", "bits"]).where(F.col("wa") <= F.col("wb"))
    near = near.withColumn("distance", hamming(F.col("wa"), F.col("wb"))).where(F.col("distance") <= radius)
    return near.select("wa", "wb", "na", "nb", "distance").distinct()


def pairs_within(signatures: DataFrame, radius: int) -> DataFrame:
    """(a, b, distance) of all pairs of ids a < b whose words differ in at most ``radius`` bits.

    As many rows as there are pairs: where many ids share a word, ``near_words`` says the same by classes."""
    near = near_words(signatures, radius).drop("na", "nb")
    a, b = (signatures.select(F.col("id").alias(i), F.col("w").alias(w)) for i, w in (("ia", "wa"), ("ib", "wb")))
    found = near.join(a, "wa").join(b, "wb").where((F.col("wa") != F.col("wb")) | (F.col("ia") < F.col("ib")))
    return found.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "distance")


def original_pages(files: DataFrame) -> DataFrame:
    """One row a page index of each document: the original, not its crops. files has doc_id, page, variant, w."""
    return files.where(F.coalesce("variant", F.lit("original")) == "original").groupBy("doc_id", "page").agg(F.min("w").alias("w"))


def search(queries: DataFrame, signatures: DataFrame, radius: int, k: int | None = None) -> DataFrame:
    """(query, id, distance) of the signatures within a radius of each query, the k nearest if given.

    Both sides have id and w. Distinct words meet in bands, an equi-join; ids are put back after that. With k,
    a word gives its k first ids only, as no query can take more of them."""
    asked, known = queries.select("w").distinct(), signatures.select("w").distinct()
    q = banded(asked, radius).withColumnRenamed("w", "wq")
    hit = q.join(banded(known, radius), ["band", "bits"]).withColumn("distance", hamming(F.col("wq"), F.col("w"))).where(F.col("distance") <= radius).select("wq", "w", "distance").distinct()
    rows = signatures.select("id", "w")
    if k is not None:
        # Partial ranks inside salts first, so a word that many rows share is not ranked in one task.
        salted = Window.partitionBy("w", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
        rows = rows.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("id"))).where(F.col("r") <= k).drop("r")
    found = queries.select(F.col("id").alias("query"), F.col("w").alias("wq")).join(hit, "wq").join(rows, "w").select("query", "id", "distance")
    if k is None:
        return found
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
