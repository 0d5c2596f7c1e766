"""Job listings, retention and metrics as queries over tables of jobs and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import extension_hint, valid_page_file

SORTS = ("created_at", "finished_at", "filename", "ext", "status", "pages")


def listing(jobs: DataFrame, status: str | None = None, q: str | None = None, sort: str = "created_at", descending: bool = True, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of the list; job_id breaks ties so that pages do not overlap."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    out = jobs.withColumn("ext", extension_hint(F.col("filename")))
    if status:
        out = out.where(F.col("status") == status)
    if q:
        out = out.where(F.contains(F.lower("filename"), F.lit(q.lower())))
    key = F.col("pages_total" if sort == "pages" else sort)
    return out.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "job_id").offset(offset).limit(limit)


def by_id(jobs: DataFrame, job_id: Column) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def without(jobs: DataFrame, deleted: DataFrame) -> DataFrame:
    return jobs.join(deleted.select("job_id"), "job_id", "left_anti")


def status_at(now: float, ttl: float, queue_age: float) -> Column:
    """Status with retention (ttl, 0 keeps for ever) and the queue sweep (0 is off) applied."""
    swept = (F.lit(queue_age) > 0) & (F.col("status") == "queued") & (F.lit(now) - F.col("created_at") > queue_age)
    expired = (F.lit(ttl) > 0) & F.col("status").isin("done", "failed") & (F.col("finished_at") + ttl < now)
    return F.when(swept, "failed").when(expired, "expired").otherwise(F.col("status"))


def pages_listed(outputs: DataFrame) -> DataFrame:
    """Pages per job counted from the files that are there: originals only."""
    page = valid_page_file(F.col("file")) & ~F.col("file").rlike("-(trimmed|focused)")
    return outputs.groupBy("job_id").agg(F.count_if(page).alias("pages"))


def tally(jobs: DataFrame, by: str) -> DataFrame:
    """done and total for each value and, with null, for all."""
    return jobs.rollup(by).agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"))


def tally_against(now: DataFrame, baseline: DataFrame, by: str) -> DataFrame:
    """A tally beside a baseline's (by, done, total): base_done, base_total and whether the share done fell."""
    base = baseline.select(F.col(by).alias("__by"), F.col("done").alias("base_done"), F.col("total").alias("base_total"))
    worse = F.col("done") * F.col("base_total") < F.col("base_done") * F.col("total")
    return now.join(base, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "done", "total", "base_done", "base_total", F.coalesce(worse, F.lit(False)).alias("worse"))


def counts(jobs: DataFrame, *by: str) -> DataFrame:
    return jobs.groupBy(*by).agg(F.count("*").alias("n"))


def histogram(values: DataFrame, value: str, buckets: list[float], *by: str) -> DataFrame:
    """Cumulative counts (by, le, n), +Inf last; all buckets are counted in one aggregation."""
    hits = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = values.groupBy(*by).agg(*hits, F.count(value).alias("all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.le", "r.n")


def in_flight(jobs: DataFrame, by: str, width: float = 3600) -> DataFrame:
    """(by, t, running): jobs running after each start or end, in each value of ``by``; times are numbers.

    Steps are summed inside spans of ``width``, and spans among themselves, so no window holds all steps of a value."""
    starts = jobs.where("started_at is not null").select(by, F.col("started_at").alias("t"), F.lit(1).alias("d"))
    ends = jobs.where("finished_at is not null and started_at is not null").select(by, F.col("finished_at").alias("t"), F.lit(-1).alias("d"))
    steps = starts.union(ends).groupBy(by, "t").agg(F.sum("d").alias("d")).withColumn("__span", F.floor(F.col("t") / width))
    carried = steps.groupBy(F.col(by).alias("__by"), F.col("__span").alias("__at")).agg(F.sum("d").alias("d"))
    carried = carried.select("__by", "__at", F.coalesce(F.sum("d").over(Window.partitionBy("__by").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__carried"))
    inside = F.sum("d").over(Window.partitionBy(by, "__span").orderBy("t"))
    each = steps.withColumn("__inside", inside).join(carried, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__span") == F.col("__at")))
    return each.select(by, "t", (F.col("__inside") + F.col("__carried")).alias("running"))


def forwardable(params: DataFrame, allowed: DataFrame, reserved: DataFrame) -> DataFrame:
    """Parameters that may reach a worker: well-formed, allowed, not reserved."""
    named = params.where(F.col("key").rlike("^[A-Z][A-Z0-9_]*$"))
    return named.join(allowed, "key", "left_semi").join(reserved, "key", "left_anti")


def host_path(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, host): the mapping of the longest prefix; paths outside every prefix stay.

    Each path is exploded into its own ancestors, so the prefix match is an equi-join."""
    parts = F.split("path", "/", -1)
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = paths.select("path", F.explode(up).alias("prefix")).join(prefixes, "prefix")
    best = met.groupBy("path").agg(F.max_by(F.struct("prefix", "host"), F.length("prefix")).alias("b"))
    mapped = best.select("path", F.concat(F.col("b")["host"], F.expr("substring(path, length(b.prefix) + 1)")).alias("mapped"))
    return paths.join(mapped, "path", "left").select("path", F.coalesce("mapped", "path").alias("host"))
