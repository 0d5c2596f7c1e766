"""URL filters by a sort-merge range join, on DataFrame functions alone.

A host's canonical key is its labels in reverse, each closed by a dot: ``www.example.org`` becomes
``org.example.www.``. A rule covers its host and all subdomains, so its key is a prefix of theirs, and all
keys with one prefix lie in one interval of the sort order. Paths are prefixes too: a rule's key and path
make an interval among the pairs of key and path. Such intervals are nested or disjoint.

Two sweeps in sort order find the rules of a URL. The first goes over host keys and gives each URL the
stack of rule hosts that cover its host. The second goes over (host key, path), once for each host of that
stack, and gives the stack of that host's rules that cover the path, of which the top is the longest.

* The rules are sorted and dealt into blocks of about BLOCK. A block's sweep begins with the stack that
  holds at its first key, pops what does not cover the next rule, pushes it, and notes the stack.
* Rules and URLs are sorted together, in ranges. A URL takes the stack of the last rule at or before it,
  and pops what does not cover it. Where its range holds no rule before it, that is the last of an earlier
  range: one row for each range is looked up. Ranges are cut by key and by the row's hash, so that a host
  or a URL with a third of all rows lies in many ranges.

Of the rules that fit, the longest (host and path together) wins; of equally long ones the last by text,
then by verdict. Defined results: a null URL, or one without ``://``, has empty host and path and fits no
rule of a non-empty host; repeated rows are judged each; rules with a null host or path never fit; without
rules every verdict is the default; an empty table gives an empty result; very long URLs are judged whole.
Other columns of the input pass through, whatever their names; those named host, path, rule or verdict are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, quoted

#: Rules of a block that are swept in one row.
BLOCK = 500
RULE = "array<struct<key:string,path:string>>"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _covers(s: Column, key: Column, path: Column) -> Column:
    """Whether a host's interval (path null), or a rule's, holds the key and path."""
    return F.when(s["path"].isNull(), F.startswith(key, s["key"])).otherwise((s["key"] == key) & F.startswith(path, s["path"]))


def _prefixes(s: Column) -> Column:
    """What could cover it: hosts of the leading labels, or the same host with the path's beginnings."""
    labels = F.split(F.substring(s["key"], F.lit(1), F.length(s["key"]) - 1), r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")).alias("key"), F.lit(None).cast("string").alias("path")))
    paths = F.transform(F.sequence(F.lit(0), F.length(s["path"])), lambda n: F.struct(s["key"].alias("key"), F.substring(s["path"], F.lit(1), n).alias("path")))
    return F.when(s["path"].isNull(), hosts).otherwise(paths)


def stacks(starts: DataFrame, tmp: Scratch) -> DataFrame:
    """(key, path, stack): each of the distinct starts with those that cover it, itself last."""
    n = max(1, -(-starts.count() // BLOCK))
    dealt = tmp.write(starts.repartitionByRange(n, "key", "path").withColumn("block", F.spark_partition_id()))
    first = dealt.groupBy("block").agg(F.min(F.struct("key", "path")).alias("first"))
    over = first.select("block", "first", F.explode(_prefixes(F.col("first"))).alias("s")).where("not (s <=> first)").select("block", "s.*")
    alike = (over["key"] == starts["key"]) & over["path"].eqNullSafe(starts["path"])
    over = over.join(starts, alike, "left_semi").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "path"))).alias("over"))
    rows = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "path"))).alias("starts")).join(over, "block", "left")
    zero = F.struct(F.coalesce("over", F.array().cast(RULE)).alias("stack"), F.array().cast(f"array<struct<key:string,path:string,stack:{RULE}>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        popped = F.filter(s["stack"], lambda r: _covers(r, x["key"], x["path"]))
        return F.struct(F.concat(popped, F.array(x)).alias("stack"), F.concat(s["out"], F.array(F.struct(x["key"].alias("key"), x["path"].alias("path"), F.concat(popped, F.array(x)).alias("stack")))).alias("out"))

    return tmp.write(rows.select(F.explode(F.aggregate("starts", zero, step, lambda s: s["out"])).alias("s")).select("s.*"))


def sweep(starts: DataFrame, probes: DataFrame, tmp: Scratch) -> DataFrame:
    """probes (key, path and others) with ``stack``: the starts that cover each, innermost last.

    starts has key, path, stack; where its paths are null, hosts are swept and the probes' paths ignored."""
    n = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hosts = "path" not in starts.columns
    own = F.struct(*[F.col(c) for c in probes.columns])
    kind = probes.select(own.alias("row")).schema["row"].dataType
    none = F.lit(None).cast(RULE)
    a = starts.select("key", (F.lit("") if hosts else F.col("path")).alias("path"), F.lit(0).cast("long").alias("salt"), F.lit(0).alias("probe"), "stack", F.lit(None).cast(kind).alias("row"))
    b = probes.select("key", (F.lit("") if hosts else F.col("path")).alias("path"), F.xxhash64(*probes.columns).alias("salt"), F.lit(1).alias("probe"), none.alias("stack"), own.alias("row"))
    order = ["key", "path", "probe", "salt"]
    dealt = tmp.write(a.union(b).repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    # The last stack of all ranges before each: as many rows as there are ranges.
    last = dealt.groupBy("range").agg(F.max_by("stack", F.when(F.col("probe") == 0, F.struct("key", "path"))).alias("last"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tmp.write(last.select("range", F.last("last", ignorenulls=True).over(earlier).alias("carried")))
    here = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumn("stack", F.last("stack", ignorenulls=True).over(here)).where("probe = 1").join(F.broadcast(carried), "range")
    row = F.col("row")
    active = F.filter(F.coalesce("stack", "carried"), lambda s: _covers(s, row["key"], row["path"]))
    return tmp.write(out.select("row.*", F.coalesce(active, F.array().cast(RULE)).alias("stack")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (with url) and host, path, rule, verdict; rules has host, path, verdict."""
    with Scratch(pages.sparkSession) as tmp:
        known = rules.where("host is not null and path is not null").withColumn("key", host_key(F.col("host")))
        known = tmp.write(known.groupBy("key", "path").agg(F.max(F.struct(F.concat("host", "path").alias("rule"), "verdict")).alias("is")))
        urls = pages.select(F.struct(*[F.col(quoted(c)) for c in pages.columns]).alias("row"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        urls = tmp.write(urls.withColumn("uid", F.monotonically_increasing_id()))

        hosts = known.select("key").distinct()
        probes = urls.select(host_key(F.col("host")).alias("key"), "path", "uid")
        covered = sweep(stacks(hosts.withColumn("path", F.lit(None).cast("string")), tmp).select("key", "stack"), probes, tmp)
        probes = covered.select(F.explode("stack.key").alias("key"), "path", "uid")
        fit = sweep(stacks(known.select("key", "path"), tmp), probes, tmp).where(F.size("stack") > 0)
        fit = fit.select("uid", F.element_at("stack", -1).alias("s")).select("uid", "s.*").join(known, ["key", "path"])
        best = fit.groupBy("uid").agg(F.max(F.struct(F.length(F.col("is")["rule"]).alias("size"), F.col("is")["rule"].alias("rule"), F.col("is")["verdict"].alias("verdict"))).alias("best"))
        out = urls.join(best, "uid", "left")
        kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
        return tmp.keep(tmp.write(out.select(*kept, "host", "path", F.col("best")["rule"].alias("rule"), F.coalesce(F.col("best")["verdict"], F.lit(default)).alias("verdict"))))
