"""N-gram Jaccard join with set-relation skipping.

Documents are sets of word-shingle hashes (see ``shingles``); two link when
``100 * |intersection| >= percent * |union|``. The result is exact and names the connected components.

* Equal sets are one set: its answers are computed once and shared by all copies.
* Pivots are elected in rounds. In each group of sets that share a min-hash, the set nearest to what the
  group has in common is the pivot; every other set is verified against its most promising pivot and, if
  they link, becomes a member. Members take no further part; rounds go on until few sets join.
* Index skipping. The inverted lists hold prefixes under one global order, rare shingles first. A list
  has one entry for each pivot with its members, not one for each set, and a shingle that only one of
  these has is no list. Lists are sorted by set size, and a probe visits only the block of sizes that can
  match; positions bound the intersection, so entries too far in are skipped. A list of over HOT entries
  is cut into chunks that meet two at a time, each in a task of its own.
* Derived answers. Only pivots that met in a list are verified against each other. What a member differs by
  from its pivot is known, so its answers follow from the pivot's: how many shingles it has apart from
  another set is the two differences less twice what they have in common. Members are asked only where the
  sizes of the differences leave a link open, and then by an index of the differences, rare shingles first.
* Pairs are screened by parity bitmaps, whose distance never exceeds the number of shingles that only
  one of the sets has. Every pair left is verified on whole sets.

Links inside a pivot's group are not counted one by one: a group of copies would have all its pairs.

Nothing here collects sets, pairs or components to the driver; the one list that is broadcast orders the
ORDERED most frequent shingles at most, whatever the input's size (any order gives the same result).

Defined results: null and wordless texts have the empty set and link with nothing; repeated rows each
get their row; a null id gets component null and links nothing; an empty table gives an empty result;
other columns of the input are ignored. Of equally good pivots that with more copies, then that with the
smallest hash serves; the components do not depend on it. Very long texts are sets like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, components, free
from .shingles import mix, shingle_sets

_U = np.uint64
#: Shingles that are ordered by how frequent they are; the others come before them.
ORDERED = 200_000
#: Shingle hashes counted together when frequent ones are looked for.
BLOCK = 1_000_000
#: Min-hashes that group sets, those that compare them inside a group, and the least that must agree.
KEYS, MARKS, AGREE = 4, 32, 16
#: Rounds of election at most; sets that have not joined by then meet in the index.
ROUNDS = 4
#: A parity bitmap has as many bits as the set has members, rounded up to one of these.
BITMAPS = [1 << b for b in (10, 13, 16, 19, 22)]
#: Entries of a list that are compared in one task, and pairs that are looked at together there.
HOT, PAIRS = 20_000, 250_000
#: Pairs of one set that are verified in one task.
SPLIT = 64


def _longs(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(sets) + 1, dtype=np.int32)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=_U)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _fingerprint(s: np.ndarray) -> int:
    return int(mix(mix(s).sum(dtype=_U, keepdims=True) + _U(len(s))).view(np.int64)[0])


def _parity(s: np.ndarray) -> np.ndarray:
    size = next((b for b in BITMAPS if len(s) <= b), BITMAPS[-1])
    odd = np.bincount((s & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(_U)


def _least_of_ranges(s: np.ndarray, n: int) -> np.ndarray:
    """The least hash in each of n equal ranges of hashes (of a range without any: the next there is)."""
    edges = np.arange(n, dtype=_U) << _U(64 - n.bit_length() + 1)
    return s[np.searchsorted(s, edges) % len(s)]


def frequent_shingles(docs: DataFrame, width: int, most: int = ORDERED) -> np.ndarray:
    """Hashes of at most ``most`` shingles, the most frequent ones, least frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held or [np.zeros(0, dtype=_U)]), return_counts=True)
            keep = n >= 2
            return pa.record_batch([pa.array(token[keep].view(np.int64)), pa.array(n[keep])], names=["token", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                held.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        yield flush()

    with Scratch(docs.sparkSession) as tmp:
        found = tmp.write(docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
        # How many shingles have each power of 1.1 as their count: a few hundred rows.
        level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.1))).cast("int")
        levels = sorted(((r["level"], r["count"]) for r in found.groupBy(level.alias("level")).count().collect()), reverse=True)
        total, least = 0, None
        for at, n in levels:
            if total + n > most:
                break
            total, least = total + n, at
        if least is None:
            return np.zeros(0, dtype=_U)
        rows = found.where(level >= least).toPandas().sort_values(["n", "token"])
    return rows["token"].to_numpy(dtype=np.int64).view(_U)


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sketches(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per row: doc_id, text_hash, n (set size), sid (fingerprint of the set), keys and marks (min-hashes),
    bits (parity bitmap), prefix."""
    by_hash = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        none = np.zeros(0, dtype=_U)
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                size, sid, keys, marks, bits, prefix = [], [], [], [], [], []
                for s in shingle_sets(batch.column(1), width):
                    size.append(len(s))
                    if not len(s):
                        sid.append(None)
                        for column in (keys, marks, bits, prefix):
                            column.append(none)
                        continue
                    sid.append(_fingerprint(s))
                    least = _least_of_ranges(s, MARKS)
                    marks.append(least >> _U(32))
                    keys.append(np.unique(np.minimum.reduceat(least, np.arange(0, MARKS, MARKS // KEYS))))
                    bits.append(_parity(s))
                    p = _prefix_length(len(s), percent)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        hit = known[at] == s
                        rare = s[~hit]
                        s = np.concatenate([rare, s[hit][np.argsort(rank[at[hit]])]]) if len(rare) < p else rare
                    prefix.append(s[:p])
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(sid, pa.int64()), _longs(keys), _longs(marks), _longs(bits), _longs(prefix)], names=["doc_id", "text_hash", "n", "sid", "keys", "marks", "bits", "prefix"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(sketch, "doc_id long, text_hash long, n long, sid long, keys array<long>, marks array<long>, bits array<long>, prefix array<long>")


def _links(k: str, percent: int) -> Column:
    return 100 * F.col(k) >= percent * (F.col("na") + F.col("nb") - F.col(k))


def overlaps(pairs: DataFrame, heads: DataFrame, docs: DataFrame, width: int, tmp: Scratch) -> DataFrame:
    """pairs (a, b and others) of set ids with na, nb and k, the exact size of the intersection."""
    return _paired(pairs, heads, docs, width, tmp, k=F.size(F.array_intersect("sa", "sb")).cast("long"))


def differences(pairs: DataFrame, heads: DataFrame, docs: DataFrame, width: int, tmp: Scratch) -> DataFrame:
    """pairs (a, b and others) with na, nb and d: the shingles that only a has, then those that only b has, each
    part in the order of the hashes."""
    parts = F.concat(F.sort_array(F.array_except("sa", "sb")), F.sort_array(F.array_except("sb", "sa")))
    return _paired(pairs, heads, docs, width, tmp, d=parts)


def _paired(pairs: DataFrame, heads: DataFrame, docs: DataFrame, width: int, tmp: Scratch, **made: Column) -> DataFrame:
    """pairs (a, b and others) with na, nb and what is made of the whole sets sa and sb.

    A set in more than SPLIT pairs as ``b`` is sent to several tasks, each with a part of the pairs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                found = list(shingle_sets(batch.column(0).slice(first, 512), width))
                yield pa.record_batch([pa.array([_fingerprint(s) for s in found], pa.int64()), _longs(found)], names=["sid", "s"])

    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts"))
    parts = tmp.write(parts)
    asked = pairs.select("a").distinct().select(F.col("a").alias("sid")).union(parts.select("b")).distinct()
    asked = tmp.write(asked.join(heads.select("sid", "doc_id"), "sid"))
    texts = docs.join(broadcast_if_small(asked).select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    known = texts.mapInArrow(sets, "sid long, s array<long>").join(broadcast_if_small(asked).select("sid"), "sid", "left_semi")
    known = tmp.write(known)
    left = known.select(F.col("sid").alias("a"), F.col("s").alias("sa"))
    right = known.select(F.col("sid").alias("b"), F.col("s").alias("sb")).join(broadcast_if_small(parts), "b")
    right = right.select("b", "sb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(broadcast_if_small(parts), "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    both = dealt.join(left, "a").join(right, ["b", "part"]).drop("part")
    out = both.withColumns({"na": F.size("sa").cast("long"), "nb": F.size("sb").cast("long"), **made}).drop("sa", "sb")
    out = tmp.write(out.dropDuplicates(["a", "b"]))
    tmp.drop(parts, asked, known)
    return out


def _stars(grouped: DataFrame) -> DataFrame:
    """(a, b): each set with the pivot, of those of its groups, that agrees with it in most marks.

    grouped has key, sid, n, copies, marks, a row for each set of each group. Pivots are paired with none."""
    votes = grouped.select("key", F.posexplode("marks").alias("j", "v")).groupBy("key", "j", "v").agg(F.count("*").alias("c"))
    votes = votes.groupBy("key", "j").agg(F.max_by("v", F.struct("c", "v")).alias("v"))
    usual = votes.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("usual"))

    def agree(x: str, y: str) -> Column:
        return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))

    scored = grouped.join(usual, "key").withColumn("score", agree("marks", "usual"))
    best = F.struct("score", "copies", (-F.col("sid")).alias("h"))
    pivots = scored.groupBy("key").agg(F.max_by(F.struct(F.col("sid").alias("b"), F.col("marks").alias("pmarks"), F.col("n").alias("pn")), best).alias("p")).select("key", "p.*")
    near = grouped.join(pivots, "key").where("sid <> b").withColumn("match", agree("marks", "pmarks")).where(F.col("match") >= AGREE)
    near = near.join(pivots.select(F.col("b").alias("sid")).distinct(), "sid", "left_anti")
    return near.groupBy(F.col("sid").alias("a")).agg(F.max_by("b", F.struct("match", "b")).alias("b"))


def elect(heads: DataFrame, docs: DataFrame, width: int, percent: int, tmp: Scratch) -> DataFrame:
    """(sid, n, root, far) of the sets that have joined a pivot; far is at least the number of shingles
    that only one of the two has. Roots are no members."""
    keyed = heads.select("sid", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("key")
    grouped = tmp.write(keyed.join(shared, "key").join(heads.select("sid", "n", "copies", "marks"), "sid"))
    members = tmp.write(docs.sparkSession.createDataFrame([], "sid long, n long, root long, far long"))
    for _ in range(ROUNDS):
        pairs = tmp.write(_stars(grouped))
        done = pairs.isEmpty()
        if not done:
            tried = overlaps(pairs, heads, docs, width, tmp)
            won = tmp.write(tried.where(_links("k", percent)).select("a", "b", "na", (F.col("na") + F.col("nb") - 2 * F.col("k")).alias("far")))
            joined, known = won.count(), members.count()
            old = (members, grouped)
            step = broadcast_if_small(won).select(F.col("a").alias("root"), "b", F.col("far").alias("more"))
            moved = members.join(step, "root", "left").select("sid", "n", F.coalesce("b", "root").alias("root"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
            members = tmp.write(moved.union(won.select("a", "na", "b", "far")))
            grouped = tmp.write(grouped.join(broadcast_if_small(won).select(F.col("a").alias("sid")), "sid", "left_anti"))
            tmp.drop(tried, won, *old)
            done = joined <= known // 50
        tmp.drop(pairs)
        if done:
            break
    tmp.drop(grouped)
    return members


def _met(token: np.ndarray, cluster: np.ndarray, meta: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of clusters that meet in whole lists; rows are sorted by list, then cluster.

    meta holds a set's size, its position in the prefix and its part of a list that was cut."""
    n, i, part = meta >> 32, (meta >> 2) & ((1 << 30) - 1), meta & 3
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (cluster[1:] != cluster[:-1])
    at = np.flatnonzero(new)
    low, high, i = np.minimum.reduceat(n, at), np.maximum.reduceat(n, at), np.minimum.reduceat(i, at)
    token, cluster, part = token[at], cluster[at], part[at]
    first = np.ones(len(token), dtype=bool)
    first[1:] = token[1:] != token[:-1]
    which = np.cumsum(first) - 1
    alone = (np.bincount(which) == 1)[which]
    low, high, i, cluster, part, which = (x[~alone] for x in (low, high, i, cluster, part, which))
    order = np.lexsort((low, which))
    low, high, i, cluster, part, which = (x[order] for x in (low, high, i, cluster, part, which))
    # The block of the list whose sizes can match: those up to 100 / percent of this one.
    stop = np.searchsorted(which * (1 << 32) + low, which * (1 << 32) + high * 100 // percent, side="right")
    count = np.maximum(stop - np.arange(len(low)) - 1, 0)
    far, begin = (100 - percent) / (100 + percent), 0
    upto = np.cumsum(count)
    while begin < len(low):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, side="right")))
        c = count[begin:end]
        a = np.repeat(np.arange(begin, end), c)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
        ok = (i[a] + i[b] <= far * (high[a] + high[b]) + 1e-6) & ((part[a] != part[b]) | (part[a] == 0))
        x, y = cluster[a[ok]], cluster[b[ok]]
        yield np.minimum(x, y), np.maximum(x, y)
        begin = end


def index_pairs(sets: DataFrame, members: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """(a, b): roots that have, or whose members have, a prefix shingle in common; sets has sid, n, prefix, one row a set."""
    of = broadcast_if_small(members).select("sid", "root")
    lists = sets.join(of, "sid", "left").select(F.coalesce("root", "sid").alias("cluster"), "n", F.posexplode("prefix").alias("i", "token"))
    # The long lists are found by counting all.
    hot = lists.groupBy("token").count().where(F.col("count") > HOT)
    hot = broadcast_if_small(tmp.write(hot.select("token", F.ceil(F.col("count") / HOT).cast("int").alias("chunks"))))
    meta = (F.shiftleft(F.col("n"), 32) + F.shiftleft(F.col("i").cast("long"), 2)).alias("meta")
    plain = lists.join(hot, "token", "left_anti").select(F.col("token").alias("list"), "cluster", meta)
    cut = lists.join(hot, "token").withColumn("own", F.pmod(F.xxhash64("cluster"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cut = cut.select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("list"), "cluster", (meta + part).alias("meta"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 3

        def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in _met(*rows, percent) if len(rows[0]) else ():
                if len(a):
                    both = np.unique(np.stack([a, b]), axis=1) if len(a) < PAIRS else np.stack([a, b])
                    yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if last < BLOCK // 8 and last < len(rows[0]) // 2:  # a list that is not whole yet, or few rows
                held = rows
                continue
            yield from pairs([r[:last] for r in rows])
            held = [r[last:].copy() for r in rows]
        yield from pairs(held)

    dealt = plain.unionByName(cut).repartition("list").sortWithinPartitions("list", "cluster")
    return tmp.write(dealt.mapInArrow(meet, "a long, b long").distinct())


def _apart(a: str, b: str) -> Column:
    """Distance of two bitmaps, 0 if they differ in size and so say nothing of each other."""
    distance = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), distance).otherwise(0)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) for every row of docs, which needs doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    with Scratch(docs.sparkSession) as tmp:
        frequent = frequent_shingles(docs, width)
        full = tmp.write(sketches(docs, width, percent, frequent))
        sets = full.where("doc_id is not null and n > 0")
        heads = sets.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("marks").alias("marks"), F.first("prefix").alias("prefix"))
        heads = tmp.write(heads)
        known = docs.where("doc_id is not null")
        members = elect(heads, known, width, percent, tmp)
        met = index_pairs(heads, members, percent, tmp)
        links = between(met, members, heads, sets, known, width, percent, tmp)
        tmp.drop(met)

        joined = components(links)
        tmp.tables.append(joined)
        top = broadcast_if_small(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
        of = heads.select("sid", "doc_id").join(broadcast_if_small(members).select("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        of = of.join(top, "root", "left").select("sid", "doc_id", F.coalesce("top", "root").alias("root"))
        lowest = of.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("sets")).where("sets > 1").select("root", "component_id")
        of = tmp.write(of.join(lowest, "root", "left").select("sid", F.coalesce("component_id", "doc_id").alias("component_id")))
        out = full.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "sid").join(of, "sid", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
        return tmp.keep(tmp.write(out.select("doc_id", "n_shingles", component, "text_hash")))


def between(met: DataFrame, members: DataFrame, heads: DataFrame, sets: DataFrame, docs: DataFrame, width: int, percent: int, tmp: Scratch) -> DataFrame:
    """Links (a, b) of roots: where the roots, or some of their members, link. met has pairs of roots.

    If X and Y link, at most ``ratio`` times their sizes' sum is in only one of them. So roots at a distance
    ``gap`` can have linking members only if gap <= far(X) + that + far(Y), and answers for members
    follow from the answers for their roots."""
    ratio = (100 - percent) / (100 + percent)
    asked = tmp.write(met.select("a").union(met.select("b")).distinct().withColumnRenamed("a", "root"))
    span = members.join(broadcast_if_small(asked), "root", "left_semi").groupBy("root").agg(F.max("far").alias("far"), F.max("n").alias("most"), F.count("*").alias("many"))
    about = sets.join(broadcast_if_small(asked).withColumnRenamed("root", "sid"), "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    about = about.join(span.withColumnRenamed("root", "sid"), "sid", "left").select("sid", "bits", F.coalesce("far", F.lit(0)).alias("far"), F.greatest("n", "most").alias("n"), F.coalesce("many", F.lit(0)).alias("many"))
    about = tmp.write(about)
    pairs = met
    for x in ("a", "b"):
        pairs = pairs.join(about.select(F.col("sid").alias(x), F.col("bits").alias(f"bits{x}"), F.col("far").alias(f"far{x}"), F.col("n").alias(f"most{x}"), F.col("many").alias(f"many{x}")), x)
    reach = F.col("fara") + F.col("farb") + ratio * (F.col("mosta") + F.col("mostb")) + 1e-6
    pairs = tmp.write(pairs.where(_apart("bitsa", "bitsb") <= reach).drop("bitsa", "bitsb"))
    tmp.drop(asked)
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    if pairs.isEmpty():
        return tmp.write(none)

    tried = overlaps(pairs, heads, docs, width, tmp)
    links = tmp.write(tried.where(_links("k", percent)).select("a", "b"))
    gap = F.col("na") + F.col("nb") - 2 * F.col("k")
    # p is the root with more members, q the other one.
    turned = F.col("manya") < F.col("manyb")
    named = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(n) for n, x, y in (("p", "a", "b"), ("q", "b", "a"), ("farp", "fara", "farb"), ("farq", "farb", "fara"), ("mostp", "mosta", "mostb"), ("mostq", "mostb", "mosta"))]
    unsure = tried.where(~_links("k", percent) & (gap <= reach) & (F.col("fara") + F.col("farb") > 0)).select("a", "b", *named, gap.alias("gap"))
    unsure = tmp.write(unsure)
    tmp.drop(tried, pairs)
    unsure = _still_apart(unsure, links, tmp)
    if unsure.isEmpty():
        return links
    more = tmp.write(_member_links(unsure, members, heads, docs, width, percent, tmp))
    return tmp.write(links.union(more.select("p", "q")).distinct())


def _member_links(unsure: DataFrame, members: DataFrame, heads: DataFrame, docs: DataFrame, width: int, percent: int, tmp: Scratch) -> DataFrame:
    """(p, q) of the pairs of roots some of whose sets link, by the differences of these sets from p.

    x is a member of p, y is q or a member of q; dx and dy are what they differ by from p. They are
    |dx| + |dy| - 2 |dx and dy| shingles apart, and link if that is at most ``ratio`` of their sizes' sum. y does
    not link with p itself (else that is the answer), so |dy| > ratio * (|p| + |y|), and the differences must
    have more than (|dx| - ratio * (|x| - |p|)) / 2 in common: their beginnings meet."""
    ratio = (100 - percent) / (100 + percent)
    own = members.select(F.col("sid").alias("s"), "n", "root", "far")
    # Of p's members those far enough for one of p's pairs; of q's those far enough for this pair.
    least = unsure.groupBy("p").agg(F.min(F.col("gap") - F.col("farq") - ratio * F.col("mostq")).alias("least"))
    xs = own.join(least, F.col("root") == F.col("p")).where(F.col("far") + ratio * F.col("n") >= F.col("least") - 1e-6)
    ys = unsure.join(own, F.col("root") == F.col("q")).where(F.col("gap") <= F.col("far") + F.col("farp") + ratio * (F.col("n") + F.col("mostp")) + 1e-6)
    ys = unsure.select(F.col("q").alias("a"), F.col("p").alias("b"), "q").union(ys.select(F.col("s").alias("a"), F.col("p").alias("b"), "q"))
    dx = differences(tmp.write(xs.select(F.col("s").alias("a"), F.col("p").alias("b"))), heads, docs, width, tmp)
    dy = differences(tmp.write(ys), heads, docs, width, tmp)
    dx = dx.select(F.col("b").alias("p"), F.col("a").alias("x"), F.col("na").alias("nx"), F.col("nb").alias("np"), F.col("d").alias("dx"), F.size("d").alias("lx"))
    dy = dy.select(F.col("b").alias("p"), "q", F.col("a").alias("y"), F.col("na").alias("ny"), F.col("nb").alias("np"), F.col("d").alias("dy"), F.size("d").alias("ly"))
    near = F.col("ly") <= ratio * (F.col("np") + F.col("ny")) + 1e-9
    direct, dy = dy.where(near).select("p", "q"), dy.where(~near)

    def beginning(d: DataFrame, one: str, common: Column) -> DataFrame:
        """Its length less what must be in common, and one; the shingles there with their places."""
        upto = F.col(f"l{one}") - F.floor(common - 1e-9).cast("int")
        kept = ["p", "q", one] if one == "y" else ["p", one]
        return d.withColumn("upto", upto).where("upto > 0").select(*kept, f"l{one}", f"n{one}", F.posexplode(F.slice(f"d{one}", F.lit(1), F.col("upto"))).alias(f"i{one}", "token"))

    left = beginning(dx, "x", F.greatest(F.lit(0.0), (F.col("lx") - ratio * (F.col("nx") - F.col("np"))) / 2))
    right = beginning(dy, "y", F.greatest(F.lit(0.0), (F.col("ly") - ratio * (F.col("np") + F.col("ny"))) / 2))
    enough = (F.col("lx") + F.col("ly") - ratio * (F.col("nx") + F.col("ny"))) / 2 - 1e-6
    met = left.join(right, ["p", "token"]).where(F.least(F.col("lx") - F.col("ix"), F.col("ly") - F.col("iy")) >= enough)
    met = met.select("p", "q", "x", "y").distinct()
    both = met.join(dx.select("p", "x", "nx", "lx", "dx"), ["p", "x"]).join(dy.select("p", "q", "y", "ny", "ly", "dy"), ["p", "q", "y"])
    apart = F.col("lx") + F.col("ly") - 2 * F.size(F.array_intersect("dx", "dy"))
    # As in _links, in whole numbers: 100 * (n - apart) / 2 >= percent * (n + apart) / 2, n the sizes' sum.
    n = F.col("nx") + F.col("ny")
    return direct.union(both.where(100 * (n - apart) >= percent * (n + apart)).select("p", "q")).distinct()


def _still_apart(pairs: DataFrame, links: DataFrame, tmp: Scratch) -> DataFrame:
    """The pairs of roots (a, b) that links do not yet put into one component."""
    joined = components(links)
    tmp.tables.append(joined)
    for x in ("a", "b"):
        top = broadcast_if_small(joined).select(F.col("node").alias(x), F.col("root").alias(f"top{x}"))
        pairs = pairs.join(top, x, "left").withColumn(f"top{x}", F.coalesce(f"top{x}", x))
    return tmp.write(pairs.where("topa <> topb").drop("topa", "topb"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their component, each text of an id once.

    Rows without doc_id link with nothing and stay; so do wordless ones."""
    own, mark, rows = (free(x, docs.columns) for x in ("id", "hash", "rows"))
    with Scratch(docs.sparkSession) as tmp:
        found = jaccard_components(docs, width, percent)
        tmp.tables.append(found)
        key = [F.col("doc_id").alias(own), F.col("text_hash").alias(mark)]
        others = tmp.keep(tmp.write(found.where("component_id <> doc_id").select(*key).distinct()))
        again = found.where("component_id = doc_id").groupBy(*key).agg(F.count("*").alias(rows)).where(F.col(rows) > 1)
        again = broadcast_if_small(tmp.keep(tmp.write(again.select(own, mark))))
    same = (F.col("doc_id") == F.col(own)) & (F.xxhash64("text") == F.col(mark))
    kept = docs.join(broadcast_if_small(others), same, "left_anti")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
