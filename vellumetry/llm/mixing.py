"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share a given
   percentage of all words; a target stops at ``cap`` times its source's size and the excess is shared
   again by weight until none is above.
2. Blocks: each source's documents are shuffled by a seeded hash and cut into blocks of equal tokens;
   a document lies in as many blocks as it reaches into.
3. Schedule: slot i of the mix is the golden-ratio point frac((i + 1) / phi), in whole numbers of
   2**-32, mapped through the cumulative targets to a source. The k-th slot of a source takes its block
   k modulo the number of its blocks; a source's last slot is cut where its target ends.
4. Slots are joined with blocks: ``pieces`` says which words of which document each slot takes, and
   ``mix`` sums that up by document, with the first slot that takes of it.

Running sums and ranks are taken inside hash buckets and chunks of slots, so a source with a third of
all rows is spread over many window groups; only per-source and per-bucket sums are gathered.

Defined results: null text has size 0; a null source is a source of its own, last; repeated rows are
shuffled and taken as rows of their own; an empty table or one without words takes nothing; a null
doc_id is shuffled by the hash of null; very long texts lie in many blocks; ties in the shuffle go by
doc_id, then size. Of other columns those in ``keep`` are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, broadcast_if_small, quoted, words

WEIGHTS = (3, 1, 2)
PERCENT, CAP = 150, 2
BLOCK_TOKENS = 512
#: Window groups that one source's documents are dealt over.
BUCKETS = 512
#: Slots that are ranked together.
CHUNK = 65_536
#: The golden ratio's fraction in units of 2**-32.
GOLDEN, ONE = 2_654_435_769, 1 << 32


def source_targets(sizes: DataFrame, tmp: Scratch, percent: int = PERCENT, cap: int = CAP) -> DataFrame:
    """Adds weight and target (double) to a table of one row per source: source, source_size."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place + 1).cast("int"))
    table = sizes.withColumn("weight", weight.cast("long")).withColumn("place", F.row_number().over(order))
    table = tmp.write(table.withColumn("full", F.lit(False)))
    limit = cap * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        r = table.agg(
            F.sum(F.when(~F.col("full"), F.col("weight"))).alias("w"),
            F.sum(F.when(F.col("full"), limit)).alias("used"),
            F.count_if("full").alias("n"),
        ).first()
        # (percent / 100 * total - used) * weight / w, as one division of whole numbers.
        share = F.lit(float(percent * total - 100 * (r["used"] or 0))) * F.col("weight").cast("double") / F.lit(float(100 * (r["w"] or 1)))
        marked = tmp.write(table.withColumn("full", F.col("full") | (share > limit.cast("double"))))
        if marked.where("full").count() == r["n"]:
            return table.withColumn("target", F.when(F.col("full"), limit.cast("double")).otherwise(share)).drop("full")
        table = marked


def shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def _before(df: DataFrame, keys: list[str], bucket: str, value: str, name: str) -> DataFrame:
    """(keys, bucket, name): sum of value in the buckets before each, from one row per bucket."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, bucket, F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias(name))


def _placed(docs: DataFrame, seed: int, keep: tuple[str, ...], tmp: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, placed, sources): the input's rows with ``uid`` and ``is`` (a struct of the columns kept); where
    each lies in its source's shuffled words; one row per source."""
    kept = F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)) for c in keep]).alias("is")
    rows = docs.select(kept, "doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("uid"))
    rows = tmp.write(rows)
    sized = rows.select("uid", "doc_id", "source", "size", shuffle_key(F.col("doc_id"), seed).alias("key"))
    sized = sized.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % BUCKETS)
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), tmp).select("source", "place", "source_size", "target")
    sources = tmp.write(sources.withColumn("goal", F.floor("target").cast("long")))
    named = broadcast_if_small(sources).withColumnRenamed("source", "named")
    sized = sized.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    # One bucket order for all: the beginning of the shuffle key.
    before = tmp.write(_before(sized, ["place"], "bucket", "size", "offset"))
    w = Window.partitionBy("place", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("upto", F.sum("size").over(w)).join(before, ["place", "bucket"])
    placed = placed.select("uid", "place", "size", "source_size", "target", (F.col("offset") + F.col("upto") - F.col("size")).alias("start"))
    return rows, tmp.write(placed), sources


def _pieces(placed: DataFrame, sources: DataFrame, block_tokens: int, tmp: Scratch) -> DataFrame:
    """(uid, slot, first_word, words): which words of which row each slot takes; words count from 0."""
    b = F.lit(block_tokens)
    lies = placed.where("size > 0").select("uid", "place", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * b)
    last = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.least(b, F.col("words")))
    met = lies.join(schedule(sources, block_tokens, tmp), ["place", "block"])
    return met.select("uid", "slot", (first - F.col("start")).alias("first_word"), (last - first).alias("words")).where("words > 0")


def pieces(docs: DataFrame, seed: int = 17, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, doc_id, first_word, words, text): the mix itself, a row for each document that a slot takes of.

    In the order of slot, then as the words lie in the block, the texts are the stream to train on."""
    with Scratch(docs.sparkSession) as tmp:
        rows, placed, sources = _placed(docs, seed, ("text",), tmp)
        got = _pieces(placed, sources, block_tokens, tmp).join(rows.select("uid", "doc_id", F.col("is")["text"].alias("text")), "uid")
        found = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
        part = F.array_join(F.slice(found, (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), " ")
        return tmp.keep(tmp.write(got.select("slot", "doc_id", "first_word", "words", part.alias("text"))))


def mix(docs: DataFrame, seed: int = 17, block_tokens: int = BLOCK_TOKENS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, doc_id, source, size, source_size, target, taken, first_slot) for every row of docs."""
    with Scratch(docs.sparkSession) as tmp:
        rows, placed, sources = _placed(docs, seed, keep, tmp)
        met = _pieces(placed, sources, block_tokens, tmp).groupBy("uid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
        facts = placed.select("uid", "source_size", "target").join(met, "uid", "left")
        facts = tmp.write(facts.select("uid", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"))
        own = [F.col("is")[c].alias(c) for c in keep]
        return tmp.keep(tmp.write(rows.join(facts, "uid").select(*own, "doc_id", "source", "size", "source_size", "target", "taken", "first_slot")))


def golden_point(slot: Column) -> Column:
    """frac((slot + 1) / phi) in units of 2**-32, by whole numbers that stay below 2**63."""
    i = (slot + 1) % ONE
    high, low = F.shiftright(i, 16), i % 65_536
    return ((high * GOLDEN) % 65_536 * 65_536 + low * GOLDEN) % ONE


def schedule(sources: DataFrame, block_tokens: int, tmp: Scratch) -> DataFrame:
    """(slot, place, block, words): the source and block each slot of the mix takes, and how much of it.

    sources has one row per source: place, source_size, goal (whole words to take)."""
    spark = sources.sparkSession
    live = sources.where("goal > 0").select("place", "source_size", "goal").withColumn("blocks", F.ceil(F.col("source_size") / block_tokens))
    # A pass over a source ends with a short block, so slots are counted in passes and rests.
    rest = F.col("goal") % F.col("source_size")
    live = tmp.write(live.withColumn("need", F.floor(F.col("goal") / F.col("source_size")) * F.col("blocks") + F.ceil(rest / block_tokens)))
    n = live.agg(F.sum("need")).first()[0] or 0
    # Each source's part of the unit interval, in units of 2**-32: one row a source.
    w = Window.orderBy("place")
    high = F.sum("need").over(w)
    edge = [F.floor(x.cast("decimal(38,0)") * F.lit(ONE).cast("decimal(38,0)") / F.lit(max(n, 1))).cast("long") for x in (high - F.col("need"), high)]
    edges = tmp.write(live.select("place", edge[0].alias("low"), edge[1].alias("high")).where("low < high"))
    # Slots beyond n cover the discrepancy; each source keeps its first ``need`` of them.
    spare = n + 64 + 8 * int(n**0.5)
    drawn = spark.range(spare).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("x"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    # Each point finds its source by its cell of the interval: an equi-join on cells.
    cell = ONE // 4096
    cells = edges.select("place", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))).alias("cell"))
    drawn = drawn.withColumn("cell", F.floor(F.col("x") / cell)).join(cells, "cell").where("x >= low and x < high").select("slot", "chunk", "place")
    drawn = tmp.write(drawn)
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1)
    before = _before(drawn.withColumn("one", F.lit(1)), ["place"], "chunk", "one", "offset")
    ranked = ranked.join(before, ["place", "chunk"]).withColumn("k", F.col("r") + F.col("offset")).join(live, "place").where("k < need")
    got = tmp.write(ranked)
    # A source that drew fewer than it needs gets the missing slots at the end.
    short = live.join(got.groupBy("place").agg(F.count("*").alias("have")), "place", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    late = short.where("have < need").select("place", "source_size", "goal", "blocks", "need", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("k")).withColumn("slot", F.lit(spare) + F.col("k"))
    cols = ["slot", "place", "k", "source_size", "goal", "blocks"]
    every = got.select(*cols).unionByName(late.select(*cols))
    block = F.col("k") % F.col("blocks")
    done = F.floor(F.col("k") / F.col("blocks")) * F.col("source_size") + block * block_tokens
    taken = F.least(F.lit(block_tokens), F.col("source_size") - block * block_tokens, F.col("goal") - done)
    return every.select("slot", "place", block.alias("block"), taken.alias("words"))
