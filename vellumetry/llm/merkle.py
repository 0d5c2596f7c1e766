"""Merkle manifest of a dataset: a tree over each source's documents, and one over the sources' roots.

Nodes stand by level and index; the children of parent p are the nodes 3p, 3p + 1, 3p + 2 below, of which
the last run may have fewer. How many a parent has follows from the number of leaves alone (``width``), so
nothing has to say when a run ends.

1. Ranks: leaves are sorted in ranges of (tree, order); a leaf's rank is its place in its range plus the sizes
   of the ranges before. No window spans a tree.
2. Combining (``_combine``), event-driven: each digest that comes in is put into its parent's partial run by
   its index; the one that completes the run makes the parent, which is itself an event one level up.
   The first pass reads the ranked leaves as they lie in their files, without a shuffle. What
   is left over in a task, the children of incomplete parents, is the frontier: it is shuffled by blocks of
   STEP levels and combined again, a block having at most ARITY ** STEP rows, until the roots are left.
   Each parent made leaves a reverse link: the digests of its children.
3. Proofs (``_descend``): reverse links are walked from the root down, in the same blocks: a child's path is its
   siblings, left to right, followed by its parent's path. Blocks of the lowest STEP levels are joined with
   the leaves there, so paths of leaves are made in the task that uses them, never stored.

A source with a third of all rows is many ranges and many blocks. Digests travel as 32 bytes; texts are read once.

Hashes: H is the hex sha256 of its inputs concatenated, digests as hex text. Defined results: nulls in any
field are written ``-`` and an empty text ``0:``; a null source is a source of its own, first; within a source a
null doc_id comes first, rows of one doc_id go by their leaf, and rows equal in all fields have one leaf each and
differ in their places; a source of one document has its leaf as subroot; of one source the subroot is the root;
an empty table gives an empty result; very long texts are hashed whole; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, broadcast_if_small

#: Children of a parent, and levels that one shuffle resolves: 3 ** 8 = 6561 leaves a block.
ARITY, STEP = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Kinds of rows in a block, in the order they are read: the path to its root, reverse links from the top, leaves.
_ROOT, _LINK, _LEAF = 0, 1, 2


def digest_of(parts: list[bytes]) -> bytes:
    """H of digests."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level."""
    for _ in range(level):
        leaves = -(-leaves // ARITY)
    return leaves


def height(leaves: int) -> int:
    """The root's level."""
    level = 0
    while leaves > 1:
        leaves, level = -(-leaves // ARITY), level + 1
    return level


def leaf_of(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Leaf digest of a row, 32 bytes, with ``text`` in place of the column of that name."""

    def written(name: str) -> Column:
        value = text if name == "text" else F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(written, fields)).cast("binary"), 256))


def _ranked(leaves: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """(leaves with idx, (tree, n, top)): rows of tree, at (what orders them), digest and row, in files that are each in order."""
    order = ["tree", "at", "digest", "tie"]
    # Equal rows are told apart by where they lay, so that they need not lie in one range.
    spread = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    spread = spread.select("tree", "digest", "row", F.spark_partition_id().alias("part"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, k = None, 0
        for batch in batches:
            places = []
            for tree in batch.column(0).to_pylist():
                last, k = tree, k + 1 if tree == last else 0
                places.append(k)
            yield pa.record_batch([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "place"])

    placed = tmp.write(spread.mapInArrow(number, T.StructType([*spread.schema.fields, T.StructField("place", T.LongType())])))
    # A row for each range and tree in it: no more than ranges and trees together.
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = tmp.write(counts.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("tree")).alias("n")))
    ranked = placed.join(broadcast_if_small(counts), ["tree", "part"]).select("tree", "n", (F.col("offset") + F.col("place")).alias("idx"), "digest", "row")
    return tmp.write(ranked.sortWithinPartitions("tree", "idx")), counts.select("tree", "n").distinct()


_EVENT = "tree string, n long, level int, idx long, first long, digest binary, children array<binary>"


def _combine(events: DataFrame) -> DataFrame:
    """Parents made of the events that meet in a task, with their children; and the frontier, without."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple[str, int, int, int], dict[int, bytes]] = {}
        names = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("first", pa.int64()), ("digest", pa.binary()), ("children", pa.list_(pa.binary()))])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 7, names)], schema=names)

        for batch in batches:
            out = []
            for tree, n, level, idx, digest in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                while True:
                    size = width(n, level)
                    if size == 1:
                        out.append((tree, n, level, idx, 0, digest, None))
                        break
                    parent = idx // ARITY
                    run = partial.setdefault((tree, n, level, parent), {})
                    run[idx] = digest
                    if len(run) < min(ARITY, size - ARITY * parent):
                        break
                    children = [run[i] for i in sorted(run)]
                    del partial[tree, n, level, parent]
                    level, idx, digest = level + 1, parent, digest_of(children)
                    out.append((tree, n, level, idx, idx * ARITY**level, digest, children))
            yield batch_of(out)
        left = [(tree, n, level, i, i * ARITY**level, d, None) for (tree, n, level, _), run in partial.items() for i, d in run.items()]
        for at in range(0, len(left), 10_000):
            yield batch_of(left[at : at + 10_000])

    return events.select("tree", "n", "level", "idx", "digest").mapInArrow(work, _EVENT)


def _block(step: int) -> Column:
    return F.floor(F.col("first") / F.lit(ARITY ** (STEP * step))).cast("long")


def _tops(ranked: DataFrame, rounds: int, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """(reverse links, (tree, n, digest) of every tree's root)."""
    made = tmp.write(_combine(ranked.select("tree", "n", F.lit(0).alias("level"), "idx", "digest")))
    links = [made.where("children is not null")]
    for step in range(1, rounds + 1):
        # Below a block's root everything is resolved but one node for each block of the step before.
        frontier = made.where("children is null").repartition("tree", _block(step)).sortWithinPartitions("tree", "first")
        made = tmp.write(_combine(frontier))
        links.append(made.where("children is not null"))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return every, made.where("children is null").select("tree", "n", "digest")


def _descend(roots: DataFrame, links: DataFrame, step: int, leaves: DataFrame | None = None) -> DataFrame:
    """Paths of the nodes STEP levels below, from the paths of blocks' roots and the reverse links between.

    roots: tree, n, level, idx, first, path (siblings from here to the root), known (any struct, carried down).
    The same columns come back; with leaves (tree, idx, digest, row) those come back, and row with them."""
    low, high = STEP * step, STEP * (step + 1)
    blank = F.lit(None)
    row = leaves.schema["row"].dataType if leaves is not None else T.StructType([])
    known = roots.schema["known"].dataType
    tail = [blank.cast("array<binary>").alias("children"), blank.cast("binary").alias("digest"), blank.cast(row).alias("row")] if leaves is not None else [blank.cast("array<binary>").alias("children")]
    rows = roots.select("tree", F.lit(_ROOT).alias("kind"), "n", "level", "idx", "first", "path", "known", *tail)
    carried = [blank.cast("array<binary>").alias("path"), blank.cast(known).alias("known")]
    between = links.where((F.col("level") > low) & (F.col("level") <= high))
    rows = rows.unionByName(between.select("tree", F.lit(_LINK).alias("kind"), "n", "level", "idx", "first", *carried, "children", *tail[1:]))
    if leaves is not None:
        rows = rows.unionByName(leaves.select("tree", F.lit(_LEAF).alias("kind"), "n", F.lit(0).alias("level"), "idx", F.col("idx").alias("first"), *carried, tail[0], "digest", "row"))
    rows = rows.withColumn("block", _block(step + 1)).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", F.desc("level"))
    names = rows.columns
    out = [*(f for f in rows.schema.fields if f.name in ("tree", "n", "level", "idx", "first", "path", "known", "digest", "row"))]
    inner = leaves is None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, paths, about = None, {}, None
        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field(f.name).type for f in out]
            done = []
            cols = {c: batch.column(names.index(c)).to_pylist() for c in names if c != "row"}
            for i, (tree, block, kind, n, level, idx) in enumerate(zip(*[cols[c] for c in ("tree", "block", "kind", "n", "level", "idx")])):
                if (tree, block) != here:
                    here, paths = (tree, block), {}
                if kind == _ROOT:
                    about = cols["known"][i]
                    paths[level, idx] = cols["path"][i]
                    if inner and level <= low:
                        done.append((i, tree, n, level, idx, cols["path"][i], about))
                elif kind == _LINK:
                    above, run = paths[level, idx], cols["children"][i]
                    for k, _ in enumerate(run):
                        path = run[:k] + run[k + 1 :] + above
                        paths[level - 1, idx * ARITY + k] = path
                        if inner and level - 1 == low:
                            done.append((i, tree, n, low, idx * ARITY + k, path, about))
                else:
                    done.append((i, tree, n, 0, idx, paths[0, idx], about))
            made = {"tree": [d[1] for d in done], "n": [d[2] for d in done], "level": [d[3] for d in done], "idx": [d[4] for d in done], "first": [d[4] * ARITY ** d[3] for d in done], "path": [d[5] for d in done], "known": [d[6] for d in done], "digest": [cols["digest"][d[0]] for d in done] if not inner else None}
            where = pa.array([d[0] for d in done], pa.int64())
            yield pa.record_batch([batch.column(names.index("row")).take(where) if f.name == "row" else pa.array(made[f.name], kind) for f, kind in zip(out, kinds)], names=[f.name for f in out])

    return rows.mapInArrow(work, T.StructType(out))


def _fold(paths: DataFrame) -> DataFrame:
    """digest, row and known, with proof (H of the path), folded (the root recomputed from row.folds and the path)."""
    fields = {f.name: f for f in paths.schema.fields}
    schema = T.StructType([fields["known"], fields["row"], T.StructField("digest", T.BinaryType()), T.StructField("proof", T.BinaryType()), T.StructField("folded", T.BinaryType())])
    rows = paths.select("known", "row", "digest", "path", "n", "idx", F.col("row.folds"), F.col("known.n").alias("trees"), F.col("known.idx").alias("place"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, folded = [], []
            for path, n, idx, now, trees, place in zip(*[batch.column(i).to_pylist() for i in range(3, 9)]):
                proofs.append(digest_of(path))
                at = 0
                for size, k in ((n, idx), (trees, place)):  # the source's tree, then the tree of sources
                    while size > 1:
                        run = min(ARITY, size - k // ARITY * ARITY) - 1
                        siblings = path[at : at + run]
                        siblings.insert(k % ARITY, now)
                        now, at = digest_of(siblings), at + run
                        size, k = -(-size // ARITY), k // ARITY
                folded.append(now)
            yield pa.record_batch([*batch.columns[:3], pa.array(proofs, pa.binary()), pa.array(folded, pa.binary())], names=schema.names)

    return rows.mapInArrow(work, schema)


def _tree(leaves: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(ranked leaves, reverse links, roots of the trees, shuffles that the highest tree needs)."""
    ranked, sizes = _ranked(leaves, tmp)
    rounds = -(-height(sizes.agg(F.max("n")).first()[0] or 0) // STEP)
    links, tops = _tops(ranked, rounds, tmp)
    return ranked, links, tmp.write(tops), rounds


def _level(n: Column) -> Column:
    """The root's level of a tree of n leaves: how many powers of ARITY are below n."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**i) for i in range(39)]), lambda x: x < n))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, found: Column | None = None) -> DataFrame:
    """doc_id, source, idx, leaf, subroot, root, proof, folded (all digests of 32 bytes): a row for each document.

    ``found`` is the text a document has when it is checked (its text, where none is given); ``folded`` is the
    root recomputed from that text's leaf and the proof, and differs from root if anything was changed."""
    with Scratch(docs.sparkSession) as tmp:
        kept = F.struct("doc_id", "source", leaf_of(F.col("text") if found is None else found, fields).alias("folds"))
        # A null source sorts before every other.
        tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
        leaves = docs.select(tree.alias("tree"), F.col("doc_id").alias("at"), leaf_of(F.col("text"), fields).alias("digest"), kept.alias("row"))
        ranked, links, subroots, rounds = _tree(leaves, tmp)
        over = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("at"), "digest", F.struct("tree", F.col("n").alias("leaves"), "digest").alias("row"))
        sources, above, root, more = _tree(over, tmp)
        top = root.first()
        total = F.lit(top["digest"] if top else None).cast("binary")

        def down(roots: DataFrame, links: DataFrame, rounds: int, leaves: DataFrame) -> DataFrame:
            for step in range(rounds - 1, 0, -1):
                roots = tmp.write(_descend(roots, links, step))
            return _descend(roots, links, 0, leaves)

        none = F.array().cast("array<binary>")
        begin = root.select("tree", "n", _level(F.col("n")).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("first"), none.alias("path"), F.struct(F.lit(0).alias("x")).alias("known"))
        outer = down(begin, above, more, sources).select("row", "path", F.struct("n", "idx", F.col("row.digest").alias("subroot")).alias("known"))
        outer = tmp.write(outer.select(F.col("row.tree").alias("tree"), F.col("row.leaves").alias("n"), "path", "known"))
        begin = outer.select("tree", "n", _level(F.col("n")).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("first"), "path", "known")
        done = _fold(down(begin, links, rounds, ranked))
        return tmp.keep(tmp.write(done.select("row.doc_id", "row.source", F.col("digest").alias("leaf"), "known.subroot", total.alias("root"), "proof", "folded")))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without its line feeds where 2 divides the crc32 of doc_id; a null doc_id is left alone."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(even, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    done = manifest(docs, found=tampered(F.col("doc_id"), F.col("text")))
    out = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded": "folded_root"}
    return done.select("doc_id", *[F.lower(F.hex(a)).alias(b) for a, b in out.items()], (F.col("folded") == F.col("root")).alias("verified"))
