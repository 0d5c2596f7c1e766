"""Benchmark decontamination by template windows.

Words are runs of letters and digits. Typed placeholders stand for what a re-parameterised question
changes: NUM for a word with a digit, UNIT for a unit word after a NUM, NAME for a capitalised word, at a
sentence's start only if it is none of the words that usually open one. Windows of WINDOW template words (an item with fewer words is one window)
are hashed and joined with the windows of the benchmark; windows that are mostly placeholders are hashed
by their literal words on both sides. Along each alignment of a document with an item, changed slots must
be consistent: one value of the item stands for one value of the document, and the other way round; a
window with another changed slot does not count. An item is found in a document if the windows of
alignments no further apart than the item is long cover at least ``least`` of it, of its windows that
are not literal or of all; or if RUN words of it stand in the document unchanged and in one run.

Document windows are screened by a bit array of fixed size before they are joined. That array only
saves work; the join decides. Its size does not grow with the benchmark.

Defined results: null and wordless texts have no windows; repeated rows are found each, and come out as
one row if their doc_id and text are equal; a null doc_id stays null; an empty benchmark finds nothing; of
equally covered places of an item the one with more windows is told, then that with a changed slot; very
long texts are cut into windows whole; ``find`` ignores other columns, ``clean`` passes them on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, free
from .shingles import chunks, combine, words_in

WINDOW, LEAST = 8, 0.3
#: Words of an item that are found whatever share of it they are.
RUN = 20
#: log2 of the bits of the screen.
SCREEN = 24
#: Unit words.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons "
    "ml l liter liters litre litres gallon gallons second seconds s minute minutes min hour hours h day days week weeks month months year years "
    "cent cents dollar dollars usd euro euros eur percent degree degrees watt watts kw volt volts meter meters metre metres mph kmh"
)

#: Words that open sentences and are no names, however they are written.
OPENERS = (
    "a about after all although an and another any are as assume at because before both but by calculate can compare complete compute consider consists could describe determine did do does during each "
    "either estimate evaluate every everyone explain express few find finally first following for from give given had has have he her here his how however i if imagine in initially is it its let list "
    "many may more most my name no none not note now of on once one only or other our out over read select several she should show simplify since so solve some someone state suppose that the their then "
    "there therefore these they this those three to today two under until up use using was we were what when where which while who whom whose why will with without would write yesterday yet you your"
)

_U = np.uint64
_GAP = np.ones(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _GAP[_a:_b] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:;\n\""]] = True
_IS_DIGIT = np.zeros(256, dtype=bool)
_IS_DIGIT[48:58] = True
_NUM, _UNIT, _NAME = (_U(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_LITERAL = _U(0x4444444444444444)


@functools.cache
def _hashes(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), dtype=np.uint8)
    return np.unique(words_in(data, np.array([0, len(data)]), _GAP)[0])


def _among(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, words), len(table) - 1)] == words


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash of each word, whether it is a slot, starts, ends, first words, literal hashes) of a chunk."""
    words, starts, ends, at = words_in(data, offsets, _GAP)
    if not len(words):
        return words, np.zeros(0, dtype=bool), starts, ends, at, words
    digits = np.concatenate([[0], np.cumsum(_IS_DIGIT[data])])
    number = digits[ends] > digits[starts]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(len(words), dtype=bool)
    opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
    opens[at[:-1][at[:-1] < len(words)]] = True
    lead = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = capital & ~number & ~(opens & _among(words, _hashes(OPENERS)))
    unit = np.zeros(len(words), dtype=bool)
    unit[1:] = _among(words, _hashes(UNITS))[1:] & number[:-1]
    unit[at[:-1][at[:-1] < len(words)]] = False
    out = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, words)))
    return out, number | unit | name, starts, ends, at, words


def _windows(column: pa.Array, widths: list[int], screen: np.ndarray | None) -> Iterator[tuple[int, int, int, int, list[str], bool]]:
    """(row, position, words of the row, hash, slot values, whether literal) of the windows that pass the screen.

    Without a screen, which is the benchmark's side, each row has windows of the one width that fits."""
    for first, last, data, offsets in chunks(column):
        template, slot, starts, ends, at, words = canonical(data, offsets)
        slots = np.concatenate([[0], np.cumsum(slot)])
        for width in widths:
            if len(template) < width:
                continue
            literal = 2 * (slots[width:] - slots[:-width]) > width
            h = np.where(literal, combine(words, width) ^ _LITERAL, combine(template, width))
            row = np.searchsorted(at, np.arange(len(h)), side="right") - 1
            ok = np.arange(len(h)) + width <= at[row + 1]
            if screen is None:
                ok &= np.minimum(at[row + 1] - at[row], max(widths)) == width
            else:
                bit = h & _U((1 << SCREEN) - 1)
                ok &= (screen[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1
            for i in np.flatnonzero(ok).tolist():
                values = [data[starts[j] : ends[j]].tobytes().decode("utf-8", "replace").lower() for j in range(i, i + width) if slot[j]]
                r = int(row[i])
                yield first + r, i - int(at[r]), int(at[r + 1] - at[r]), int(h[i : i + 1].view(np.int64)[0]), values, bool(literal[i])


def template_windows(rows: DataFrame, keys: list[str], widths: list[int], screen: np.ndarray | None = None) -> DataFrame:
    """keys, pos, words, h, slots, literal: the windows of ``text``, those that pass the screen if one is given."""
    kept = rows.select(*keys, F.col("text").alias("__text"))
    shared = rows.sparkSession.sparkContext.broadcast(screen)
    kinds = [kept.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", pos long, words long, h long, slots array<string>, literal boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for w in _windows(batch.column(len(keys)), widths, shared.value):
                held.append(w)
                if len(held) == 20_000:
                    yield made(batch, held)
                    held = []
            yield made(batch, held)

    def made(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        row, pos, words, h, slots, literal = zip(*held) if held else ((), (), (), (), (), ())
        at = pa.array(row, pa.int64())
        columns = [batch.column(i).take(at) for i in range(len(keys))]
        return pa.record_batch([*columns, pa.array(pos, pa.int64()), pa.array(words, pa.int64()), pa.array(h, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(literal, pa.bool_())], names=[*keys, "pos", "words", "h", "slots", "literal"])

    return kept.mapInArrow(cut, schema)


def _screen_of(hashes: DataFrame) -> np.ndarray:
    """The bit array of a column h; at most 2 ** (SCREEN - 6) rows are gathered."""
    bit = F.col("h").bitwiseAND(F.lit((1 << SCREEN) - 1))
    word = F.shiftright(bit, 6).alias("word")
    rows = hashes.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (SCREEN - 6), dtype=_U)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(_U)
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, item_id, windows, item_windows, coverage, reparameterised) of items found.

    docs has doc_id and text, benchmark has item_id and text."""
    with Scratch(docs.sparkSession) as tmp:
        return tmp.keep(tmp.write(_found(docs, benchmark, window, least, tmp)))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, least: float, tmp: Scratch) -> DataFrame:
    widths = list(range(1, window + 1))
    items = tmp.write(template_windows(benchmark, ["item_id"], widths).withColumnsRenamed({"pos": "item_pos", "slots": "item_slots", "words": "item_words"}))
    whole = tmp.write(items.groupBy("item_id").agg(F.countDistinct("item_pos").alias("all"), F.countDistinct(F.when(~F.col("literal"), F.col("item_pos"))).alias("plain")))
    used = [r[0] for r in items.select(F.least("item_words", F.lit(window)).cast("int").alias("w")).distinct().collect()]  # at most ``window`` numbers
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    met = template_windows(keyed, ["doc_id", "text_hash"], sorted(used), _screen_of(items.select("h"))) if used else template_windows(keyed.limit(0), ["doc_id", "text_hash"], [window])
    pairs = met.drop("literal", "words").join(broadcast_if_small(items), "h")
    slot = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    keys = ["doc_id", "text_hash", "item_id"]
    one = F.struct(F.col("item_pos").alias("pos"), "literal", slot.alias("slot"))
    # Grouped by alignment: no more windows, and no more slots, than the item has.
    along = pairs.select(*keys, "item_words", (F.col("pos") - F.col("item_pos")).alias("shift"), one.alias("w")).groupBy(*keys, "item_words", "shift").agg(F.collect_set("w").alias("w"))
    along = along.withColumn("slot", F.array_distinct(F.flatten("w.slot")))
    clash = F.filter("slot", lambda p: (p["a"] != p["b"]) & F.exists("slot", lambda q: (q["a"] == p["a"]) != (q["b"] == p["b"])))
    along = along.withColumn("clash", clash).withColumn("w", F.filter("w", lambda w: ~F.arrays_overlap(w["slot"], F.col("clash"))))
    same = F.array_sort(F.transform(F.filter("w", lambda w: ~F.exists(w["slot"], lambda p: p["a"] != p["b"])), lambda w: w["pos"]))
    zero = F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(x == s["last"] + 1, s["n"] + 1).otherwise(1)
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(s["best"], n).alias("best"))

    along = along.where(F.size("w") > 0).withColumn("run", F.aggregate(same, zero, step, lambda s: s["best"]))
    # Alignments at most an item's length apart share a cell.
    cell = F.floor(F.col("shift") / F.col("item_words"))
    near = along.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    near = near.groupBy(*keys, "cell").agg(F.array_distinct(F.flatten(F.collect_set("w"))).alias("w"), F.max("run").alias("run"))
    count = lambda some: F.size(F.array_distinct(F.transform(some, lambda w: w["pos"])))
    changed = F.exists("w", lambda w: F.exists(w["slot"], lambda s: s["a"] != s["b"]))
    near = near.select(*keys, "run", changed.alias("changed"), count(F.col("w")).alias("all_met"), count(F.filter("w", lambda w: ~w["literal"])).alias("plain_met"))
    near = near.join(broadcast_if_small(whole), "item_id")
    part = F.coalesce(F.col("plain_met") / F.nullif(F.col("plain"), F.lit(0)), F.lit(0.0))
    by_all = F.col("all_met") / F.col("all") > part
    near = near.select(*keys, "run", "changed", F.when(by_all, F.col("all_met")).otherwise(F.col("plain_met")).cast("long").alias("windows"), F.when(by_all, F.col("all")).otherwise(F.col("plain")).alias("item_windows"))
    near = near.withColumn("coverage", F.col("windows") / F.col("item_windows"))
    best = near.groupBy(*keys).agg(F.max("run").alias("run"), F.max(F.struct("coverage", "windows", F.col("changed").alias("reparameterised"), "item_windows")).alias("best"))
    return best.where((F.col("best.coverage") >= least) | (F.col("run") >= max(1, RUN - window + 1))).select(*keys, "best.windows", "best.item_windows", "best.coverage", "best.reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in whose text no item is found. Null texts stay."""
    with Scratch(docs.sparkSession) as tmp:
        met, name = find(docs, benchmark), free("found", docs.columns)
        tmp.tables.append(met)
        found = tmp.keep(tmp.write(met.select(F.col("text_hash").alias(name)).distinct()))
    return docs.join(broadcast_if_small(found), F.xxhash64("text") == F.col(name), "left_anti")
