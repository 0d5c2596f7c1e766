"""Language identification with interpolated Kneser-Ney character models.

One model per language, over letter runs with a boundary mark before and after, orders 1 to ORDER.
Counts are gathered by Spark; the tables are sorted hash arrays, one pair (hashes, values) for each
order, so a probability is a few binary searches. A text gets the language of lowest cross-entropy
per character. A text is rejected if that cross-entropy is higher than the calibrated bound of its
language, which allows for the length of the text.

Fitting uses a bounded sample of labelled rows: at most about ``docs_per_language`` whole texts of
each language and SAMPLE of all, those of lowest hash. All n-grams of the sample are kept. A fifth of the
sample is not fitted on: it gives the bounds for rejection. Prediction reads the whole text and nothing
but the text.

Defined results: null text, or text without a letter (Unicode category L), gives ``und``, score 0,
rejected; rows without language never train; with no labelled rows at all every text is ``und``; a
language with too few texts to set some aside is calibrated on those it was fitted on; repeated rows
each get their row; ties go to the language that sorts first; very long texts are scored in parts and
summed; ``accepted`` passes all other columns on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted

ORDER = 4
_LETTERS = regex.compile(r"\p{L}+")
#: Texts that all languages together are fitted on at most, and the part of them, one in so many, set aside.
SAMPLE, ASIDE = 60_000, 5
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_MARK = 0x10FFFF
#: Words whose scores a task keeps; it starts afresh beyond that.
CACHE_WORDS = 100_000


def _gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each position; the first n - 1 are not meaningful."""
    h = np.full(len(codes), n, dtype=_U) * _STEP
    for back in range(n - 1, -1, -1):
        c = np.zeros(len(codes), dtype=_U)
        c[back:] = codes[: len(codes) - back]
        h = (h ^ (c + _U(1))) * _U(0xFF51AFD7ED558CCD)
        h ^= h >> _U(31)
    return h


@dataclass
class CharModel:
    """Interpolated Kneser-Ney: p = a(gram) + b(history) * p of the shorter gram, as sorted arrays."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    histories: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: float = 1e-6
    mean: float = 0.0
    spread: float = 1.0

    @classmethod
    def fit(cls, grams: list[str], counts: np.ndarray) -> CharModel:
        """From the counts of all n-grams of orders 1 to ORDER (marks included)."""
        import pandas as pd  # on the driver alone: workers stay without it, 45 MB smaller

        out = cls()
        table = pd.DataFrame({"g": grams, "c": counts.astype(float)})
        table["n"] = table["g"].str.len()
        for n in range(1, ORDER + 1):
            now = table[table["n"] == n][["g", "c"]].copy()
            if n < ORDER:  # a shorter gram counts once for each symbol seen before it, at a word's start as often as it is seen
                longer = table[table["n"] == n + 1]["g"].str[1:].value_counts()
                kept = now["g"].map(longer)
                now["c"] = np.where(now["g"].str[0] == " ", now["c"], kept.fillna(1.0))
            ones, twos = (now["c"] == 1).sum(), (now["c"] == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.75
            h = now["g"].str[:-1]
            total = now["c"].groupby(h).transform("sum")
            a = np.maximum(now["c"] - d, 0) / total
            out.grams.append(cls._sorted(now["g"], a, n))
            left = pd.DataFrame({"h": h, "left": d / total}).groupby("h")["left"].agg(["first", "size"])
            out.histories.append(cls._sorted(left.index.to_series(), left["first"] * left["size"], n - 1))
            if n == 1:
                out.floor = float(left["first"].iloc[0] * left["size"].iloc[0] / 1000) if len(left) else 1e-6
        return out

    @staticmethod
    def _sorted(grams: Iterable[str], values: Any, n: int) -> tuple[np.ndarray, np.ndarray]:
        hashes = _hashes_of(list(grams), n)
        order = np.argsort(hashes)
        return hashes[order], values.to_numpy(dtype=np.float32)[order]

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, missing: float) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return np.full(len(h), missing, dtype=np.float32)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], np.float32(missing))

    def surprise(self, hashes: list[tuple[np.ndarray, np.ndarray]], depth: np.ndarray) -> np.ndarray:
        """-log p at each position; hashes[n] are the distinct ones of order n, sorted, and which each position has;
        depth is the marks and letters so far. Sorted, few hashes are found fast in the sorted arrays."""
        p = np.full(len(depth), self.floor, dtype=np.float32)
        p = self._find(self.grams[0], hashes[1][0], 0.0)[hashes[1][1]] + p
        for n in range(2, ORDER + 1):
            back = self._find(self.histories[n - 1], hashes[n - 1][0], 1.0)[hashes[n - 1][1]]
            back = np.concatenate([back[:1], back[:-1]])
            more = self._find(self.grams[n - 1], hashes[n][0], 0.0)[hashes[n][1]] + back * p
            p = np.where(depth >= n, more, p)
        return -np.log(np.maximum(p, 1e-12))


def _hashes_of(grams: list[str], n: int) -> np.ndarray:
    """The hashes of grams of n symbols each, a space standing for the mark."""
    codes = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32).astype(_U).reshape(len(grams), n)
    codes = np.where(codes == _U(32), _U(_MARK), codes)
    h = np.full(len(grams), n, dtype=_U) * _STEP
    for i in range(n):
        h = (h ^ (codes[:, i] + _U(1))) * _U(0xFF51AFD7ED558CCD)
        h ^= h >> _U(31)
    return h


@dataclass
class Identifier:
    languages: list[str]
    models: list[CharModel]
    tolerance: float

    def score_words(self, words: list[str]) -> np.ndarray:
        """Per word: summed surprise in each language, then the number of symbols scored."""
        out = np.zeros((len(words), len(self.models) + 1), dtype=np.float64)
        runs, owner = [], []
        for i, w in enumerate(words):
            for run in _LETTERS.findall(w):
                runs.append(run)
                owner.append(i)
        if not runs:
            return out
        codes = np.frombuffer(("\U0010ffff" + "\U0010ffff".join(runs) + "\U0010ffff").encode("utf-32-le"), dtype=np.uint32).astype(_U)
        marks = np.flatnonzero(codes == _U(_MARK))
        lengths = np.diff(marks)
        last = np.zeros(len(codes), dtype=np.int64)
        last[marks] = marks
        np.maximum.accumulate(last, out=last)
        start = np.concatenate([[0], last[:-1]])  # the mark before each position, itself excluded
        depth = np.arange(len(codes)) - start + 1
        hashes = [None, *(np.unique(_gram_hashes(codes, n), return_inverse=True) for n in range(1, ORDER + 1))]
        word = np.concatenate([[-1], np.repeat(np.array(owner), lengths)])
        real = word >= 0
        for k, m in enumerate(self.models):
            out[:, k] = np.bincount(word[real], weights=m.surprise(hashes, depth)[real], minlength=len(words))
        out[:, -1] = np.bincount(word[real], minlength=len(words))
        return out


class _Scores(dict):
    """word -> row of ``values``; new words wait in ``fresh`` until they are scored together."""

    def __init__(self, model: Identifier):
        super().__init__()
        self.model, self.fresh, self.used = model, [], 0
        self.values = np.zeros((1024, len(model.models) + 1))

    def __missing__(self, word: str) -> int:
        self[word] = at = self.used + len(self.fresh)
        self.fresh.append(word)
        return at

    def settle(self) -> None:
        if self.fresh:
            end = self.used + len(self.fresh)
            if end > len(self.values):
                grown = np.zeros((max(end, 2 * len(self.values)), self.values.shape[1]))
                grown[: self.used] = self.values[: self.used]
                self.values = grown
            self.values[self.used : end] = self.model.score_words(self.fresh)
            self.fresh, self.used = [], end


#: Texts that are decoded at a time, and words that are looked up at a time.
ROWS = 500
_PART = 20_000


def _totals(scores: _Scores, texts: list[str | None]) -> np.ndarray:
    """Per text: summed surprise in each language, then symbols. Words stay in ``scores`` up to CACHE_WORDS."""
    out = np.zeros((len(texts), len(scores.model.models) + 1))
    at, owner, waiting = [], [], 0

    def settle() -> None:
        nonlocal at, owner, waiting
        scores.settle()
        for i, ids in zip(owner, at):
            out[i] += scores.values[ids].sum(axis=0)
        at, owner, waiting = [], [], 0
        if len(scores) > CACHE_WORDS:
            scores.clear()
            scores.used = 0

    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        for first in range(0, len(words), _PART):
            part = words[first : first + _PART]
            at.append(np.fromiter(map(scores.__getitem__, part), dtype=np.int64, count=len(part)))
            owner.append(i)
            waiting += len(part)
            if waiting >= _PART:
                settle()
    settle()
    return out


def _grams(word: Column) -> Column:
    """All n-grams of orders 1 to ORDER of a marked word, the opening mark alone left out."""
    mark = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(mark)

    def cut(n: int) -> Column:
        places = F.sequence(F.lit(2 if n == 1 else 1), F.greatest(size - n + 1, F.lit(2)))
        return F.filter(F.transform(places, lambda i: F.substring(mark, i, F.lit(n))), lambda g: F.length(g) == n)

    return F.flatten(F.array(*[cut(n) for n in range(1, ORDER + 1)]))


def train(labelled: DataFrame, docs_per_language: int = 600, tolerance: float = 1.5) -> Identifier:
    """Fit on rows with doc_id, text and lang (null texts and languages are left out)."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = min(docs_per_language, max(1, SAMPLE // max(len(sizes), 1)))
    parts = [(lang, min(1.0, each / n), min(each, n) >= 10 * ASIDE) for lang, n in sizes.items()]
    parts = F.broadcast(rows.sparkSession.createDataFrame(parts, "lang string, share double, halved boolean"))  # a row for each language
    pick, other = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_003)) for seed in (7, 8))
    sample = rows.join(parts, "lang").where(pick < F.col("share") * 1_000_003)
    sample = sample.select("lang", "text", (F.col("halved") & (other % ASIDE == 0)).alias("aside"))
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    counts = sample.where("not aside").select("lang", F.explode(letters).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    counts = counts.select("lang", "c", F.explode(_grams(F.col("w"))).alias("g"))
    # No more rows than the sample has n-grams.
    counts = counts.groupBy("lang", "g").agg(F.sum("c").alias("c")).toPandas()
    by = {lang: own for lang, own in counts.groupby("lang")}
    languages = sorted(lang for lang in sizes if lang in by)
    models = [CharModel.fit(by[lang]["g"].tolist(), by[lang]["c"].to_numpy()) for lang in languages]
    model = Identifier(languages, models, tolerance)
    if languages:
        _calibrate(model, sample)
    return model


def _calibrate(model: Identifier, sample: DataFrame) -> None:
    """Mean cross-entropy of each language's texts that were set aside, and its spread for a text of one symbol."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = _Scores(m)
        for batch in batches:
            t = _totals(scores, batch.column(1).to_pylist())
            own = np.array([m.languages.index(x) for x in batch.column(0).to_pylist()], dtype=int)
            n = np.maximum(t[:, -1], 1)
            h = t[np.arange(len(own)), own] / n if len(own) else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(h), pa.array(n)], names=["lang", "aside", "h", "n"])

    h = sample.where(F.col("lang").isin(model.languages)).mapInArrow(measure, "lang string, aside boolean, h double, n double")
    w, x = F.col("n"), F.col("h")
    some = F.least(w, F.lit(200.0))
    # The spread about the mean, from sums: one row for each language and part.
    sums = h.groupBy("lang", "aside").agg(F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(some).alias("s"), F.sum(some * x).alias("sx"), F.sum(some * x * x).alias("sxx")).collect()
    for r in sorted(sums, key=lambda r: r["aside"]):  # what was set aside comes last and counts
        m = model.models[model.languages.index(r["lang"])]
        m.mean = r["wx"] / r["w"]
        square = (r["sxx"] - 2 * m.mean * r["sx"] + m.mean * m.mean * r["s"]) / r["k"]
        m.spread = max(max(square, 0.0) ** 0.5, 0.5)


OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predict(scores: _Scores, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and rejection of each text."""
    model = scores.model
    if not model.models:
        none = np.zeros(len(texts))
        return ["und"] * len(texts), none, none, np.ones(len(texts), dtype=bool)
    t = _totals(scores, texts)
    n = t[:, -1]
    h = t[:, :-1] / np.maximum(n, 1)[:, None]
    best = h.argmin(axis=1) if len(texts) else np.zeros(0, dtype=int)
    low = h[np.arange(len(best)), best]
    score = 1 / np.exp((low[:, None] - h) * np.minimum(n, 40)[:, None]).sum(axis=1)
    mean, spread = (np.array([getattr(m, k) for m in model.models])[best] for k in ("mean", "spread"))
    bound = mean + model.tolerance + 4 * spread / np.sqrt(np.maximum(n, 1))
    empty = n == 0
    langs = ["und" if e else model.languages[b] for e, b in zip(empty, best)]
    return langs, np.where(empty, 0.0, score), np.where(empty, 0.0, low), empty | (low > bound)


def identify(docs: DataFrame, model: Identifier, keep: list[str], name: str = "") -> DataFrame:
    """The columns named in keep, and lang_pred, score, cross_entropy, rejected, from ``text`` alone.

    ``name`` goes before the four new names, where the input may already have such columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # The columns go as one struct, so their names may be any; the text is read out of it if it is one of them.
    row = F.struct(*[F.col(quoted(c)) for c in keep]).alias("row")
    at = keep.index("text") if "text" in keep else None
    kept = docs.select(row) if at is not None else docs.select(row, "text")
    schema = T.StructType([kept.schema["row"], *OUT.fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        for batch in (b.slice(first, ROWS) for b in batches for first in range(0, b.num_rows, ROWS)):
            texts = batch.column(1) if at is None else batch.column(0).field(at)
            langs, s, h, no = predict(scores, texts.to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(s, pa.float64()), pa.array(h, pa.float64()), pa.array(no, pa.bool_())], names=schema.names)

    found = kept.mapInArrow(score, schema)
    return found.select(*[F.col("row")[c].alias(c) for c in keep], *[F.col(f.name).alias(name + f.name) for f in OUT.fields])


def accepted(docs: DataFrame, model: Identifier) -> DataFrame:
    """The rows of docs whose text the model does not reject."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return identify(docs, model, docs.columns, name=prefix).where(~F.col(f"{prefix}rejected")).select(*map(quoted, docs.columns))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
