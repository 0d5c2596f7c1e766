"""Token counts from pre-token frequencies: pieces are counted once for each distinct pre-token.

1. Texts are cut into pre-tokens the way the tokenizer file says (special strings, normaliser, pre-tokenizer
   of the library), in chunks of CHUNK_BYTES of text. A chunk is stored as its distinct pre-tokens, numbered by
   how often they come, and for each document the numbers of its pre-tokens with their frequencies. If
   the file's rules drop white space, a text is cut at ASCII white space first and each distinct word of a
   chunk is normalised once, as no rule then looks beyond a word.
2. The chunks' pre-tokens are shuffled and sorted by their text, and the tokenizer's model says for each
   distinct one, once, how many pieces it has. A pre-token comes once a chunk, however many documents have
   it, so a word of all texts is no hot key. No list of ids is kept.
3. The numbers of pieces go back to their chunks, where they are joined to the documents' frequencies and
   summed. Groups are chunks, so they are bounded by their bytes of text.

Special strings inside texts count as one token each, the library's default. Pre-tokens of more than LONG
characters are counted in their chunk and not shuffled. Defined results: null text counts as empty; a text
without pre-tokens has 0 tokens; repeated rows each get their row; a null doc_id is kept; an empty table gives
an empty result; very long texts and very long pre-tokens are counted whole; of other columns those in ``keep``
come back inside ``row``, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, quoted

#: Bytes of text of a chunk (a longer text is a chunk of its own), and characters of a pre-token that is shuffled.
CHUNK_BYTES, LONG = 16 << 20, 64
#: Rows that a worker turns to Python strings at a time, and words that it cuts together.
ROWS, TOGETHER = 256, 20_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PLAIN = re.compile(r"\S+")


class Cutter:
    """Cuts words or texts into pre-tokens as the library does for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model, self.normalizer, self.cut = whole.model, whole.normalizer, whole.pre_tokenizer
        added = list(whole.get_added_tokens_decoder().values())
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path}: added tokens that are normalised, stripped or words of their own are not supported")
        # Of special strings at one place the longest counts.
        known = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, known))) if known else None
        # Do the rules drop white space, so that words can be cut one by one?
        parts = [self._plain(x) for x in ("ab", "\u0301c.", "ab \n\t\u0301c.  ")]
        self.by_word = parts[0] + parts[1] == parts[2] and not any(_WORD.fullmatch(x) is None for x in known)

    def _offsets(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        if not text:
            return []
        return self.cut.pre_tokenize_str(text) if self.cut is not None else [(text, (0, len(text)))]

    def _plain(self, text: str) -> tuple[str, ...]:
        return tuple(p for p, _ in self._offsets(self.normalizer.normalize_str(text) if self.normalizer is not None else text))

    def pre_tokens(self, text: str) -> tuple[int, tuple[str, ...]]:
        """(special strings, pre-tokens between them)."""
        if self.special is None or not self.special.search(text):
            return 0, self._plain(text)
        between = self.special.split(text)
        return len(between) - 1, tuple(p for t in between if t for p in self._plain(t))

    def words(self, text: str) -> list[str]:
        """What can be cut by itself."""
        return _WORD.findall(text) if self.by_word else [text]

    def _together(self, words: list[str]) -> list[tuple[int, tuple[str, ...]]] | None:
        """Plain words cut in one call; None if a rule does not leave them one by one."""
        line = " ".join(words)
        line = self.normalizer.normalize_str(line) if self.normalizer is not None else line
        sizes = [len(w) for w in line.split(" ")]
        if len(sizes) != len(words):
            return None
        out, own, at, end = [], [], 0, sizes[0]
        for p, (start, stop) in self._offsets(line):
            while start > end:
                out.append((0, tuple(own)))
                own = []
                at += 1
                end += 1 + sizes[at]
            if stop > end:
                return None
            own.append(p)
        out.append((0, tuple(own)))
        return out + [(0, ())] * (len(words) - len(out))

    def cut_all(self, words: list[str]) -> list[tuple[int, tuple[str, ...]]]:
        """``pre_tokens`` of each; words without white space of any script in them are cut many at a time."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if _PLAIN.fullmatch(w) and not (self.special and self.special.search(w))] if self.by_word else []
        for first in range(0, len(plain), TOGETHER):
            some = plain[first : first + TOGETHER]
            for i, got in zip(some, self._together([words[i] for i in some]) or ()):
                out[i] = got
        return [self.pre_tokens(w) if got is None else got for w, got in zip(words, out)]

    def pieces(self, pre_token: str) -> int:
        return len(self.model.tokenize(pre_token))


@lru_cache(maxsize=2)
def _cutter(path: str) -> Cutter:
    """One a worker."""
    return Cutter(path)


class _Numbers(dict):
    """Numbers things in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def packed(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending codes and their times as bytes: differences, by planes of equal weight, compressed."""
    numbers = np.concatenate([np.diff(codes, prepend=0), times]).astype("<u4")
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    numbers = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    half = len(numbers) // 2
    return np.cumsum(numbers[:half]), numbers[half:]


class Chunk:
    """Texts and their words, until they are cut together."""

    def __init__(self, cutter: Cutter):
        self.cutter, self.numbers = cutter, _Numbers()
        self.words: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, text: str) -> None:
        counts = Counter(self.cutter.words(text))
        n = len(counts)
        self.words.append(np.fromiter(map(self.numbers.__getitem__, counts), dtype=np.int64, count=n))
        self.times.append(np.fromiter(counts.values(), dtype=np.int64, count=n))
        self.sizes.append(len(text.encode()))
        self.bytes += self.sizes[-1]

    def frequencies(self) -> tuple[list[str], np.ndarray, list[bytes]]:
        """(distinct pre-tokens, tokens of each text that need no pre-token, packed frequencies of each text)."""
        known, fixed, long = _Numbers(), [], {}
        flat, lengths = [], []
        for special, own in self.cutter.cut_all(list(self.numbers)):
            short = [p for p in own if len(p) <= LONG]
            for p in own:
                if len(p) > LONG:
                    if p not in long:
                        long[p] = self.cutter.pieces(p)
                    special += long[p]
            fixed.append(special)
            lengths.append(len(short))
            flat.extend(map(known.__getitem__, short))
        flat, lengths, fixed = (np.array(x, dtype=np.int64) for x in (flat, lengths, fixed))
        starts = np.cumsum(lengths) - lengths
        per = np.array([len(w) for w in self.words], dtype=np.int64)
        word, times, text = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (self.words, self.times, [np.repeat(np.arange(len(per)), per)]))
        extra = np.bincount(text, weights=fixed[word] * times, minlength=len(per)).astype(np.int64) if len(word) else np.zeros(len(per), dtype=np.int64)
        # Every word's pre-tokens in place of the word; equal ones of a text are then added up.
        n = lengths[word] if len(word) else word
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        code, times, text = flat[np.repeat(starts[word], n) + inside] if len(word) else word, np.repeat(times, n), np.repeat(text, n)
        order = np.argsort(-np.bincount(code, minlength=len(known)), kind="stable")
        rank = np.empty(len(known), dtype=np.int64)
        rank[order] = np.arange(len(known))
        cell, where = np.unique(text * max(len(known), 1) + rank[code], return_inverse=True)
        summed = np.bincount(where, weights=times, minlength=len(cell)).astype(np.int64)
        owner, code = np.divmod(cell, max(len(known), 1))
        edges = np.searchsorted(owner, np.arange(len(per) + 1))
        names = list(known)
        return [names[i] for i in order], extra, [packed(code[a:b], summed[a:b]) for a, b in zip(edges, edges[1:])]


_STORED = "chunk long, n_bytes long, fixed long, counts binary, keys array<string>"


def _frequencies(rows: DataFrame, path: str, chunk_bytes: int) -> DataFrame:
    """row, uid and text in. Out: for each text row, chunk, n_bytes, fixed and counts, and for each chunk a row with its keys."""
    kind = T.StructField("row", rows.schema["row"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(path)
        chunk, first, own = Chunk(cutter), None, []

        def flush() -> pa.RecordBatch:
            names, fixed, counts = chunk.frequencies()
            n = len(fixed)
            held = pa.chunked_array(own).combine_chunks()
            columns = [
                pa.concat_arrays([held, pa.nulls(1, held.type)]), pa.array([first] * (n + 1), pa.int64()), pa.array([*chunk.sizes, None], pa.int64()),
                pa.array([*map(int, fixed), None], pa.int64()), pa.array([*counts, None], pa.binary()), pa.array([None] * n + [names], pa.list_(pa.string())),
            ]
            return pa.record_batch(columns, names=["row", "chunk", "n_bytes", "fixed", "counts", "keys"])

        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            begin = 0
            for i, (uid, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                if first is not None and chunk.bytes + len(text) > chunk_bytes:
                    own.append(part.column(0).slice(begin, i - begin))
                    yield flush()
                    chunk, first, own, begin = Chunk(cutter), None, [], i
                first = uid if first is None else first
                chunk.add(text)
            own.append(part.column(0).slice(begin))
        if first is not None:
            yield flush()

    return rows.mapInArrow(work, T.StructType([kind, *T.StructType.fromDDL(_STORED).fields]))


def _pieces(keys: DataFrame, path: str) -> DataFrame:
    """(chunk, code, pieces) from (chunk, code, key) that come sorted by key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last, n = _cutter(path), None, 0
        for batch in batches:
            out = []
            for key in batch.column(2).to_pylist():
                if key != last:
                    last, n = key, cutter.pieces(key)
                out.append(n)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["chunk", "code", "pieces"])

    return keys.mapInArrow(work, "chunk long, code int, pieces long")


def _summed(texts: pa.Table, pieces: pa.Table) -> pa.Table:
    """The texts of one chunk with n_tokens."""
    size = np.zeros(pieces.num_rows, dtype=np.int64)
    size[pieces["code"].to_numpy()] = pieces["pieces"].to_numpy()
    out = []
    for fixed, data in zip(texts["fixed"].to_pylist(), texts["counts"].to_pylist()):
        codes, times = unpacked(data)
        out.append(fixed + int(size[codes] @ times))
    return pa.table({"row": texts["row"], "n_bytes": texts["n_bytes"], "n_tokens": pa.array(out, pa.int64())})


def token_counts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``row`` (a struct of the columns named in keep), n_bytes and n_tokens, for every row.

    path: a tokenizer file of the ``tokenizers`` library that all executors can read at this place."""
    with Scratch(docs.sparkSession) as tmp:
        rows = docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        stored = tmp.write(_frequencies(rows, path, chunk_bytes))
        keys = stored.where("keys is not null").select("chunk", F.posexplode("keys").alias("code", "key"))
        pieces = _pieces(keys.repartition("key").sortWithinPartitions("key"), path)
        texts = stored.where("keys is null").select("row", "chunk", "n_bytes", "fixed", "counts")
        out = texts.groupBy("chunk").cogroup(pieces.groupBy("chunk")).applyInArrow(_summed, T.StructType([stored.schema["row"], *T.StructType.fromDDL("n_bytes long, n_tokens long").fields]))
        return tmp.keep(tmp.write(out))


def limited(docs: DataFrame, path: str, most: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``most`` tokens)."""
    return token_counts(docs, path).select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"))
