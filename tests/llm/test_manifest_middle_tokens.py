"""Merkle manifest, fill-in-middle and token counts against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from vellumetry.llm import fill_middle, merkle, token_counts

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, idx long, path string, `a.b` string, row string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    """(those before, those after) of each level below the root."""
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append((level[run:i], level[i + 1 : run + 3]))
        i //= 3
    return out


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in sources}
    trees = {s: tree([leaf(r, r[1]) for r in own[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(own[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for before, after in path:
                folded = h([*before, folded, *after])
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], h([d for b, a in path for d in b + a]), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def table(n, seed):
    rng = random.Random(seed)
    extra = [7, "p", "x", "y"]
    out = [(i, rng.choice(["one\ntwo", "plain", "", None, "é\n\n"]), rng.choice(["en", None]), "hot" if rng.random() < 0.7 else rng.choice([None, "", "b", "é", "\U0001f600", "￿"]), rng.choice([3, None]), *extra) for i in range(n)]
    return out + [(5, "again", "en", "hot", 5, *extra)] * 3 + [(None, "no id", None, "hot", None, *extra)] * 2 + [(1, "alone", "en", "z", 5, *extra)]


@pytest.mark.parametrize("step,n", [(1, 60), (2, 300), (8, 300)])
def test_manifest_is_brute_force(spark, monkeypatch, step, n):
    monkeypatch.setattr(merkle, "STEP", step)
    rows = table(n, step)
    got = merkle.digest(spark.createDataFrame(rows, FIELDS).repartition(7)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)
    assert any(not r.verified for r in got) and any(r.verified for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10])
def test_manifest_of_small_trees(spark, n):
    rows = [(i, "a\nb", None, "s", i, 7, "p", "x", "y") for i in range(n)]
    got = merkle.digest(spark.createDataFrame(rows, FIELDS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)


def test_any_change_breaks_the_proof(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(table(80, 3), FIELDS)
    got = merkle.manifest(docs, found=F.concat(F.coalesce("text", F.lit("")), F.lit("!")))
    assert got.where("folded = root").count() == 0 and merkle.manifest(docs).where("folded <> root").count() == 0


def test_frontier_is_small_where_leaves_lie_in_order(spark):
    """The first pass, which shuffles nothing, resolves all but a few children a file."""
    docs = spark.range(5000).selectExpr("'=s' tree", "id at", "unhex(sha2(string(id), 256)) digest", "struct(id) row")
    from vellumetry.llm.common import Scratch

    with Scratch(spark) as tmp:
        ranked, _ = merkle._ranked(docs, tmp)
        made = merkle._combine(ranked.selectExpr("tree", "n", "0 level", "idx", "digest"))
        left = made.where("children is null").count()
        assert left <= 4 * 8 * len(ranked.inputFiles())
        assert made.where("children is not null").count() + left > 2000


TEXTS = ["", None, "a", "ab c", "<", "<P", "P>", "<P>", "x<S>y", "<M>", "<<S", "S>M>P>", "a<b>c<d", "\U0001f600é z", "line\nbreak\r\n", "word " * 500, "\0  "]


def brute_middle(doc_id, text, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in marks) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_are_brute_force_and_restored(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(["<", "P", "S", "M", ">", "ab", " ", "é"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    rows = [(None if i == 3 else i, t, None, None, None, 7, "p", "x", "y") for i, t in enumerate(texts)]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, FIELDS), keep=("doc_id", "text", "a.b", "row"))
    got = made.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_middle(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_the_matcher_keeps_no_units():
    """Memory beyond the text and its parts does not grow with the number of units."""
    import tracemalloc

    unit, peaks = re.compile(fill_middle.UNIT), []
    for n in (10_000, 200_000):
        text = "a " * n
        tracemalloc.start()
        count = sum(1 for _ in unit.finditer(text))
        fill_middle.cut(text, unit, count // 3, count // 2)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count == 2 * n
    assert peaks[1] < peaks[0] + 10_000


PARTS = ["a", "B", "'s", "'S", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "́", "é", "Å", "ﬁ", "İ", "Σ", "1", "²", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|end", "|>", "中", "한", "\0", "​", "don't"]


def token_rows():
    rng = random.Random(6)
    texts = [None, "", "   ", "x" * 5000, "x" * 5000 + " y", "\0\0" * 80 + " " + "\0", "<|endoftext|>" * 3, "a <|endoftext|>b", "word " * 30_000]
    return texts + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["same text here"] * 40


@pytest.mark.parametrize("size", [1, 300, 16 << 20])
def test_token_counts_are_the_librarys(spark, size):
    """Whatever the chunks: of one text each, of a few, of all."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    rows = [(None if i == 2 else i, t, None, None, None, 7, "p", "x", "y") for i, t in enumerate(token_rows())]
    docs = spark.createDataFrame(rows, FIELDS)
    got = token_counts.token_counts(docs, PATH, keep=("doc_id", "text", "a.b"), chunk_bytes=size).select("row.doc_id", "row.text", "n_bytes", "n_tokens").collect()
    want = [(r[0], r[1], len((r[1] or "").encode()), len(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_of_any_tokenizer(name):
    """One that drops white space is cut by words, one that keeps it text by text."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    cutter, whole = token_counts.Cutter(path), Tokenizer.from_file(path)
    assert cutter.by_word == name.startswith("word")
    chunk = token_counts.Chunk(cutter)
    for text in token_rows()[1:]:
        chunk.add(text)
    names, fixed, data = chunk.frequencies()
    assert len(set(names)) == len(names) and max(map(len, names)) <= token_counts.LONG
    pieces = np.array([cutter.pieces(p) for p in names])
    for text, f, d in zip(token_rows()[1:], fixed, data):
        codes, times = token_counts.unpacked(d)
        assert (np.diff(codes) > 0).all() and (times > 0).all()
        assert f + pieces[codes] @ times == len(whole.encode(text, add_special_tokens=False).ids)


def test_each_distinct_pre_token_is_counted_once(monkeypatch):
    import pyarrow as pa

    asked = []

    class Model:
        def pieces(self, p):
            asked.append(p)
            return len(p)

    monkeypatch.setattr(token_counts, "_cutter", lambda path: Model())
    frames = []

    class Keys:
        def mapInArrow(self, work, schema):
            batches = [pa.record_batch([pa.array(range(len(k))), pa.array([7] * len(k), pa.int32()), pa.array(k)], names=["chunk", "code", "key"]) for k in (["a", "a", "bb"], ["bb", "bb", "c"])]
            frames.extend(work(iter(batches)))

    token_counts._pieces(Keys(), PATH)
    assert asked == ["a", "bb", "c"] and [b.column(2).to_pylist() for b in frames] == [[1, 1, 2], [2, 2, 1]]


def test_limits_and_the_tables_counts(spark, sf_dir):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = token_counts.limited(docs, PATH).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)
