"""Each stage on its own input against a brute-force version, and what it must not lose."""

from __future__ import annotations

import re

import pandas as pd
import pytest

import corpus_pipeline
from tests.llm.test_operators import DOCS, PATTERNS, components, odd, shingles  # noqa: F401
from vellumetry.llm.common import shared_folder


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """The tables between the stages, the first one's input first."""
    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        path = shared_folder(spark)
        stage(spark, tables[-1], sf_dir).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return [t.toPandas().set_index("doc_id").sort_index() for t in tables]


def test_columns_and_counts(steps):
    for t in steps[1:5]:
        assert list(t.columns) == list(steps[0].columns)
    assert len(steps[1]) >= 0.99 * len(steps[0]) and len(steps[4]) == len(steps[3])


def test_language_stage(spark, sf_dir, steps):
    """Rejected are texts whose cross-entropy, word by word, is beyond the bound of their best language."""
    from vellumetry.llm.language import train

    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = set()
    for i, text in steps[0].text.items():
        total = sum(model.score_words([w])[0] for w in (text or "").lower().split()) if text and text.split() else None
        if total is None or not total[-1]:
            continue
        h = total[:-1] / total[-1]
        m = model.models[int(h.argmin())]
        if h.min() <= m.mean + model.tolerance + 4 * m.spread / total[-1] ** 0.5:
            kept.add(i)
    assert kept == set(steps[1].index)


def test_near_duplicate_stage(steps):
    before = steps[1]
    of = components([shingles(t, 5) for t in before.text], list(before.index), 80)
    assert set(steps[2].index) == {i for i, root in of.items() if i == root}


def test_decontamination_stage(sf_dir, steps):
    """Documents with a whole item's words in a row go, documents that share no eight words with any item stay."""

    def words(t):
        return re.findall(r"[^\W_]+", t.lower())

    items = [words(t) for t in pd.read_parquet(f"{sf_dir}/benchmark.parquet").text]
    windows = {tuple(w[k : k + 8]) for w in items for k in range(max(1, len(w) - 7))}
    for i, text in steps[2].text.items():
        w = words(text)
        flat = f" {' '.join(w)} "
        if any(f" {' '.join(item)} " in flat for item in items):
            assert i not in steps[3].index
        elif not any(tuple(w[k : k + n]) in windows for n in range(1, 9) for k in range(len(w) - n + 1)):
            assert i in steps[3].index


def test_secret_stage(steps):
    """Base matches, overlapping ones together, are replaced; where there are none the text stays."""
    for i, text in steps[3].text.items():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text) if ok(m))
        out, at = "", 0
        for a, k, b in spans:
            if a >= at:
                out += text[at:a] + f"[{PATTERNS[k][0]}]"
            at = max(at, b)
        want = out + text[at:]
        got = steps[4].loc[i]
        assert got.n_chars == len(got.text) and (got.text == want or "[random]" in got.text)


def test_mixing_stage(steps):
    """Texts are those of the stage before; what a source gives comes near its target; other documents gave nothing."""
    before, mixed = steps[4], steps[5]
    assert (mixed.taken > 0).all() and mixed.index.is_unique and (mixed.text == before.text.loc[mixed.index]).all()
    size = before.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert (mixed["size"] == size.loc[mixed.index]).all() and (mixed.taken <= 2 * mixed["size"]).all()
    by = mixed.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (by.taken - by.target).abs().max() < 1


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_awkward_tables(spark, odd, kind):  # noqa: F811
    docs = spark.read.parquet(f"{odd[kind]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, odd[kind])
        if name != "mixing":
            assert got.columns == docs.columns
        assert got.count() <= docs.count()


NAMES = ["a.b", "__rejected", "__lang_pred", "_rejected", "__id", "__hash", "id", "hash", "rows", "__found", "found", "row", "uid", "is", "new", "text_hash", "component_id", "size", "rank", "a`b", "spans", "lang_pred"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_columns_of_any_name(spark, sf_dir, name, stage):
    """A stage passes every other column on, whatever its name, with the values of its row."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES])
    got = stage(spark, wide, sf_dir)
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in NAMES)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stage(spark, docs, sf_dir).collect())


def test_mix_and_judge_take_columns_of_any_name(spark, sf_dir):
    from pyspark.sql import functions as F

    from vellumetry.llm.mixing import mix
    from vellumetry.llm.url_filter import judge

    odd = [n for n in NAMES if n not in ("size", "rank")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in odd])
    assert all(r[n] == f"{n}:{r['doc_id']}" for r in mix(docs, keep=tuple(odd)).collect() for n in odd)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("*", *[F.concat(F.lit(f"{n}:"), F.col("page_id").cast("string")).alias(n) for n in odd])
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    assert all(r[n] == f"{n}:{r['page_id']}" for r in judge(pages, rules).collect() for n in odd)
