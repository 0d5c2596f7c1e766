"""The ten operators against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import corpus_pipeline
from pyspark.sql import functions as F

from tests.same import from_duckdb, rows
from vellumetry.llm import queries as Q
from vellumetry.llm.oracles import ORACLES

LONG = "word " * 40_000
EXTRA = ["host string", "path string", "rule string", "score double", "row string", "key string", "bits string", "base string", "spans string", "uid long", "size long", "taken long", "sid long"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(EXTRA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Folders with awkward tables, nulls in every column among them, and with empty ones."""
    texts = [None, "", "   ", "one", "two words", "ae\u0301 \u00dfx \U0001f600", LONG, "same text of six words here", "same text of six words here", "password=hunter22 " + "AKIA" + "Q" * 16, "mail bob@x.example or +1 555 000 1111 then bob@x.example"]
    docs = [(i, t, ["en", None][i % 2], ["a", None, "b"][i % 3], None) for i, t in enumerate(texts)]
    docs += [(None, "no id at all", None, None, 3), (7, texts[7], "en", "b", 4), (7, "another text of the same id", "en", "b", 4)]
    docs = [(*d, *["x", "y", "z", 0.5, "r", "k", "b", "c", "s", 1, 2, 3, 4]) for d in docs]
    pages = [(1, "http://A.Example.org/es/x?q", "p" * 1500), (2, "no scheme", "p" * 1500), (3, None, None), (None, "https://com/fr/\n", "p" * 1500), (4, "x://fr.com/de/", "short"), (4, "x://fr.com/de/", "short"), (5, "http://org", "short")]
    out = {}
    for name, d, p, b in (("odd", docs, pages, [(1, None), (2, ""), (3, "two words"), (None, "x")]), ("empty", [], [], [])):
        folder = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(d, DOCS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(p, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
        spark.createDataFrame(b, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out[name] = folder
    return out


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_odd_and_empty_tables(spark, odd, name):
    assert Q.queries()[name](spark, odd["empty"]).count() == 0
    got = Q.queries()[name](spark, odd["odd"]).toPandas()
    n = {"op1_license_scan": 0, "op6_benchmark_decontamination": None, "op5_warc_normaliser": 7, "op7_url_filters": 7}.get(name, 14)
    assert n is None or len(got) == n


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, sf_dir, name):
    assert rows(Q.queries()[name](spark, sf_dir).toPandas()) == rows(from_duckdb(ORACLES[name], sf_dir))


def test_media_round_trip(spark, sf_dir, docs):
    got = Q.op2_media_columns(spark, sf_dir).toPandas().set_index("doc_id")
    assert got["error"].isna().all() and len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        data = text.encode()
        data += b" " * (-len(data) % 192 if data else 192)
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))


def test_a_broken_member_is_a_row_with_an_error(spark, tmp_path):
    from vellumetry.llm import media

    folder = str(tmp_path / "a")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    name = media.write_archives(texts, folder).first().archive
    index = np.fromfile(name[:-4] + ".idx", dtype="<i8").reshape(-1, 4)
    with open(name, "r+b") as f:
        f.seek(int(index[7, 0]))
        f.write(b"\xff" * 512)
    got = media.features(media.read_archives(spark, folder, range_bytes="1000")).toPandas()
    assert len(got) == 20 and got.error.notna().sum() == 1 and set(got.doc_id.dropna()) == set(range(20)) - {7}


def test_members_are_read_again_alone(spark, tmp_path, monkeypatch):
    """A read that fails, and one that brings damaged bytes, are made again by the member's own offset."""
    from vellumetry.llm import archives, media

    folder = str(tmp_path / "a")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    manifest = media.write_archives(texts, folder)
    (tmp_path / "a" / "media-999999-0000.tar").write_bytes(b"of an attempt that failed")
    asked, real = [], archives.opened

    class Flaky:
        def __init__(self, file):
            self.file, self.at = file, 0

        def seek(self, at):
            self.at = at
            self.file.seek(at)

        def read(self, n):
            asked.append(self.at)
            data = self.file.read(n)
            if len(asked) % 3 == 0:
                raise OSError("lost")
            return data[:-1] + b"?" if len(asked) % 5 == 0 else data

        def __getattr__(self, name):
            return getattr(self.file, name)

    class Store:
        def __init__(self, store):
            self.store = store

        def open_input_file(self, path):
            return Flaky(self.store.open_input_file(path)) if path.endswith(".tar") else self.store.open_input_file(path)

        def __getattr__(self, name):
            return getattr(self.store, name)

    monkeypatch.setattr(archives, "opened", lambda uri: (lambda s, p: (Store(s), p))(*real(uri)))
    reader = media.MediaReader({"path": folder, "manifest": manifest._written, "tries": 3})
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert len(rows) == 20 and all(r["error"] is None for r in rows) and len(asked) > 20
    assert max(asked.count(a) for a in asked) > 1 and min(asked.count(a) for a in asked) == 1


def components(sets, ids, percent):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    groups: dict[int, list] = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_jaccard_is_brute_force(spark, sf_dir, docs):
    got = Q.op3_ngram_jaccard_join(spark, sf_dir).toPandas().set_index("doc_id")
    sets = [shingles(t, 4) for t in docs.text]
    assert components(sets, list(docs.doc_id), 85) == got.component_id.to_dict()
    assert [len(s) for s in sets] == got.n_shingles.loc[docs.doc_id].tolist()


def test_jaccard_on_a_large_group_with_a_shared_passage(spark):
    from vellumetry.llm.jaccard import jaccard_components

    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(12))
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, 60))] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(w))
    texts += [f"a{i} b{i} c{i} {passage}" for i in range(60)] + [f"a{i} {passage} {passage}" for i in range(40)]
    ids = list(range(len(texts)))
    got = jaccard_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), 4, 85).toPandas()
    assert components([shingles(t, 4) for t in texts], ids, 85) == dict(zip(got.doc_id, got.component_id))


def test_jaccard_candidates_of_many_near_copies(spark):
    """2,000 near copies meet their pivot, not each other, and the components are whole."""
    from vellumetry.llm import jaccard

    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(2000):
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 3))):
            w[at] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{i}_{j}" for j in range(50)) for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, real = [], jaccard.overlaps

    def counted(pairs, *more):
        asked.append(pairs.count())
        return real(pairs, *more)

    jaccard.overlaps = counted
    try:
        got = jaccard.jaccard_components(docs, 4, 85).toPandas().set_index("doc_id").component_id
    finally:
        jaccard.overlaps = real
    assert sum(asked) <= 2 * 2000
    assert (got.loc[:1999] == 0).all() and all(got.loc[i] == i for i in range(2000, 2100))


def test_jaccard_links_between_members_only(spark):
    """Groups whose pivots are too far apart to link, but some of whose members link."""
    from vellumetry.llm.jaccard import jaccard_components

    rng = np.random.default_rng(6)
    texts = []
    for g in range(12):
        w = [f"g{g}w{i}" for i in range(150)]
        chain = []
        for step in range(9):
            chain += [" ".join(w)] * (5 if step in (0, 8) else 1)
            for at in rng.integers(0, 150, 2):
                w[at] = f"n{rng.integers(0, 10**9)}"
        texts += chain
    ids = list(range(len(texts)))
    for percent in (80, 85, 90):
        got = jaccard_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), 4, percent).toPandas()
        assert components([shingles(t, 4) for t in texts], ids, percent) == dict(zip(got.doc_id, got.component_id))


def test_long_lists_meet_in_parts(spark, monkeypatch):
    """Documents that are mostly one passage: its lists are cut, and no link is lost."""
    from vellumetry.llm import jaccard

    monkeypatch.setattr(jaccard, "HOT", 7)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} {' '.join(f'q{i}_{j}' for j in range(i % 9))}" for i in range(60)]
    ids = list(range(len(texts)))
    got = jaccard.jaccard_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), 4, 85).toPandas()
    assert components([shingles(t, 4) for t in texts], ids, 85) == dict(zip(got.doc_id, got.component_id))


def test_results_own_their_tables(spark, odd):
    """Two lazy results outlive the pipeline's stages and other operators."""
    from tests.same import rows as plain

    first, second = Q.op8_source_mixing(spark, odd["odd"]), Q.op9_secret_scan(spark, odd["odd"])
    before = [plain(first.toPandas()), plain(second.toPandas())]
    Q.op3_ngram_jaccard_join(spark, odd["odd"]).count()
    corpus_pipeline.run(spark, odd["odd"]).count()
    assert [plain(first.toPandas()), plain(second.toPandas())] == before


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from vellumetry.llm.common import shared_folder

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_folder(session)


def test_language_on_held_out_rows(spark, sf_dir, docs):
    got = Q.op4_language_id(spark, sf_dir).toPandas().set_index("doc_id").join(docs.set_index("doc_id").lang)
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()
    assert got.held_out.sum() == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in docs.doc_id)
    assert got.rejected.mean() <= 0.01


def test_language_rejects_what_it_never_saw(spark, sf_dir):
    from vellumetry.llm.language import accepted, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    noise = spark.createDataFrame([(1, "xqzv kjqx wvqz zzxq qjxk vvwq " * 8), (2, "\u4f60\u597d\u4e16\u754c " * 30), (3, None)], "doc_id long, text string")
    assert accepted(noise, train(docs)).count() == 0


def test_character_model_sums_to_one():
    from vellumetry.llm.language import ORDER, CharModel, Identifier

    words = ["abab", "abba", "baab", "aab"] * 5
    grams: dict[str, int] = {}
    for w in words:
        m = f" {w} "
        for n in range(1, ORDER + 1):
            for i in range(1 if n == 1 else 0, len(m) - n + 1):
                grams[m[i : i + n]] = grams.get(m[i : i + n], 0) + 1
    model = Identifier(["x"], [CharModel.fit(list(grams), np.array(list(grams.values())))], 1.0)

    def p(word):
        return np.exp(-model.score_words([word])[0, 0])

    assert all(0 < p(c) < 1 for c in "ab")
    # All words of up to six letters hold most of the mass and no more than all of it.
    words, total = ["a", "b"], 0.0
    for _ in range(6):
        total += sum(p(w) for w in words)
        words = [w + c for w in words for c in "ab"]
    assert 0.5 < total <= 1.001


def test_character_model_is_brute_force():
    """Interpolated Kneser-Ney from raw counts, by dictionaries and recursion."""
    from vellumetry.llm.language import ORDER, CharModel, Identifier

    words = "the then there other another mother father bother ether breath thee a an and hand land".split() * 2 + ["the"] * 5
    raw: dict[str, int] = {}
    for w in words:
        m = f" {w} "
        for n in range(1, ORDER + 1):
            for i in range(1 if n == 1 else 0, len(m) - n + 1):
                raw[m[i : i + n]] = raw.get(m[i : i + n], 0) + 1

    def count(g):
        if len(g) == ORDER or g[0] == " ":
            return raw[g]
        return len([x for x in raw if x[1:] == g]) or 1

    tables = [{g: count(g) for g in raw if len(g) == n} for n in range(1, ORDER + 1)]

    def p(symbol, history):
        table = tables[len(history)]
        ones, twos = (sum(c == k for c in table.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.75
        after = {g: c for g, c in table.items() if g[:-1] == history}
        lower = p(symbol, history[1:]) if history else d * len(after) / sum(after.values()) / 1000
        if not after:
            return lower
        left = 1 if not history else d * len(after) / sum(after.values())
        return max(after.get(history + symbol, 0) - d, 0) / sum(after.values()) + left * lower

    model = Identifier(["x"], [CharModel.fit(list(raw), np.array(list(raw.values())))], 1.0)
    for w in ["the", "other", "zebra", "handle", "a", "theology"]:
        m = f" {w} "
        want = -sum(math.log(p(m[i], m[max(0, i - ORDER + 1) : i])) for i in range(1, len(m)))
        assert model.score_words([w])[0, 0] == pytest.approx(want, rel=1e-4), w


def test_language_of_texts_without_letters(spark, sf_dir):
    from vellumetry.llm.language import identify, train

    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = ["\u00bd \u00b2 \u2460", "12 34", "", None, "\u2164", "\u00e9"]
    got = identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]).toPandas().set_index("doc_id")
    assert list(got.lang_pred.loc[[0, 1, 2, 3, 4]]) == ["und"] * 5 and got.lang_pred.loc[5] != "und"


def test_rejection_is_calibrated_on_texts_set_aside(spark, sf_dir, docs):
    """Of texts that the model never saw, few are rejected."""
    from vellumetry.llm.language import held_out, identify, train

    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(every.where(~held_out(F.col("doc_id"))))
    got = identify(every.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull()), model, ["doc_id"])
    assert got.agg(F.avg(F.col("rejected").cast("double"))).first()[0] <= 0.02


def test_warc_members_stand_alone(spark, odd):
    from vellumetry.llm import warc

    got = Q.op5_warc_normaliser(spark, odd["odd"]).toPandas()
    big = got[got.payload_bytes == 1500]
    assert sorted(big.record_type) == ["response", "revisit", "revisit"] and set(big.refers_to.dropna()) == {2} and got.intact.all()
    data = warc.record(5, "http://x/\r\n", "h" * 10, "d", None)
    assert list(warc.records_of(iter([data[:5], data[5:50], data[50:] + data]))) == [data, data]
    with pytest.raises(ValueError):
        list(warc.records_of(iter([data + b"rest"])))


def test_warc_sidecar_finds_each_record(spark, sf_dir, tmp_path):
    """Each line of a sidecar is the place of one gzip member, and the members are the whole file."""
    import zlib as z

    from vellumetry.llm import warc

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").coalesce(2)
    made = warc.normalise(warc.write_streams(warc.plan(pages), str(tmp_path / "whole")), str(tmp_path / "split"))
    index = warc.read_index(made).toPandas()
    assert len(index) == pages.count() == sum(r.records for r in made.collect())
    for name, own in index.groupby("archive"):
        data, upto = Path(name.removeprefix("file:")).read_bytes(), 0
        for r in own.sort_values("offset").itertuples():
            record = z.decompress(data[r.offset : r.offset + r.length], 31)
            assert r.offset == upto and record.startswith(b"WARC/1.1") and r.id.encode() in record
            upto += r.length
        assert upto == len(data)


def test_decontamination_finds_items_and_changed_slots(spark, sf_dir, docs):
    from vellumetry.llm.decontaminate import find

    got = Q.op6_benchmark_decontamination(spark, sf_dir).toPandas()
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    want = {(d, i) for d, t in zip(docs.doc_id, map(plain, docs.text)) for i, b in zip(items.item_id, map(plain, items.text)) if b in t}
    assert set(zip(got.doc_id, got.item_id)) == want

    item = spark.createDataFrame([(1, "A train that carries Alice leaves at 9 and needs 9 hours to reach the city where Alice lives with her family")], "item_id long, text string")
    texts = [
        "A train that carries Bob leaves at 7 and needs 7 hours to reach the city where Bob lives with her family",
        "A train that carries Bob leaves at 7 and needs 8 hours to reach the city where Carl lives with her family",
        "A ship that carries coal leaves at 9 and needs 9 hours to reach the port",
        "Before. A train that carries Alice leaves at 9 and needs 9 hours to reach the city where Alice lives with her family",
    ]
    got = find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), item).toPandas().set_index("doc_id")
    assert set(got.index) == {0, 3} and got.reparameterised.loc[0] and not got.reparameterised.loc[3]


PATTERNS = [
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def test_secret_base_spans_are_brute_force(spark, sf_dir, docs):
    from vellumetry.llm.secrets import digest, redact

    more = ["Password : 'abc12' token=abcdef api-key=zzzzzzzz", "\U0001f600 secret=" + "a" * 40, "API_KEY:" + "f" * 30 + " passwdpasswd=123456", "AKIAAKIA" + "B" * 14, "key 9fQ2xL7vB1nR8tY3kW6pZ4mC5dH0sJqE and the"]
    extra = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(more)), "text": more})
    every = pd.concat([docs[["doc_id", "text"]], extra], ignore_index=True)
    got = digest(spark.createDataFrame(every)).toPandas().set_index("doc_id")
    for i, text in zip(every.doc_id, every.text):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text) if ok(m))
        base = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
        r = got.loc[i]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), text[-80:]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    assert "random:4:36" in got.loc[10**6 + 4].spans
    clean = {r.doc_id: r.text for r in redact(spark.createDataFrame(extra)).collect()}
    assert clean[10**6 + 1] == "\U0001f600 [assign]" and clean[10**6 + 4] == "key [random] and the"


ALPHABETS = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def battery_p(token, encoding):
    """The combined p-value, by Python's own error function and loops."""
    alphabet = ALPHABETS[encoding]
    v = [alphabet.index(c if encoding in ("base32", "base64") else c.upper() if encoding == "hex" else c.lower()) for c in token]
    n, size = len(v), len(alphabet)

    def tail(z):
        return math.erfc(z / math.sqrt(2)) / 2

    chi = sum((v.count(k) - n / size) ** 2 / (n / size) for k in range(size))
    df = size - 1
    uniform = tail(((max(chi, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    up = [x >= size / 2 for x in v]
    runs = 1 + sum(x != y for x, y in zip(up, up[1:]))
    expected = 1 + 2 * sum(up) * (n - sum(up)) / n
    run = 2 * tail(abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-3)))
    mean, var = (size - 1) / 2, (size * size - 1) / 12
    serial = 2 * tail(abs(sum((x - mean) * (y - mean) for x, y in zip(v, v[1:])) / (var * math.sqrt(n - 1))))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, run, serial))
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def test_battery_is_brute_force(spark):
    from vellumetry.llm.secrets import battery

    rng = np.random.default_rng(5)
    random = ["".join(rng.choice(list(a), 40)) for a in ALPHABETS.values() for _ in range(50)]
    patterned = ["abcabcabc1" * 5, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"]
    got = battery(spark.createDataFrame([(t,) for t in random + patterned], "token string")).toPandas().set_index("token")
    for t in random + patterned:
        assert got.p.loc[t] == pytest.approx(battery_p(t, got.encoding.loc[t]), rel=1e-3, abs=1e-6)
    assert (got.p.loc[random] < 0.01).mean() < 0.06 and (got.p.loc[patterned] < 1e-6).all()


def test_tokens_are_cut_into_symbols_once(spark):
    """What a token costs is counted in passes over its symbols; sums of long tokens, made in blocks, are brute force."""
    from vellumetry.llm import secrets as S

    rng = np.random.default_rng(4)
    pairs = [round(float(x), 6) for x in rng.uniform(-3, 3, 26 * 26)]
    tokens = ["".join(rng.choice(list(a), n)) for a in ALPHABETS.values() for n in (20, 511, 512, 513, 1022, 1023, 1024, 5000)]
    scored = S._scored(spark.createDataFrame([(t,) for t in tokens], "token string"), pairs)
    assert scored._jdf.queryExecution().executedPlan().toString().count("split(token") == 1
    got = scored.toPandas().set_index("token")
    for t in tokens:
        ratios = [S.CHANGE if a.isdigit() or b.isdigit() else pairs[(ord(a.lower()) - 97) * 26 + ord(b.lower()) - 97] for a, b in zip(t, t[1:]) if (a + b).isalnum() and not (a + b).isdigit()]
        b = sum(ratios) / (len(ratios) + S.BLANK)
        assert got.p.loc[t] == pytest.approx(battery_p(t, got.encoding.loc[t]), rel=1e-3, abs=1e-6)
        s = max(-math.log10(max(got.p.loc[t], 1e-300)), S.FLOOR)
        assert got.score.loc[t] == pytest.approx(math.log(s) + S.PAIRS * b, abs=1e-5)


def test_plans_of_the_secret_scan_are_small(spark):
    """The driver keeps what plans print, of every execution: no table of fixed values makes them long."""
    from vellumetry.llm import secrets as S

    pairs = [-1.234567 - k / 1e6 for k in range(26 * 26)]
    scored = S._scored(spark.createDataFrame([("a" * 20,)], "token string"), pairs)
    assert len(scored._jdf.queryExecution().executedPlan().toString()) < 100_000


def planted_secrets(docs, low, high, seed=7):
    """(rows, number planted): the documents, random tokens of each encoding, then glued words."""
    rng = np.random.default_rng(seed)
    words = sorted({w for t in docs.text for w in re.findall("[A-Za-z]{3,}", t)})
    planted = [prefix + "".join(rng.choice(list(a), int(rng.integers(low, high)))) for prefix, a in zip(["sk-", "", "", ""], ALPHABETS.values()) for _ in range(50)]
    glued = ["".join(w.capitalize() if i % 2 and k % 2 else w.lower() for k, w in enumerate(rng.choice(words, 12)))[: int(rng.integers(20, 50))] for i in range(400)]
    texts = [f"the key {t} and more" for t in planted + glued]
    return pd.concat([docs[["doc_id", "text"]], pd.DataFrame({"doc_id": range(10**6, 10**6 + len(texts)), "text": texts})]), len(planted)


@pytest.mark.parametrize("low,high", [(20, 24), (24, 32), (32, 56)])
def test_random_secrets_of_each_encoding(spark, docs, low, high):
    """Planted secrets are found, glued words are not, whatever prefix a secret has."""
    from vellumetry.llm.secrets import digest

    rows, n = planted_secrets(docs, low, high)
    got = digest(spark.createDataFrame(rows)).toPandas().set_index("doc_id").sort_index().spans
    found = got.loc[10**6 : 10**6 + n - 1].str.contains("random")
    assert len(found) == n and all(found.iloc[k : k + 50].mean() >= 0.9 for k in range(0, n, 50))
    assert got.loc[10**6 + n :].str.contains("random").mean() <= 0.02


def test_spans_selected_are_brute_force(spark, docs):
    """Which tokens are tested, which are reported, and which of a run and its pieces is the span."""
    from vellumetry.llm import secrets as S

    rng = np.random.default_rng(11)
    rows, _ = planted_secrets(docs, 20, 40, seed=3)
    body = ["".join(rng.choice(list(ALPHABETS["base64"]), 30)).replace("+", "x").replace("/", "y") for _ in range(6)]
    more = [f"{body[0]}-{body[1]} {body[0]}", f"a_{body[2]}/{body[3]}", f"token={body[4]} {body[4]}-notsorandomwordsatall", "1" * 40, f"\U0001f600{body[5]}\U0001f600"]
    rows = pd.concat([rows, pd.DataFrame({"doc_id": range(2 * 10**6, 2 * 10**6 + len(more)), "text": more})])
    table = spark.createDataFrame(rows)
    got = {r.doc_id: r.spans for r in S.digest(table).collect()}
    want, tested = {}, {}
    for i, text in zip(rows.doc_id, rows.text):
        base = [tuple(map(int, x.split(":")[1:])) for x in (got[i].split(",") if got[i] else []) if not x.startswith("random")]
        spans = {m.span() for p in (S.TOKEN, S.PIECE) for m in re.finditer(p, text or "")}
        kept = []
        for start, end in spans:
            own = text[start:end]
            plain = own.translate(str.maketrans("", "", "-_"))
            token = plain if re.fullmatch("[0-9a-fA-F]{20,}", plain) else own
            if not re.fullmatch("[0-9+/_-]*", token) and not any(a < end and start < b for a, b in base):
                kept.append((start, end, token))
        tested[i] = kept
    tokens = sorted({t for kept in tested.values() for _, _, t in kept})
    runs = S.glued_runs(table).cache()
    pairs = S.letter_pairs(runs)
    scored = {r.token: (r["class"], r.bin) for r in S.p_ordinary(spark.createDataFrame([(t,) for t in tokens], "token string"), S.ordinary(runs, pairs), pairs).collect()}
    cut = {}
    for c in {c for c, _ in scored.values()}:
        bins = [b for k, b in scored.values() if k == c]
        fit = [b for b in set(bins) if 10 ** (-b / 10) <= S.RATE * sum(x >= b for x in bins) / len(bins)]
        cut[c] = min(fit) if fit else 10**9
    for i, kept in tested.items():
        hit = {(a, b) for a, b, t in kept if scored[t][1] >= cut[scored[t][0]]}
        want[i] = sorted((a, b) for a, b in hit if not any(c <= a and b <= d and (c, d) != (a, b) for c, d in hit))
    assert {i: [tuple(map(int, x.split(":")[1:])) for x in s.split(",") if x.startswith("random")] for i, s in got.items()} == want
    assert sum(map(len, want.values())) > 190


def test_null_covers_every_letter_of_every_text(spark, docs):
    """Each two neighbouring letters of each distinct text are in one run, and the null is of all runs."""
    from vellumetry.llm import secrets as S

    # Texts at the edges of blocks and classes, signs that lower case would make letters of, copies, and a long text.
    sizes = [1, 2, 19, 20, 21, 38, 39, 40, S.BLOCK - 1, S.BLOCK, S.BLOCK + 1, S.BLOCK + 18, S.BLOCK + 19, S.BLOCK + 20, 2 * S.BLOCK + 19]
    rng = np.random.default_rng(2)
    more = ["".join(rng.choice(list("abcdefgh"), n)) for n in sizes] + ["a\u0130b \u212aelvin", "one two-three\n4 five " * 3, "one two-three\n4 five " * 3, None, "", "12 34", LONG]
    texts = [*docs.text, *more]
    glued = sorted({g for t in texts if t and (g := re.sub("[^A-Za-z]", "", t).lower())})
    runs = [r.token for r in S.glued_runs(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    want, got = {}, {}
    for seen, counts in ((glued, want), (runs, got)):
        for x in seen:
            for p in zip(x.lower(), x.lower()[1:]):
                counts[p] = counts.get(p, 0) + 1
    assert got == want
    # Only a whole text is shorter than a token.
    assert sorted(r.lower() for r in runs if len(r) < S.LEAST) == [g for g in glued if len(g) < S.LEAST]
    table = spark.createDataFrame([(r,) for r in runs], "token string")
    pairs = S.letter_pairs(table)
    scored = S._scored(table.where(f"length(token) >= {S.LEAST}"), pairs).toPandas()
    null = {(r["class"], r.mixed): r for r in S.ordinary(table, pairs).collect()}
    assert set(null) == {(k + 1, mixed) for k in range(len(S.ORDINARY)) for mixed in (False, True)}
    for (k, mixed), r in null.items():
        x = scored.score[(scored["class"] == k) & (scored.mixed == mixed)].to_numpy()
        _, m, sd = S.ORDINARY[k - 1]
        x, w = np.append(x, [m - sd, m + sd]), np.append(np.ones(len(x)), [S.PRIOR / 2] * 2)
        assert len(x) > 100 and r["mean"] == pytest.approx(np.average(x, weights=w))
        assert r.spread == pytest.approx(math.sqrt(max(np.average((x - r["mean"]) ** 2, weights=w), 0.01)))


def test_letter_pairs_are_brute_force(spark):
    from vellumetry.llm import secrets as S

    runs = ["abcabx", "ABBA", "zz"]
    got = S.letter_pairs(spark.createDataFrame([(r,) for r in runs], "token string"))
    counts = {}
    for r in runs:
        for p in zip(r.lower(), r.lower()[1:]):
            counts[p] = counts.get(p, 0) + 1
    letters = "abcdefghijklmnopqrstuvwxyz"
    want = {(a, b): math.log((26 * counts.get((a, b), 0) + S.SMOOTH) / (sum(n for (x, _), n in counts.items() if x == a) + S.SMOOTH)) for a in letters for b in letters}
    assert got == pytest.approx(list(want.values()))
    tokens = ["abab12ab", "1a1a1", "z", "a-b"]
    scores = []
    for t in tokens:
        seen = [want[p] if p in want else S.CHANGE for p in zip(t, t[1:]) if all(c.isalnum() for c in p) and any(c.isalpha() for c in p)]
        scores.append(sum(seen) / (len(seen) + S.BLANK))
    rows = spark.createDataFrame(list(enumerate(tokens)), "i int, token string").select("i", S.pair_score(F.col("token"), got).alias("b")).orderBy("i").collect()
    assert [r.b for r in rows] == pytest.approx(scores, abs=1e-5)


def test_false_discovery_limits_are_brute_force(spark):
    from vellumetry.llm.secrets import RATE, limits

    rng = np.random.default_rng(9)
    rows = [(c, int(b)) for c in (1, 2, 3) for b in np.concatenate([rng.exponential(3, 200), rng.uniform(10, 60, 20 * (c - 1))])]
    got = {r["class"]: r["cut"] for r in limits(spark.createDataFrame(rows, "class int, bin int")).collect()}
    for c in (1, 2, 3):
        bins = [b for k, b in rows if k == c]
        fit = [b for b in set(bins) if 10 ** (-b / 10) <= RATE * sum(x >= b for x in bins) / len(bins)]
        assert got.get(c) == (min(fit) if fit else None)


def test_a_text_with_very_many_matches(spark):
    from vellumetry.llm.secrets import digest, redact

    text = "\U0001f600 token=abcdefgh " * 20_000
    docs = spark.createDataFrame([(1, text, "b", "s")], "doc_id long, text string, base string, spans string")
    got = digest(docs).first()
    want = ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer("token=[a-z]+", text))
    assert got.n_assign == 20_000 and got.spans == want
    clean = redact(docs).first()
    assert clean.text == "\U0001f600 [assign] " * 20_000 and (clean.base, clean.spans) == ("b", "s")


def test_pii_base_spans_are_brute_force(spark, sf_dir, docs):
    from vellumetry.llm.pii import fit, scan

    more = ["@a.b@c.d x@y.z.@q", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1111-", "+1 (555) 000-1111 + +12 3456789.", "a" * 5000 + "@", "1" * 5000]
    extra = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(more)), "text": more})
    every = spark.createDataFrame(pd.concat([docs[["doc_id", "text"]], extra], ignore_index=True))
    got = scan(every, fit(every)).toPandas().set_index("doc_id")

    def luhn(s):
        return sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(s[::-1])) % 10 == 0

    for r in every.toPandas().itertuples():
        t = r.text
        want = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        want += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        text = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in want)
        assert got.base_sha256.loc[r.doc_id] == hashlib.sha256(text.encode()).hexdigest(), t[-80:]


def test_skip_edges_carry_labels_across_a_document():
    from vellumetry.llm.pii import FEATURES, Field, find, graph, nodes_of

    text = "write to maria.k9@site.example today\n" + "filler words " * 30 + "\nmaria.k9 answered"
    nodes = nodes_of(text, [(0, 9, 30)])
    assert [n[2] for n in nodes] == [1, -1]
    _, edges, kinds = graph(nodes, 0, text)
    assert edges == [(0, 1)] and kinds == [1]
    skip = np.full((5, 5), -3.0) + 6 * np.eye(5)
    base, every = find(Field(np.zeros((FEATURES, 5)), np.zeros((5, 5)), skip), [text])
    assert base[0] == [(0, 9, 30)] and (0, text.rindex("maria"), text.rindex(" answered")) in every[0]


def test_added_spans_on_planted_repeats(spark):
    """Precision and recall of the fitted field: mentions of an address's name, and numbers without their plus."""
    from vellumetry.llm.pii import find, fit

    every = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = fit(every)
    rng = np.random.default_rng(1)
    fill = "then some more words came and went by " * 4
    texts, want = [], []
    for _ in range(60):
        name, number = f"{rng.choice(['maria', 'tom', 'lee'])}{rng.integers(10, 99)}.{rng.choice(['ab', 'xy'])}", str(rng.integers(10**6, 10**7))
        t = f"Write to {name}@site.example today. {fill} Later {name} answered. {fill} Call +1 555 {number} now. {fill} or dial 555 {number} instead, 12 times in 2024."
        texts.append(t)
        a, b = t.index(f"Later {name}") + 6, t.index("dial 555") + 9
        want.append({(0, a, a + len(name)), (3, b, b + len(number))})
    base, found = find(field, texts)
    added = [set(f) - set(b) for f, b in zip(found, base)]
    hit = sum(any(k == kind and s < end and start < e for k, s, e in got) for w, got in zip(want, added) for kind, start, end in w)
    right = sum(any(k == kind and s < end and start < e for kind, start, end in w) for w, got in zip(want, added) for k, s, e in got)
    assert hit >= 0.9 * 120 and right >= 0.9 * sum(map(len, added))
    plain = [r.text or "" for r in every.select("text").collect()]
    base, found = find(field, plain)
    assert sum(len(set(f) - set(b)) for f, b in zip(found, base)) <= 5


def test_neighbouring_added_tokens_are_one_span():
    from vellumetry.llm.pii import joined, nodes_of

    text = "call 12 3456 78901234 or 99 then 12 5"
    assert joined(text, [(3, 33, 37)], [(3, 5, 7), (3, 8, 12), (3, 13, 21), (3, 25, 27), (3, 33, 37)]) == [(3, 5, 21), (3, 25, 27), (3, 33, 37)]
    spans = [(1, 0, 1), (1, 2, 3), (1, 4, 5), (1, 6, 7), (1, 8, 9), (2, 0, 40)]
    assert [n[2] for n in nodes_of("1 2 3 4 5 then 7 and the 9 that is beyond 8 it", spans)][-2:] == [3, -1]


def test_loopy_messages_are_exact_on_a_tree():
    from itertools import product

    from vellumetry.llm.pii import FEATURES, Field

    rng = np.random.default_rng(1)
    f = Field(rng.normal(size=(FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)), rounds=80)
    x, edges, kinds = rng.normal(size=(4, FEATURES)), np.array([(0, 1), (1, 2), (1, 3)]), np.array([0, 1, 0])
    u, want = x @ f.node, np.zeros((4, 5))
    for ys in product(range(5), repeat=4):
        s = np.exp(sum(u[i, y] for i, y in enumerate(ys)) + sum((f.skip if k else f.chain)[ys[a], ys[b]] for (a, b), k in zip(edges, kinds)))
        for i, y in enumerate(ys):
            want[i, y] += s
    got = f.marginals(x, np.full(4, -1), edges, kinds)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_url_rules_of_many_hosts(spark, monkeypatch):
    """Nested hosts and paths, 10,000 rules on one host, small blocks; other columns have the method's names."""
    from vellumetry.llm import url_filter

    monkeypatch.setattr(url_filter, "BLOCK", 200)
    rng = np.random.default_rng(2)
    hosts = [".".join(rng.choice(list("abc"), int(n))) for n in rng.integers(1, 5, 60)]
    rules = {(h, p) for h in hosts[:25] for p in rng.choice(["/", "/x", "/x/y", ""], 2)}
    rules |= {("big.org", "/" + "/".join(rng.choice(list("pqrstu"), int(n)))) for n in rng.integers(2, 9, 10_000)}
    rules = [(h, p, "block" if len(h + p) % 2 else "allow") for h, p in sorted(rules)]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/x/y?q', '/z#x'])}" for _ in range(200)]
    urls += [f"http://{rng.choice(['', 'www.', 'a.b.'])}big.org/{'/'.join(rng.choice(list('pqrstu'), int(rng.integers(1, 12))))}" for _ in range(200)]
    pages = [(i, u, "host", "key", "stack", 1, 2) for i, u in enumerate(urls)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, host string, key string, stack string, range int, uid int"), spark.createDataFrame(rules, "host string, path string, verdict string")).toPandas().set_index("page_id")
    assert set(got.columns) >= {"key", "stack", "range", "uid"} and len(got) == len(urls)
    by_host = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append((p, v))
    for i in range(len(urls)):
        host, path = got.host.loc[i], got.path.loc[i]
        labels = host.split(".")
        fit = [(len(h + p), h + p, v) for k in range(len(labels)) for h in [".".join(labels[k:])] for p, v in by_host.get(h, []) if path.startswith(p)]
        assert (got.rule.loc[i], got.verdict.loc[i]) == (max(fit)[1:] if fit else (None, "allow")), urls[i]


def test_url_rules_are_swept_without_a_global_window(spark, sf_dir, monkeypatch):
    """The plans of all tables the operator writes: one window a range, and over the ranges' last stacks alone one for all."""
    from vellumetry.llm import common

    plans, write = [], common.Scratch.write

    def kept(self, df):
        plans.append(df._jdf.queryExecution())
        return write(self, df)

    monkeypatch.setattr(common.Scratch, "write", kept)
    Q.op7_url_filters(spark, sf_dir).count()
    windows = []
    for plan in plans:
        text = plan.toString()
        assert "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text and "Arrow" not in text
        lines = plan.optimizedPlan().toString().splitlines()
        for i, line in enumerate(lines):
            if "Window [" in line:
                spec = line.split("windowspecdefinition(")[1]
                ranged = re.match(r"range#\d+,", spec) is not None
                windows.append(ranged)
                assert ranged or lines[i + 1].lstrip(" :+-").startswith("Aggregate [range#"), line
    assert windows.count(True) >= 2


def test_schedule_is_brute_force_and_even(spark, sf_dir, docs):
    """Slots in order give each source its share at every point, and their words are the documents' own."""
    from vellumetry.llm.mixing import GOLDEN, ONE, golden_point, pieces

    ids = [0, 1, 77, 10**9, 2**40 + 3]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(golden_point(F.col("i"))).collect()]
    assert got == [(i + 1) * GOLDEN % ONE for i in ids]
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = Q.op8_source_mixing(spark, sf_dir).toPandas().set_index("doc_id")
    parts = pieces(every).toPandas()
    texts = docs.set_index("doc_id")
    for r in parts.itertuples():
        assert r.text.split(" ") == re.findall(r"[^\x20\x09-\x0D]+", texts.text.loc[r.doc_id])[r.first_word : r.first_word + r.words]
    assert parts.groupby("doc_id").words.sum().to_dict() == mixed.taken[mixed.taken > 0].to_dict()
    assert parts.groupby("doc_id").slot.min().to_dict() == mixed.first_slot.dropna().to_dict()
    parts["source"] = texts.source.loc[parts.doc_id].to_numpy()
    slots = parts.sort_values("slot").groupby("slot").source.first()
    share = slots.value_counts(normalize=True)
    for source, part in share.items():
        ahead = (slots == source).cumsum() - part * np.arange(1, len(slots) + 1)
        assert ahead.abs().max() <= 3 + len(slots) ** 0.5 / 4


def test_mix_comes_near_its_targets(spark, sf_dir, docs):
    got = Q.op8_source_mixing(spark, sf_dir).toPandas().merge(docs[["doc_id", "source"]], on="doc_id")
    by = got.groupby("source").agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"))
    assert (by.taken - by.target).abs().max() < 1 and (got.taken <= 2 * got["size"]).all() and (by.target <= 2 * by["size"]).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()


def test_licenses_by_wording(spark):
    from vellumetry.llm.licenses import TEMPLATES, rank, scan

    texts = ["Some prose.\nLicensed under CC BY-NC 4.0.\nMore.", "Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "The licence fee for the copyright office was paid by the old man.", TEMPLATES["BSD-3-Clause"], "Licensed under the Apache License, Version 9.7."]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    assert got.license.to_dict() == {0: "CC-BY-NC-4.0", 1: "CC-BY-4.0", 2: "GPL-3.0", 3: "GPL-2.0", 5: "BSD-3-Clause"}
    assert rank("Released under the MIT License.", TEMPLATES)[0][1] == "MIT"


def test_license_scan_is_brute_force(spark):
    """Every whole notice sentence that only one license has is found, and nothing else is."""
    from vellumetry.llm.licenses import TEMPLATES

    def plain(t):
        return f" {' '.join(re.findall('[A-Za-z0-9]+(?:[-.][A-Za-z0-9]+)*', t.lower()))} "

    notices: dict[str, set] = {}
    for name, text in TEMPLATES.items():
        for sentence in map(plain, re.split(r"(?<=[a-z0-9)])[.]\s", text.split("\n\n")[0])):
            if len(sentence.split()) >= 4:
                notices.setdefault(sentence, set()).add(name)
    folder = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    want = {(i, *names) for i, t in zip(docs.doc_id, map(plain, docs.text)) for sentence, names in notices.items() if len(names) == 1 and sentence in t}
    got = Q.op1_license_scan(spark, folder).toPandas()
    assert want and set(zip(got.doc_id, got.license)) == want


def test_apache_header_under_a_copyright_line():
    from vellumetry.llm.licenses import TEMPLATES, Known, licenses_in

    header = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License."
    text = f"Copyright 2020 Acme Inc.\n\n{header}\n"
    (hit,) = licenses_in(text, Known(), TEMPLATES)
    assert hit[0] == "Apache-2.0" and hit[1] == 26 and hit[2] >= len(text) - 3


def test_whole_license_texts_under_dated_copyright_lines(spark):
    from vellumetry.llm.licenses import TEMPLATES, Known, licenses_in

    folder = Path(Q.__file__).parent / "license_texts"
    names = ["MIT", "ISC", "BSD-3-Clause", "Unlicense"]
    whole = {n: (folder / f"{n}.txt").read_text().replace("<year>", "2023").replace("<owner>", "The Apache Software Foundation") for n in names}
    for name, text in whole.items():
        (hit,) = licenses_in(f"Prose about birds.\n{text}", Known(), TEMPLATES)
        assert hit[0] == name and hit[2] - hit[1] >= 0.9 * len(text.strip())
    (hit,) = licenses_in(" ".join(whole["MIT"].split()), Known(), TEMPLATES)
    assert hit[0] == "MIT" and not hit[4]
    gpl = "Copyright (C) 2019 Bob Roe\nThis program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU General Public License for more details."
    assert [h[0] for h in licenses_in(gpl, Known(), TEMPLATES)] == ["GPL-3.0"]
    assert [h[0] for h in licenses_in(gpl.replace("General", "Affero General"), Known(), TEMPLATES)] == ["AGPL-3.0"]
    assert {h[0] for h in licenses_in((folder / "GPL-2.0.txt").read_text(), Known(), TEMPLATES)} == {"GPL-2.0"}
    notice = "This work is licensed under the GNU General Public License, version 3."
    assert licenses_in(notice + "\n" + "The&&& annd*** onndble%%% thea*** ndor*** " * 300, Known(), TEMPLATES)[0][:3] == ("GPL-3.0", 0, 69)
    two = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    assert [h[:3] for h in licenses_in(two, Known(), TEMPLATES)] == [("MIT", 0, 30), ("Apache-2.0", 32, 78)]


@pytest.mark.parametrize("name", ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"])
def test_a_whole_license_is_one_row(name):
    """Sentences without a cue word lie inside the row, as they are the template's wording."""
    from vellumetry.llm.licenses import TEMPLATES, Known, licenses_in

    whole = (Path(Q.__file__).parent / "license_texts" / f"{name}.txt").read_text()
    text = f"Prose about birds.\n\n{whole}\n\nMore prose, about mills and rivers."
    hits = [h for h in licenses_in(text, Known(), TEMPLATES) if h[0] == name]
    longest = max(hits, key=lambda h: h[2] - h[1])
    assert len(hits) == 1 and longest[2] - longest[1] >= 0.9 * len(whole.strip())


def test_notices_apart_stay_apart():
    from vellumetry.llm.licenses import TEMPLATES, Known, licenses_in

    notice = "Released under the MIT License."
    text = f"{notice}\n" + "The old mill grinds barley before noon.\n" * 30 + notice
    assert [(h[0], h[1]) for h in licenses_in(text, Known(), TEMPLATES)] == [("MIT", 0), ("MIT", len(text) - len(notice))]


def test_remembered_blocks_are_bounded(monkeypatch):
    from vellumetry.llm import licenses

    monkeypatch.setattr(licenses, "KNOWN_CHARS", 100)
    known = licenses.Known()
    for i in range(50):
        known.put(f"{i:010d}", [])
        assert sum(map(len, known)) == known.chars <= 100
    known.put("x" * 101, [])
    assert "x" * 101 not in known


def test_license_template_ranked_after_many_variants(monkeypatch):
    from vellumetry.llm import licenses

    block = "Licensed under the Foo License, version 9."
    templates = {f"Foo-{i}": f"Licensed under the Foo License, version {i}." for i in range(1, 10)}
    monkeypatch.setattr(licenses, "rank", lambda b, t: [(0.9 - i / 100, n) for i, n in enumerate(sorted(t))])
    assert [h[0] for h in licenses.identify(block, templates)] == ["Foo-9"]


def test_decontamination_of_slots_passages_and_split_items(spark):
    from vellumetry.llm.decontaminate import find

    long = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100))
    twice = "the old mill grinds 9 sacks of barley before noon while the young miller counts all the 9 sacks twice and sings about the river"
    items = [(1, "What is 12 * 7 + 3?"), (2, long), (3, twice), (4, " ".join(f"y{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)))]
    split = items[3][1].split()
    broken = " ".join([*split[:17], "added", *split[17:30], "more", "words"])
    texts = ["So, What is 12 * 7 + 3?", "before " + " ".join(long.split()[40:70]) + " after", twice.replace("the 9 sacks", "the 8 sacks"), broken, "So, What is 12 * 7 + 4?", " ".join(long.split()[40:55])]
    got = find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).toPandas()
    assert set(zip(got.doc_id, got.item_id)) == {(0, 1), (1, 2), (2, 3), (3, 4)}


def test_reparameterised_questions_are_found(spark, docs):
    """Items with new names, numbers and units in their slots, inconsistent ones, and documents without any."""
    from vellumetry.llm.decontaminate import find

    rng = np.random.default_rng(8)
    names, units, things = "Natalia Bob Maria Ken Alice Omar Ines Tom".split(), "kilograms liters miles hours".split(), "clips apples stamps marbles books coins".split()
    verbs = "sold bought counted carried found packed".split()

    def question(k, name, a, b, unit):
        v = rng_of[k]
        return f"{name} {v[0]} {a} {v[1]} in the {v[2]} market and then {v[3]} {b} {unit} more. If {name} had {a} at first, how many {unit} did the {v[2]} {v[1]} weigh after {name} went home with the {v[4]} basket?"

    rng_of = {k: [verbs[k % 6], things[k % 5], f"town{chr(97 + k // 26)}{chr(97 + k % 26)}", verbs[(k // 6) % 6], f"shade{chr(97 + k % 26)}{chr(97 + k // 26)}"] for k in range(60)}
    items, texts = [], []
    for k in range(60):
        a, b, c, d = rng.choice(90, 4, replace=False) + 5
        n1, n2 = rng.choice(names, 2, replace=False)
        items.append((k, question(k, n1, a, b, units[k % 4])))
        texts.append("Some words before it. " + question(k, n2, c, d, units[(k + 1) % 4]) + " And some after.")
    clean = [t for t in docs.text[:60]]
    got = find(spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).toPandas()
    assert (got.doc_id < 60).all()
    right = got[got.doc_id == got.item_id]
    assert right.doc_id.nunique() >= 0.9 * 60 and right.reparameterised.all()


def template_of(text):
    """Words of a text with their placeholders, by regular expressions and loops."""
    from vellumetry.llm.decontaminate import OPENERS, UNITS

    out, last, end = [], None, 0
    for m in re.finditer(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text):
        w = m[0]
        opens = not out or re.search(r'[.!?:;\n"]', text[end : m.start()])
        if re.search("[0-9]", w):
            kind = "NUM"
        elif last == "NUM" and w.lower() in UNITS.split():
            kind = "UNIT"
        elif re.match("[A-Z\u00c0-\u00de]", w) and not (opens and w.lower() in OPENERS.split()):
            kind = "NAME"
        else:
            kind = None
        out.append((kind or w.lower(), w))
        last, end = kind, m.end()
    return out


def test_placeholders_are_brute_force(docs):
    from vellumetry.llm.decontaminate import _NAME, _NUM, _UNIT, canonical

    texts = ["Natalia sold 48 clips. The 7 kg bag cost 3 dollars; Bob Roe paid", "\u00c9mile ran 5 miles"] + list(docs.text[:40])
    for text in texts:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        template, slot, *_ = canonical(data, np.array([0, len(data)]))
        want = [k for k, _ in template_of(text)]
        got = [{int(_NUM): "NUM", int(_UNIT): "UNIT", int(_NAME): "NAME"}.get(int(h)) for h in template]
        assert [g or w for g, w in zip(got, want)] == want and [bool(x) for x in slot] == [w in ("NUM", "UNIT", "NAME") for w in want]


def test_field_runs_without_base_spans_and_reaches_far_mentions():
    from vellumetry.llm.pii import FEATURES, Field, find

    node = np.zeros((FEATURES, 5))
    node[1, 1] = 6.0
    skip = np.full((5, 5), -3.0) + 6 * np.eye(5)
    _, every = find(Field(node, np.zeros((5, 5)), skip), ["ask admin@intranet today"])
    assert every == [[(0, 4, 18)]]
    text = "write to maria.k9@site.example today\n" + "some words then maria.k9 again\n" * 30
    _, every = find(Field(np.zeros((FEATURES, 5)), np.zeros((5, 5)), skip), [text])
    assert len(every[0]) == 31
