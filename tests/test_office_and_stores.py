"""Packages, compound files, stored index, retention on a stream, file sink and resampling, by hand and by brute force."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumetry.functions import text as T
from vellumetry.operators import compound, raster
from vellumetry.operators import detect as D
from vellumetry.operators import office as W


def zipped(members, kind=zipfile.ZIP_DEFLATED):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", kind) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return held.getvalue()


def files(spark, contents):
    return spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "doc_id long, content binary")


M = W.MAIN


def test_sheets_of_all_kinds_of_xml(spark):
    books = [
        f"<workbook xmlns='{M}'><sheets><sheet name='a &amp; \"b\"' state='hidden'/><sheet name=\"it's &#x20AC;\" type='macro'/><sheet name=''/><sheet/></sheets></workbook>",
        f"<x:workbook xmlns:x='{M}'><x:sheets><x:sheet name='n'/></x:sheets><x:sheets><x:sheet name='second list'/></x:sheets></x:workbook>",
        "<workbook><sheets><sheet name='bare'/></sheets></workbook>",
        f"<workbook xmlns:o='urn:o' xmlns='{M}'><o:sheets><sheet name='foreign'/></o:sheets><deep><sheets><sheet name='deep'/></sheets></deep></workbook>",
        "<!DOCTYPE a [<!ENTITY b 'c'>]><workbook><sheets><sheet name='&b;'/></sheets></workbook>",
        "<workbook><sheets><sheet name='broken'></sheets></workbook>",
        "<?xml version='1.0' encoding='utf-16'?><workbook><sheets><sheet name='wide é'/></sheets></workbook>".encode("utf-16"),
        f"<workbook xmlns:o='{M}'><sheets><sheet name='plain'/></sheets><o:sheets><sheet name='named'/></o:sheets></workbook>",
        "",
    ]
    got = W.sheets(files(spark, [zipped({"xl/workbook.xml": b}) for b in books] + [b"no zip", None])).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.name, r.state, r.type) for r in got] == [(0, 'a & "b"', "hidden", "worksheet"), (0, "it's €", "visible", "macro"), (1, "n", "visible", "worksheet"), (2, "bare", "visible", "worksheet"), (6, "wide é", "visible", "worksheet"), (7, "named", "visible", "worksheet")]


def test_paths(spark):
    import posixpath

    targets = ["a.mht", "./a.mht", "../a.mht", "../../../a", "x/../../y/./z//w", "/abs/../b", "//two", "///three", "..", "a/b/../../../c/", "."]
    rows = spark.createDataFrame(list(enumerate(targets)), "i int, t string").select("i", W.normal_path("/word", F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p for r in rows] == [posixpath.normpath(posixpath.join("/word", t)) for t in targets]


def word(refs, rels, types, members):
    ns = f"xmlns:w='{W.WORD}' xmlns:q='{W.DOCUMENT_RELATIONS}'"
    return zipped({
        W.DOCUMENT: f"<w:document {ns}><w:body>" + "".join(f"<w:tbl><w:altChunk q:id='{r}'/></w:tbl>" for r in refs) + "<altChunk id='no'/></w:body></w:document>",
        W.DOCUMENT_RELS: f"<Relationships xmlns='{W.RELATIONS}'>" + "".join(f"<Relationship Id='{i}' Type='{t}' Target=\"{x}\" {more}/>" for i, t, x, more in rels) + "</Relationships>",
        W.CONTENT_TYPES: f"<Types xmlns='{W.TYPES}'>" + "".join(f"<Override PartName='{p}' ContentType='{c}'/>" for p, c in types) + "</Types>",
        **members,
    })


def test_sub_documents_from_bytes(spark):
    chunk = W.ALTCHUNK
    rels = [("a", chunk, "../word/./one.mht", ""), ("b", chunk, "/x/../word/two.htm", ""), ("c", chunk, "three.mht", "TargetMode='EXTERNAL'"), ("d", chunk + "x", "one.mht", ""), ("e", chunk, "", ""), ("f", chunk, "lost.mht", ""), ("g", chunk, "old", ""), ("g", chunk, "one.mht", "")]
    types = [("/word/one.mht", "image/png"), ("/word/one.mht", "message/rfc822"), ("/word/two.htm", "text/html"), ("/word/three.mht", "message/rfc822"), ("/word/lost.mht", "message/rfc822"), ("/word/bomb", "text/html")]
    one = word(["b", "a", "c", "d", "e", "f", "nil", "g"], rels, types, {"word/one.mht": "ONE", "word/two.htm": "TWO"})
    package = files(spark, [one, b"PK no", zipped({W.DOCUMENT: "<a/>"})])
    found = W.altchunks(*W.altchunk_parts(package))
    assert [(r.part_name, r.content_type) for r in found.orderBy("pos").collect()] == [("/word/two.htm", "text/html"), ("/word/one.mht", "message/rfc822"), ("/word/lost.mht", "message/rfc822"), ("/word/one.mht", "message/rfc822")]
    data = W.altchunk_data(package, found).orderBy("pos").collect()
    assert [(r.part_name, bytes(r.data)) for r in data] == [("/word/two.htm", b"TWO"), ("/word/one.mht", b"ONE"), ("/word/one.mht", b"ONE")]
    with zipfile.ZipFile(io.BytesIO(one)) as z:
        spent = sum(z.getinfo(n).file_size for n in (W.DOCUMENT, W.DOCUMENT_RELS, W.CONTENT_TYPES))
    assert W.altchunk_data(package, found, total=spent + 4).count() == 1 and W.altchunk_data(package, found, total=spent - 1).count() == 0


def test_packages_written_anew(spark):
    sheets = {"xl/worksheets/sheet1.xml": b'<worksheet><PageSetup orientation="portrait"/><c/></worksheet></worksheet>', "xl/worksheets/sheet22.xml": b"<worksheet><c/></WORKSHEET>", "xl/worksheets/other.xml": b"<worksheet></worksheet>", "xl/worksheets/sheet3.xml": b"none"}
    blob = bytes(range(256)) * 400
    package = zipped({**sheets, "big.bin": blob, "d/": b""})
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:  # stored, and with a descriptor after the data
        z.writestr("a.txt", "stored")
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b"<worksheet></worksheet>")
    got = W.landscape_packages(files(spark, [package, held.getvalue(), b"no zip", None, package[:200]])).orderBy("doc_id").collect()
    assert [r.content is None for r in got] == [False, False, True, True, True]
    with zipfile.ZipFile(io.BytesIO(bytes(got[0].content))) as new, zipfile.ZipFile(io.BytesIO(package)) as old:
        assert new.testzip() is None and new.namelist() == old.namelist()
        assert new.read("xl/worksheets/sheet1.xml") == b'<worksheet><pageSetup orientation="landscape"/><c/></worksheet></worksheet>'
        assert new.read("xl/worksheets/sheet22.xml") == b'<worksheet><c/><pageSetup orientation="landscape"/></worksheet>'
        assert new.read("xl/worksheets/sheet3.xml") == b"none" and new.read("big.bin") == blob
        for name in ("big.bin", "xl/worksheets/other.xml"):
            assert W._raw(new, new.getinfo(name)) == W._raw(old, old.getinfo(name))
    with zipfile.ZipFile(io.BytesIO(bytes(got[1].content))) as new:
        assert new.testzip() is None and new.read("a.txt") == b"stored" and b"landscape" in new.read("xl/worksheets/sheet1.xml")
    assert W.landscape(package, total=1000) is None and W.landscape(package, count=3) is None
    patched = [T.landscape_patch(F.lit(s.decode())) for s in sheets.values() if s != b"<worksheet></worksheet>"]
    row = spark.range(1).select(*[p.alias(f"x{i}") for i, p in enumerate(patched)]).first()
    assert list(row) == ['<worksheet><pageSetup orientation="landscape"/><c/></worksheet></worksheet>', '<worksheet><c/><pageSetup orientation="landscape"/></worksheet>', "none"]


def compound_file(entries, shift=9, cycle=False, lists=0):
    """A compound file of directory entries (name, kind, left, right, child, size) alone."""
    size = 1 << shift
    rows = b"".join(n.encode("utf-16-le").ljust(64, b"\0")[:64] + struct.pack("<HBBIII", 2 * len(n) + 2, k, 1, a, b, c) + bytes(36) + struct.pack("<IQ", 0, s) for n, k, a, b, c, s in entries)
    rows += bytes(-len(rows) % size)
    sectors = [rows[i : i + size] for i in range(0, len(rows), size)]
    n = len(sectors)
    table = [*range(1, n), 0 if cycle else 0xFFFFFFFE, 0xFFFFFFFD]
    table += [0xFFFFFFFF] * (size // 4 - len(table))
    head = bytearray(compound.MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 4 if shift == 12 else 3, 0xFFFE, shift, 6))
    head += bytes(48 - len(head)) + struct.pack("<IIIIIIII", 0, 0, 4096, 0xFFFFFFFE, 0, n + 1 if lists else 0xFFFFFFFE, lists, 0 if lists else n)
    head = head[:76] + struct.pack("<I", 0xFFFFFFFF if lists else n) + b"\xff" * (512 - 80)
    more = [struct.pack("<I", n) + b"\xff" * (size - 8) + struct.pack("<I", n + 1)] if lists else []  # a list that names itself as its next
    return bytes(head[:512]).ljust(size, b"\0") + b"".join(sectors) + struct.pack(f"<{size // 4}I", *table) + b"".join(more)


N = 0xFFFFFFFF
TREE = [("Root Entry", 5, N, N, 2, 0), ("Workbook", 2, N, N, N, 600_000), ("Macros", 1, 1, 3, 4, 0), ("\x05Info", 2, N, N, N, 7), ("VBA", 1, N, N, 5, 0), ("dir", 2, N, N, N, 1 << 33)]


def test_streams_of_compound_files(spark):
    want = {"Workbook": 600_000, "\x05Info": 7, "Macros/VBA/dir": 0}
    wide = compound_file(TREE, 12)
    loops = [("Root Entry", 5, N, N, 1, 0), ("a", 2, 1, 2, N, 1), ("b", 1, 1, 0, 2, 0), ("c", 2, 99, N, N, 3)]
    many = [("Root Entry", 5, N, N, 1, 0)] + [(f"s{i}", 2, N, i + 1, N, i) for i in range(1, 40)]
    contents = [compound_file(TREE), wide, compound_file(TREE, cycle=True), compound_file(TREE, lists=1), compound_file(loops), compound_file(many), compound_file(TREE)[:700], compound.MAGIC, b"", None, b"x" * 2000]
    got = [dict(map(tuple, r.streams)) for r in compound.compound_streams(files(spark, contents)).orderBy("doc_id").collect()]
    assert got[0] == got[2] == got[3] == want and got[1] == want | {"Macros/VBA/dir": 1 << 33}
    assert got[4] == {"a": 1} and got[5] == {f"s{i}": i for i in range(1, 40)} and not any(got[7:])
    rows = compound.compound_streams(files(spark, [compound_file(TREE), compound_file([TREE[0], ("VBA", 2, N, N, N, 1), ("EncryptedPackage", 2, N, 1, N, 1)])]))
    seen = rows.select("doc_id", D.ole_warnings(F.transform("streams", lambda s: s["name"])).alias("w"), T.oversized_workbook(F.col("streams")).alias("big")).orderBy("doc_id").collect()
    assert [(r.w, r.big) for r in seen] == [([], True), (["ole_encrypted"], False)]


def test_stored_index_is_brute_force(spark):
    from vellumetry.operators.stored_index import RadiusIndex

    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 30, dtype=np.int64)
    words = [int(base[rng.integers(30)] ^ np.int64(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 9), replace=False)))) for _ in range(300)] + [0] * 60
    rows = [(i, w) for i, w in enumerate(words)] + [(1000, None)]

    def table(some):
        return spark.createDataFrame(some, "id long, w long")

    index = RadiusIndex(spark, "near_test", 6, buckets=8)
    index.drop()
    live = {}

    def check():
        queries = [(10_000 + i, w) for i, w in enumerate([*map(int, base[:12]), 0, 1])] + [(5, None)]
        got = {(r.query, r.id): r.distance for r in index.search(table(queries), 5).collect()}
        want = {}
        for q, w in queries:
            for i, own in live.items():
                d = [bin((w ^ x) & (2**64 - 1)).count("1") for x in own] if w is not None else []
                if d and min(d) <= 5:
                    want[q, i] = min(d)
        assert got == want and want
        top = {}
        for r in index.search(table(queries), 5, k=3).collect():
            top.setdefault(r.query, []).append((r.distance, r.id))
        best = {}
        for (q, i), d in want.items():
            best.setdefault(q, []).append((d, i))
        assert {q: sorted(x) for q, x in top.items()} == {q: sorted(x)[:3] for q, x in best.items()}

    def put(some):
        index.append(table(some))
        for i, w in some:
            if w is not None:
                live.setdefault(i, []).append(w)

    put(rows[:200])
    check()
    put(rows[200:])
    put([(3, 0), (3, words[3])])
    check()
    gone = list(range(0, 340, 3))
    index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
    for i in gone:
        live.pop(i, None)
    check()
    put([(3, words[7])])
    check()
    index.compact()
    check()
    with pytest.raises(ValueError):
        index.search(table(rows[:1]), 7)
    index.drop()


def test_stored_index_is_probed_without_shuffling_it(spark):
    from vellumetry.operators.stored_index import RadiusIndex

    index = RadiusIndex(spark, "plan_test", 5, buckets=8)
    index.drop()
    index.append(spark.range(500).selectExpr("id", "id * 7919 w"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(keep, ("false", "-1")):
            spark.conf.set(k, v)
        plan = index.search(spark.range(40).selectExpr("id", "id * 7919 w"))._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    for name in ("plan_test_words", "plan_test_rows"):
        at = next(i for i, line in enumerate(plan) if "FileScan" in line and name in line)
        above, depth = [], len(plan[at]) - len(plan[at].lstrip(" :+-"))
        for line in reversed(plan[:at]):
            own = len(line) - len(line.lstrip(" :+-"))
            if own < depth:  # the next one up, not a sibling
                depth = own
                above.append(line)
                if "Join" in line:
                    break
        assert "Join" in above[-1] and not any("Exchange" in line for line in above), "\n".join(plan)
    index.drop()


def test_artifacts_of_a_repeated_task_are_one_set(spark, tmp_path):
    from vellumetry.sources.bundles import _Writer, read_artifacts, write_artifacts

    folder = str(tmp_path / "out")
    names = ["page-001.png", "page-001-trimmed.png", "document.pdf", "metadata.json"]
    rows = [(d, n, bytearray(f"{d}{n}".encode())) for d in range(20) for n in names]
    write_artifacts(spark.createDataFrame(rows, "doc_id long, name string, content binary"), folder)
    # A task whose attempt fails half way, and is made again: the first leaves nothing.
    writer, seen = _Writer(folder), []

    def broken():
        yield (7777, "page-001.png", b"half")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    seen.append(writer.write(iter([(200, "page-001.png", b"a"), (200, "page-002.png", b"b")])))
    seen.append(writer.write(iter([(200, "page-001.png", b"a"), (200, "page-002.png", b"b")])))  # a second attempt that also ran to its end
    writer.commit(seen[1:])
    done = writer.write(iter([(300, "page-001.png", b"c")]))
    writer.abort([done, None])
    got = sorted((r.doc_id, r.name, bytes(r.content)) for r in read_artifacts(spark, folder).collect())
    assert got == sorted([(d, n, bytes(c)) for d, n, c in rows] + [(200, "page-001.png", b"a"), (200, "page-002.png", b"b")])
    for bad in ("../x.png", "page-1.PNG", "a/page-001.png", "page-001.png\n", "", None):
        with pytest.raises(ValueError):
            writer.write(iter([(1, bad, b"x")]))
    with pytest.raises(ValueError):
        writer.write(iter([(1, "page-001.png", b"x"), (1, "page-001.png", b"x")]))
    for nothing in (b"", None):
        with pytest.raises(ValueError):
            writer.write(iter([(1, "page-001.png", nothing)]))


def test_resampling_is_the_sum_written_out():
    def one(row, new):
        old, out = len(row), []
        step = old / new
        wide = max(step, 1)
        for i in range(new):
            c = (i + 0.5) * step
            lo, hi = max(int(c - 3 * wide + 0.5), 0), min(int(c + 3 * wide + 0.5), old)
            w = []
            for j in range(lo, hi):
                x = (j - c + 0.5) / wide
                w.append(0.0 if abs(x) >= 3 else 1.0 if x == 0 else 3 * np.sin(np.pi * x) * np.sin(np.pi * x / 3) / (np.pi * x) ** 2)
            out.append(sum(a * b for a, b in zip(w, row[lo:hi])) / sum(w))
        return np.clip(np.floor(np.array(out) + 0.5), 0, 255)

    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (37, 53), dtype=np.uint8)
    for height, width in ((12, 20), (37, 20), (50, 60), (1, 1)):
        across = np.array([one(r, width) for r in a.astype(float)]) if width != 53 else a.astype(float)
        down = np.array([one(c, height) for c in across.T]).T if height != 37 else across
        got = raster.resampled(a, height, width)
        assert got.dtype == np.uint8 and (got == down).all()
    flat = np.full((300, 200, 3), 77, dtype=np.uint8)
    assert (raster.resampled(flat, 50, 40) == 77).all()
    # A step keeps its place and overshoots on both sides, as the kernel's lobes are negative.
    step = np.repeat(np.array([50] * 64 + [200] * 64, dtype=np.uint8)[None], 8, axis=0)
    row = raster.resampled(step, 8, 32)[0].astype(int)
    assert row[:12].tolist() == [50] * 12 and row[20:].tolist() == [200] * 12 and row.min() < 50 and row.max() > 200 and row[15] < 125 < row[16]
    ramp = np.repeat(np.arange(0, 256, 2, dtype=np.uint8)[None], 4, axis=0)
    assert np.abs(np.diff(raster.resampled(ramp, 4, 32)[0][2:-2].astype(int)) - 8).max() <= 1
    big = np.zeros((3000, 1500, 3), dtype=np.uint8)
    assert raster.downscaled(big).shape == (1024, 512, 3)


def test_equal_pictures_and_equal_rows_are_looked_at_once(spark, monkeypatch):
    """The facts are those of every pixel; what a task has seen is not opened again, and opening needs no stage of its own."""
    a = np.full((240, 240, 3), 255, dtype=np.uint8)
    a[40:120, 20:110] = (0, 64, 100)
    assert raster.Bands(a).heights.tolist() == [40, 80, 120]
    rng = np.random.default_rng(3)
    for x in (a, rng.integers(0, 256, (70, 90, 3), dtype=np.uint8), a[:, ::-1].copy()):
        bands = raster.Bands(x)
        assert (np.repeat(bands.rows, bands.heights, axis=0) == x).all() and bands.runs()[1].sum() == x.shape[0] * x.shape[1]
    small = rng.integers(0, 256, (60, 200), dtype=np.uint8)
    dense = raster.resampled(small, 32, 32)
    monkeypatch.setattr(raster, "DENSE", 0)
    assert (raster.resampled(small, 32, 32) == dense).all()
    looked = []
    monkeypatch.setattr(raster, "facts", lambda a: looked.append(1) or {"phash": "x"})
    kept = {}

    class Rows:
        schema = spark.createDataFrame([], "doc_id long, raster struct<height:int,width:int,data:binary>").schema

        def select(self, *_):
            return self

        def mapInArrow(self, work, kinds):
            kept["work"] = work

    raster.page_facts(Rows(), ["doc_id"])
    side = pa.array([240] * 5, pa.int32())
    batch = pa.record_batch([pa.array(range(5)), pa.StructArray.from_arrays([side, side, pa.array([a.tobytes()] * 5, pa.binary())], ["height", "width", "data"])], names=["doc_id", "raster"])
    assert [r for b in kept["work"](iter([batch])) for r in b.column(3).to_pylist()] == ["x"] * 5 and len(looked) == 1


def test_batches_are_bounded_and_packages_are_opened_once(spark, sf_dir, monkeypatch):
    """Rows go out in batches by bytes, not one frame a document; each package is parsed once for its sub-documents."""
    import __spark_entry__
    from vellumetry.operators import arrow

    monkeypatch.setattr(arrow, "BYTES", 10)
    got = list(arrow.packed(((i, "n", b"x" * 4) for i in range(7)), "doc_id long, name string, data binary"))
    assert [b.num_rows for b in got] == [2, 2, 2, 1] and [r for b in got for r in b.column(0).to_pylist()] == list(range(7))
    plan = __spark_entry__.queries()["altchunk_join"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "MapInPandas" not in plan
    files = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    from vellumetry.plans import office as O

    files = O._packages(lambda _: files, O._document)
    assert sorted(W.package_altchunks(files).collect()) == sorted(W.altchunks(*W.altchunk_parts(files)).collect())
