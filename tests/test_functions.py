"""Known answers of single functions and operators."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumetry.functions import hashing as H
from vellumetry.functions import text as T
from vellumetry.operators import containers as C
from vellumetry.operators import detect as D
from vellumetry.operators import raster as R
from vellumetry.operators import pages as P
from vellumetry.operators import scanners as S
from vellumetry.operators import similarity
from vellumetry.operators.pages import effective_dpi


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_names(spark):
    assert values(spark, lambda x: T.safe_filename(x, F.lit("f")), ["../../etc/passwd", "C:\\temp\\evil.png", "..."]) == ["passwd", "evil.png", "f"]
    assert values(spark, T.extension_hint, ["a/b.DOCX", ".bashrc", "none", "x.tar.gz"]) == ["docx", "", "", "gz"]
    assert values(spark, T.upload_name, ["a b.txt", ".hidden", ""]) == ["a_b.txt", "upload.bin", "upload.bin"]
    assert values(spark, T.page_index, ["page-012.png", "page-012-trimmed.png", "x"]) == [12, None, None]
    assert values(spark, T.positional_ok, ["a", "-a"]) == [True, False]


def test_markup_values(spark):
    assert values(spark, T.font_rung, ["12px", "1pc", "14pt", "31pt", "2em", "50%"]) == ["2", "3", "4", "7", None, None]
    assert values(spark, T.css_value, ["'#abc'", '"x"', "red"]) == ["#aabbcc", "x", "red"]
    assert values(spark, T.declarations, ["A: 1; b:2;a:3;;c:"]) == [{"b": "2", "a": "3"}]
    patched = values(spark, T.landscape_patch, ["<worksheet><pageSetup a='1'/></worksheet>", "<worksheet></worksheet>", "<x/>"])
    assert patched == ['<worksheet><pageSetup orientation="landscape"/></worksheet>'] + ['<worksheet><pageSetup orientation="landscape"/></worksheet>', "<x/>"]


def test_formats(spark):
    assert values(spark, T.normal_format, ["RMQRCode", "QRCode", "EAN-13"]) == ["rmqr_code", "qr_code", "ean_13"]
    assert values(spark, T.valid_lang, ["eng+Latin", "eng;x", ""]) == [True, False, False]


def test_exact_scanner_lines(spark):
    assert S.parse_line('{"Format":"QRCode","Text":"a\\"b\\x","EC":null,"M":true}') == {"Format": "QRCode", "Text": 'a"bx', "EC": None, "M": "true"}
    assert S.parse_line('{"a":"b"') is None and S.parse_line("nonsense") is None
    assert S.parse_line('{"a":"\\u0041\\b\\f\\n", "b" : 12 ,"c":}') == {"a": "u0041bf\n", "b": "12", "c": ""}
    assert S.parse_line('{"a":1}"b":2}') is None and S.parse_line("{}") == {}
    assert values(spark, S.exact_lines, ['{"a":"1"}\nbad\n{"b":null}']) == [[{"a": "1"}, {"b": None}]]


def test_hamming_and_colour_distance(spark):
    assert values(spark, H.word, ["ffffffffffffffff", "8000000000000000"]) == [-1, -(2**63)]
    assert values(spark, lambda x: H.colorhash_distance(x, F.lit("0" * 14)), ["f" * 14, "1" * 13]) == [210, H.INCOMPARABLE]
    assert values(spark, lambda x: H.colorhash_distance(x, x, 3, 3), ["f" * 14]) == [0]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2**64 - 1)), min_size=2, max_size=25), st.integers(0, 7))
def test_banded_pairs_are_all_pairs(spark, seeds, radius):
    words = [(i, int(np.uint64(w ^ ((1 << k) - 1)).astype(np.int64))) for i, (k, w) in enumerate(seeds + [(0, seeds[0][1])])]
    got = {tuple(r) for r in similarity.pairs_within(spark.createDataFrame(words, "id long, w long"), radius).collect()}
    want = {(a, b, d) for a, x in words for b, y in words if a < b and (d := ((x ^ y) & (2**64 - 1)).bit_count()) <= radius}
    assert got == want


def test_flat_pictures_have_known_signatures():
    def flat(rgb):
        return np.full((100, 100, 3), rgb, dtype=np.uint8)

    assert R.phash(flat((255, 0, 0))[:8, :8]) == "8000000000000000" and R.colorhash(flat((255, 0, 0))[:8, :8]) == "00000000f00000"
    assert R.colorhash(flat((255, 255, 255))) == "0f000000000000" and R.colorhash(flat((0, 0, 0))) == "f0000000000000"
    for rgb in ((255, 255, 255), (0, 0, 0), (0, 255, 0)):
        assert int(R.phash(flat(rgb)), 16).bit_count() <= 1


def test_crops():
    page = np.full((240, 240, 3), 255, dtype=np.uint8)
    assert R.trim_bottom(page) is None and R.focus(page) is None
    page[70:150, 80:170] = (0, 64, 160)
    assert R.trim_bottom(page) == {"crop_height": 170, "removed_percent": 29.2, "background": "#ffffff"}
    assert R.focus(page)["crop_box"] == [68, 58, 182, 162]


def zipped(**members) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return held.getvalue()


def test_zip_bombs_stop(spark):
    bomb = zipped(**{"payload.bin": b"A" * 10_000_000, "[Content_Types].xml": b""})
    with zipfile.ZipFile(io.BytesIO(bomb)) as z:
        assert C.bounded_read(z, "payload.bin", 1000) is None and C.bounded_read(z, "none") is None
    files = spark.createDataFrame([(1, bytearray(bomb)), (2, bytearray(b"not a zip")), (3, None)], "doc_id long, content binary")
    e = C.zip_entries(files)
    assert {r.doc_id for r in e.collect()} == {1}
    got = e.groupBy("doc_id").agg(F.collect_list("name").alias("n"), F.collect_list("compress_size").alias("c"), F.collect_list("file_size").alias("s"))
    assert not got.select(D.ooxml_gate(F.col("n"), F.col("c"), F.col("s"))).first()[0]
    assert C.within_budget(e, total=100).count() == 0 and C.zip_members(files, "payload", total=100).count() == 0


def test_content_warnings(spark):
    assert values(spark, D.ole_warnings, [["VBA/dir"], ["VBA/dir", "Workbook"], ["EncryptedPackage"]], "array<string>") == [["ole_macro_only_payload"], [], ["ole_encrypted"]]
    entries = [[("word/document.xml", 0), ("x/evil.exe", 3)], [("word/document.xml", 5), ("word/a.bin", 3)]]
    assert values(spark, D.ooxml_warnings, entries, "array<struct<name:string,size:long>>") == [["ooxml_empty_core_document", "ooxml_suspicious_entries"], []]


@pytest.mark.parametrize("n, safe", [(64, True), (65, False)])
def test_entity_bomb(spark, n, safe):
    assert values(spark, D.entity_gate, ["".join(f'<!ENTITY e{i} "x">' for i in range(n))]) == [safe]


def test_relabelling(spark):
    dirs = F.array().cast("array<string>")
    assert values(spark, lambda x: D.magic_label(F.lit("docx"), x, dirs), ["application/vnd.ms-excel", "text/plain", None]) == ["xls", "docx", "docx"]
    assert values(spark, lambda x: D.odf_label(F.lit("odt"), x), ["application/vnd.oasis.opendocument.graphics", ""]) == ["odg", "odt"]


def test_resolution_is_only_lowered(spark):
    assert values(spark, lambda x: effective_dpi(150, x, 1_000_000), [1.0, 4e6, 1e12], "double") == [150, 75, 36]


def test_streams_count_like_tables(spark, sf_dir, tmp_path):
    from vellumetry.streaming.jobs import counts_by_window, latest_state

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"), F.col("user_id").alias("job_id"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, f in (("w", counts_by_window), ("s", latest_state)):
        stream = f(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), delay="400 days")
        q = stream.writeStream.outputMode("complete").format("memory").queryName(f"got_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert {tuple(r) for r in spark.table(f"got_{name}").collect()} == {tuple(r) for r in f(events).collect()}


def test_package_gate_and_budgets(spark):
    """A 600 MB member fails the gate and the budget, however good the other entries look."""
    rows = [(1, 0, "[Content_Types].xml", 100, 200), (1, 1, "word/document.xml", 1000, 5000), (1, 2, "x.bin", 600_000, 600 << 20), (2, 0, "[Content_Types].xml", 100, 200)]
    e = spark.createDataFrame(rows, "doc_id long, pos int, name string, compress_size long, file_size long")
    got = e.groupBy("doc_id").agg(F.collect_list("name").alias("n"), F.collect_list("compress_size").alias("c"), F.collect_list("file_size").alias("s"))
    assert {r[0]: r[1] for r in got.select("doc_id", D.ooxml_gate(F.col("n"), F.col("c"), F.col("s"))).collect()} == {1: False, 2: True}
    assert {r.doc_id for r in C.within_budget(e).collect()} == {2}
    assert C.within_budget(e, count=2).where("doc_id = 1").isEmpty()


def test_cascade_by_its_rules(spark):
    kinds = "path string, length long, clf_label string, clf_score double, clf_mime string, libmagic_mime string, is_zip boolean, package_ok boolean, entity_count int, is_mht boolean, odf_marker string, zip_dirs array<string>, is_rtf boolean, streams array<string>, entries array<struct<name:string,size:long>>"

    def file(path, label, mime="application/octet-stream", score=0.9, is_zip=False, ok=False, entities=0, mht=False, rtf=False, dirs=(), streams=(), entries=(), length=10, magic=None):
        return (path, length, label, score, mime, magic, is_zip, ok, entities, mht, None, list(dirs), rtf, list(streams), list(entries))

    rows = [
        (file("/a/x.foo", "xml", "text/xml"), (None, "magika_unknown_extension_mismatch")),
        (file("/a/x.fodt", "xml", entities=64), ("odt", "extension", 0.0, ["magika_labeled_as_xml"])),
        (file("/a/x.fodt", "xml", entities=65), (None, "magika_unknown_extension_mismatch")),
        (file("/a/x.docx", "zip", ok=True), ("docx", "extension", 0.0, ["magika_labeled_as_zip"])),
        (file("/a/x.docx", "unknown"), ("docx", "extension", 0.0, ["magika_unrecognized_content"])),
        (file("/a/x.docx", "unknown", is_zip=True), (None, "ooxml_structural_check_failed")),
        (file("/a/x.odt", "unknown", is_zip=True), ("odt", "extension", 0.0, ["magika_unrecognized_content"])),
        (file("/a/x", "unknown"), (None, "magika_unknown_extension_mismatch")),
        (file("/a/x.docx", "docx"), (None, "ooxml_structural_check_failed")),
        (file("/a/x.xlsb", "xlsb"), ("xlsb", "magika", 0.9, [])),
        (file("/a/x.docx", "docx", ok=True, entries=[("word/document.xml", 0)]), ("docx", "magika", 0.9, ["ooxml_empty_core_document"])),
        (file("/a/x.doc", "doc", streams=["VBA/dir"]), ("doc", "magika", 0.9, ["ole_macro_only_payload"])),
        (file("/a/x.doc", "doc", dirs=["xl/a"]), ("doc", "magika", 0.9, [])),
        (file("/a/x.docx", "docx", dirs=["xl/a"], ok=True), ("xlsx", "magika", 0.9, [])),
        (file("/a/x.docx", "docx", mht=True), ("mht", "magika", 0.9, [])),
        (file("/a/x.py", "python", "text/x-python"), ("txt", "magika", 0.9, ["rendered_as_text_from_python"])),
        (file("/a/x.docx", "pdf"), (None, "unsupported_type")),
        (file("/a/x.bin", "pdf", rtf=True), ("rtf", "magika", 0.9, [])),
        (file("/a/x.txt", "txt", length=99), (None, "input_too_large")),
    ]
    got = D.detect(spark.createDataFrame([(*f, i) for i, (f, _) in enumerate(rows)], kinds + ", i int"), 50).orderBy("i").collect()
    for r, (_, want) in zip(got, rows):
        seen = (None, r.reject_reason) if r.label is None else (r.label, r.source, r.confidence, r.warnings)
        assert seen == want, r


def test_message_parts_and_names(spark):
    def part(head, body):
        return f"--b\n{head}\n\n{body}\n"

    message = 'MIME-Version: 1.0\nContent-Type: multipart/related; boundary="b"\n\n' + part("Content-Type: image/png\nContent-Location: http://x/a.png", "one") + part("Content-Type: text/html\nContent-Location: http://x/page.html", "<p>") + part("Content-Type: text/html\nContent-Location: C:\\d\\a.png", "two") + part("Content-Type: image/png\nContent-ID: <K@x>", "three") + part("Content-Type: image/png", "") + "--b--\n"
    got = C.mht_parts(spark.createDataFrame([(1, bytearray(message.encode()))], "doc_id long, content binary")).orderBy("pos").collect()
    import hashlib

    assert [(r.root, r.local_name) for r in got] == [(False, "a.png"), (True, None), (False, "a.png_1"), (False, f"part-{hashlib.sha1(b'three').hexdigest()[:10]}.bin")]
    assert got[3].cid == "k@x"


def test_oversized_sheets(spark):
    assert values(spark, T.oversized_range, ["A1:AE5", "A1:AD200", "A1:B201", "ZZ999", "A1:5", None]) == [True, False, True, False, False, False]
    streams = [[("Workbook", 500_001)], [("Book", 500_001), ("Workbook", 9)], [("Book", 500_001)], []]
    assert values(spark, T.oversized_workbook, streams, "array<struct<name:string,size:long>>") == [True, False, True, False]
    package = zipped(**{"xl/worksheets/sheet1.xml": b'<worksheet><dimension ref="A1:C3"/></worksheet>', "xl/worksheets/sheet2.xml": b'<dimension  ref="A1:C300"/>', "xl/worksheets/other.xml": b""})
    got = C.oversized_sheets(spark.createDataFrame([(1, bytearray(package))], "doc_id long, content binary")).collect()
    assert [tuple(r) for r in got] == [(1, True)]


def test_page_budget(spark):
    from vellumetry.operators.pages import max_page_px

    assert values(spark, lambda x: max_page_px(x), [0.0, 0.001, 1.0, 64.0], "double") == [100_000_000, 1_000_000, 33_554_432, 100_000_000]
    assert values(spark, lambda x: max_page_px(F.lit(1.0), x), ["5", "999999999", "-1", "x", "2000000"]) == [1_000_000, 200_000_000, 33_554_432, 33_554_432, 2_000_000]


def test_image_channels_and_gradients(spark):
    image = "struct<height:int,width:int,nChannels:int,data:binary>"
    pictures = [(1, 2, 1, bytearray([7, 9])), (1, 1, 3, bytearray([1, 2, 3])), (1, 1, 4, bytearray([1, 2, 3, 255]))]
    assert [bytes(r.data) for r in values(spark, R.from_image, pictures, image)] == [b"\7\7\7\t\t\t", b"\3\2\1", b"\3\2\1"]
    # Growing light has a mean and negative odd coefficients along its axis, falling light positive ones; the rest are 0.
    ramp = np.repeat(np.repeat(np.arange(0, 256, 8, dtype=np.uint8)[None, :, None], 32, axis=0), 3, axis=2)
    n = np.arange(32)
    row = [float(np.sum(ramp[0, :, 0] * np.cos(np.pi * (2 * n + 1) * k / 64))) * 32 for k in range(8)]
    low = np.round(np.concatenate([row, np.zeros(56)]), 6)
    assert R.phash(ramp) == f"{int(''.join('1' if x > np.median(low) else '0' for x in low), 2):016x}" == "8000000000000000"
    assert R.phash(ramp.transpose(1, 0, 2)[::-1]) == "8080008000800080" and R.phash(ramp[:, ::-1]) == "d500000000000000"
    big = np.repeat(np.repeat(ramp, 50, axis=0), 50, axis=1)
    assert R.downscaled(big).shape == (1024, 1024, 3)


def test_limits_and_environment():
    from vellumetry.config import Limits

    got = Limits.from_env({"VELLUMETRY_DPI": "300", "VELLUMETRY_SKIP_BLANKS": "No", "VELLUMETRY_DISCLOSE_INTERNALS": "maybe", "OTHER": "x"}, max_pages=7)
    assert (got.dpi, got.skip_blanks, got.disclose_internals, got.max_pages) == (300, False, False, 7)
    with pytest.raises(ValueError, match="VELLUMETRY_DPI"):
        Limits.from_env({"VELLUMETRY_DPI": "many"})
    for bad in ({"dpi": 35}, {"max_pages": 1001}, {"rasterizer": "none"}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_scans_and_sinks(spark, tmp_path):
    from vellumetry.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"abc")
    got = files.scan_files(spark, str(tmp_path / "in")).collect()
    assert len(got) == 1 and got[0].sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert got[0].ext == "txt" and files.scan_files(spark, str(tmp_path / "in"), "*.doc").count() == 0
    files.write_records(spark.createDataFrame([(1, None), (2, "x")], "doc_id long, note string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"doc_id":1}', '{"doc_id":2,"note":"x"}']


def test_sharded_dpi_is_its_parts_without_joins(spark, sf_dir):
    """One shuffle, no join and no window; the partitions grow with the rows, so that no task does."""
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_suppkey"]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), *order, (F.col("l_quantity") * 40).alias("width_mm"), (F.col("l_tax") * 10000 + 50).alias("height_mm"))
    got = P.sharded_dpi(lines, order, 150, 20_000_000, 8, 6, rows=100)
    pages = lines.withColumn("page", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    shards = P.shard_ranges(pages.groupBy("doc_id").agg(F.count("*").alias("pages")), "pages", 8, 6)
    want = P.shard_dpi(pages, shards, 150, 20_000_000).join(P.document_peak_mb(pages, 150, 20_000_000), "doc_id")
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    plan = plan.rpartition("Initial Plan")[2]
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    assert got.rdd.getNumPartitions() > lines.count() // 100
