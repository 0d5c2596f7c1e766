"""Queries over bytes: packages, messages and pictures made from the tables. Tested against known answers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import containers as C
from ..operators import detect as D
from ..operators import pages as P
from ..operators import raster as R
from ..streaming.jobs import counts_by_window
from .registry import query


def _packages(t):
    """A zip a conversation: a workbook with a sheet for each turn, and its content types."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc_id, turns in zip(pdf["doc_id"], pdf["turns"]):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    if doc_id % 4:
                        z.writestr("[Content_Types].xml", "<Types/>")
                    sheets = "".join(f'<sheet name="S{i}" sheetId="{i}"{" state=" + chr(34) + "hidden" + chr(34) if i % 3 == 1 else ""}/>' for i in turns)
                    z.writestr("xl/workbook.xml", f"<workbook><sheets>{sheets}</sheets></workbook>")
                    z.writestr("xl/media/blob.bin", b"A" * (400_000 if doc_id % 5 == 0 else 10))
                out.append((doc_id, held.getvalue()))
            yield pd.DataFrame(out, columns=["doc_id", "content"])

    c = t("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_set("turn")).alias("turns"))
    return c.mapInPandas(pack, "doc_id long, content binary")


@query("SELECT conv_id AS doc_id, conv_id % 4 <> 0 AND conv_id % 5 <> 0 AS ok, (CASE WHEN conv_id % 4 <> 0 THEN 3 ELSE 2 END)::BIGINT AS entries FROM conversations GROUP BY conv_id")
def ooxml_gate(spark, t):
    e = C.zip_entries(_packages(t))
    got = e.groupBy("doc_id").agg(F.collect_list("name").alias("names"), F.collect_list("compress_size").alias("packed"), F.collect_list("file_size").alias("sizes"))
    return got.select("doc_id", D.ooxml_gate(F.col("names"), F.col("packed"), F.col("sizes")).alias("ok"), F.size("names").cast("long").alias("entries"))


@query("""
WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2)
SELECT conv_id AS doc_id, '<p>' || string_agg('<img src="img' || turn::VARCHAR || '.png"><a href="img' || turn::VARCHAR || '.png">http://x.example/a/img' || turn::VARCHAR || '.png</a>', '' ORDER BY turn) || '<img src="cid:none"></p>' AS html,
sum(octet_length(encode(text)))::BIGINT AS bytes FROM c WHERE text <> '' GROUP BY conv_id""")
def mht_unpack(spark, t):
    """A message a conversation: a page in a character set of its own, and a part for each turn that holds its text."""
    c = t("conversations").groupBy(F.col("conv_id").alias("doc_id"), "turn").agg(F.min("text").alias("text")).where("text <> ''")
    turn = F.col("turn").cast("string")
    images = F.concat(F.lit("\n--b\nContent-Type: image/png\nContent-Transfer-Encoding: base64\nContent-ID: <Pic"), turn, F.lit("@x>\nContent-Location: http://x.example/a/img"), turn, F.lit(".png\n\n"), F.base64(F.encode("text", "UTF-8")))
    tags = F.concat(F.lit('<img src="cid:pic'), turn, F.lit('@X"><a href="http://x.example/a/img'), turn, F.lit('.png">http://x.example/a/img'), turn, F.lit(".png</a>"))
    parts = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("turn", images.alias("part"), tags.alias("tag")))).alias("p"))
    html = F.concat(F.lit("<p>"), F.array_join(F.col("p")["tag"], ""), F.lit('<img src="cid:none"></p>'))
    message = F.concat(F.lit('MIME-Version: 1.0\nContent-Type: multipart/related; boundary="b"\n\n--b\nContent-Type: text/html; charset="UTF-16LE"\nContent-Transfer-Encoding: base64\n\n'), F.base64(F.encode(html, "UTF-16LE")), F.array_join(F.col("p")["part"], ""), F.lit("\n--b--\n"))
    found = C.mht_parts(parts.select("doc_id", message.cast("binary").alias("content")))
    pages = found.where("root").select("doc_id", F.col("text").alias("html"))
    pages = C.rewrite_urls(C.rewrite_cids(pages, found), found)
    sizes = found.where("not root").groupBy("doc_id").agg(F.sum(F.octet_length("payload")).cast("long").alias("bytes"))
    return pages.join(sizes, "doc_id")


def _rasters(t):
    """(keys, draw): parts by key, and what draws their pages: white with a box of a colour, its place and colour by
    the part's key; every third page is plain."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        white = b"\xff" * 720
        for batch in batches:
            # A few pictures at a time: 32 pages are 5.5 MB.
            for first in range(0, batch.num_rows, 32):
                part = batch.column(0).slice(first, 32)
                out = []
                for k in part.to_pylist():
                    if k % 3:
                        top, left = 40 + 3 * (k % 10), 20 + k % 70
                        row = np.full((240, 3), 255, dtype=np.uint8)
                        row[left : left + 90] = (0, 64, 100 + k % 100)
                        out.append(b"".join((white * top, row.tobytes() * 80, white * (160 - top))))
                    else:
                        out.append(white * 240)
                side = pa.array([240] * len(out), pa.int32())
                raster = pa.StructArray.from_arrays([side, side, pa.array(out, pa.binary())], ["height", "width", "data"])
                yield pa.record_batch([part, raster], names=["doc_id", "raster"])

    # The keys are few bytes and the pictures many, so they are dealt over all cores before they are drawn.
    keys = t("part").select(F.col("p_partkey").cast("long").alias("doc_id"))
    return keys.repartition(keys.sparkSession.sparkContext.defaultParallelism, "doc_id"), draw


@query("""
WITH p AS (SELECT p_partkey AS k, 40 + 3 * (p_partkey % 10) AS top, 20 + p_partkey % 70 AS lft, p_partkey % 3 <> 0 AS box FROM part)
SELECT k AS doc_id, CASE WHEN box THEN top + 100 END::INT AS crop_height, CASE WHEN box THEN round((1 - (top + 100) / 240.0) * 100, 1) END::DOUBLE AS trimmed_percent,
CASE WHEN box AND k % 5 <> 0 THEN (lft - 12)::VARCHAR || ',' || (top - 12)::VARCHAR || ',' || (lft + 102)::VARCHAR || ',' || (top + 92)::VARCHAR END AS box, NOT box AS blank,
CASE WHEN box THEN '0e000000000f00' ELSE '0f000000000000' END AS colorhash FROM p""")
def raster_crops(spark, t):
    from ..functions.hashing import blank_signature

    keys, draw = _rasters(t)
    r = R.page_facts(keys, ["doc_id"], opened=draw)
    blank = blank_signature(F.col("phash"), F.col("colorhash"))
    trimmed, focused = P.kept_crops(F.when(F.col("doc_id") % 5 == 0, "docx").otherwise("xlsx"), blank, F.col("trimmed"), F.col("focused"))
    return r.select("doc_id", trimmed["crop_height"].alias("crop_height"), trimmed["removed_percent"].alias("trimmed_percent"), F.array_join(focused["crop_box"], ",").alias("box"), blank.alias("blank"), "colorhash")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def stream_job_state(spark, t):
    """The batch side of the streaming operator; tests run it as a stream and compare."""
    got = counts_by_window(t("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status")))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "status", "n")
