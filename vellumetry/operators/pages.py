"""Documents as page rows: limits, joins by position, blanks, aggregates, planning arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lookups import FOCUSABLE, SAMPLE_EXTENSIONS, SAMPLE_MIME

MAX_PAGES, MIN_BLANK = 50, 20
#: Rows of pages that one task sorts, about 100 bytes each.
TASK_ROWS = 500_000


def paginate(docs: DataFrame) -> DataFrame:
    """One row a line: doc_id, page (from 1), line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("page"), "line")


def is_blank_line(line: Column, least: int = MIN_BLANK) -> Column:
    return F.length(F.trim(line)) < least


def summary(docs: DataFrame, max_pages: int = MAX_PAGES, skip_blanks: bool = True) -> DataFrame:
    """Per document: pages, rendered pages, skipped blanks, whether pages were cut off.

    One pass without a shuffle: a document's lines are an array of its row."""
    lines = F.split("text", "\n", -1)
    kept = F.slice(lines, 1, max_pages)
    blanks = F.size(F.filter(kept, lambda line: is_blank_line(line)))
    return docs.select(
        "doc_id",
        F.size(lines).cast("long").alias("page_count_total"),
        (F.size(kept) - (blanks if skip_blanks else F.lit(0))).cast("long").alias("page_count_rendered"),
        (blanks if skip_blanks else F.lit(0)).cast("long").alias("blank_pages_skipped"),
        (F.size(lines) > max_pages).alias("truncated"),
    )


def limited(pages: DataFrame, max_pages: int) -> DataFrame:
    return pages.where(F.col("page") <= max_pages)


def without_blanks(pages: DataFrame, blanks: DataFrame) -> DataFrame:
    """Anti-join on (doc_id, page)."""
    return pages.join(blanks, ["doc_id", "page"], "left_anti")


def reassembled(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): each key's values in the order of ``order``, ties by value."""
    got = F.sort_array(F.collect_list(F.struct(order, value)))
    return rows.groupBy(key).agg(F.transform(got, lambda s: s[value]).alias("values"))


def largest_of_each(files: DataFrame, keys: list[str], size: str, ties: list[str]) -> DataFrame:
    """One file of each index: the largest, of equal ones the first by ``ties``.

    An aggregate with partial results on the map side, not a window, so no group is held in memory."""
    rest = [c for c in files.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(size), *[-F.col(t) for t in ties]))
    return files.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def aligned_sheets(pages: DataFrame, sheets: DataFrame) -> DataFrame:
    """pages (doc_id, page) with sheet_name: the i-th visible sheet belongs to page i, else null.

    sheets has doc_id and ``sheets``, an array of (name, state, type) in order."""
    shown = F.filter("sheets", visible_sheet)
    named = sheets.select("doc_id", F.posexplode(shown).alias("pos", "s")).select("doc_id", (F.col("pos") + 1).alias("page"), F.col("s")["name"].alias("sheet_name"))
    return pages.join(named, ["doc_id", "page"], "left")


def visible_sheet(s: Column) -> Column:
    return (s["state"] == "visible") & (s["type"] != "macro")


def other_sheets(sheets: Column) -> Column:
    """Names of the sheets that are not rendered, at most 255 characters each."""
    return F.transform(F.filter(sheets, lambda s: ~visible_sheet(s)), lambda s: F.substring(s["name"], 1, 255))


def mm(points: Column) -> Column:
    return F.bround(points / 72 * 25.4, 2)


def peak_mb(width_mm: Column, height_mm: Column, dpi: Column, cap_px: int = 0) -> Column:
    """Raster memory of one page: four bytes a pixel."""
    px = (width_mm / 25.4 * dpi) * (height_mm / 25.4 * dpi)
    return (F.least(px, F.lit(float(cap_px))) if cap_px else px) * 4 / 1048576


def effective_dpi(dpi: int, peak_px: Column, max_px: int) -> Column:
    """Lowered, never raised, so that the largest page stays within the budget; at least 36."""
    lower = F.greatest(F.lit(36), F.floor(dpi * F.sqrt(F.lit(float(max_px)) / peak_px)).cast("int"))
    return F.when(peak_px > max_px, F.least(lower, F.lit(dpi))).otherwise(F.lit(dpi)).cast("int")


def max_page_px(memory_gb: Column, override: Column | None = None) -> Column:
    """Pixels of the largest page: a positive override within its bounds, else an eighth of the memory at four
    bytes a pixel. Memory of 0, which is what a malformed figure is read as, counts as 4 GB."""
    memory = F.when(memory_gb > 0, memory_gb).otherwise(4.0)
    derived = F.least(F.lit(2e8), F.lit(1e8), F.greatest(F.lit(1e6), F.floor(memory * (1024**3) / 8 / 4)))
    if override is None:
        return derived.cast("long")
    own = override.try_cast("long")
    return F.when(own > 0, F.least(F.lit(200_000_000), F.greatest(F.lit(1_000_000), own))).otherwise(derived).cast("long")


def concurrent_ops(memory_gb: Column, peak: Column) -> Column:
    n = F.floor(0.5 * memory_gb * 1024 / F.greatest(F.lit(200.0), peak))
    return F.greatest(F.lit(1), F.least(n, F.lit(8))).cast("int")


def shard_count(pages: Column, cpus: int, by_memory: int) -> Column:
    n = F.least(F.lit(max(1, cpus // 2)), F.lit(by_memory), pages)
    return F.when((pages < 4) | (n <= 1), F.lit(1)).otherwise(n).cast("int")


def shard_ranges(docs: DataFrame, pages: str, cpus: int, by_memory: int) -> DataFrame:
    """(doc_id, shard, first, last): pages in even ranges, the last takes the rest; under four pages, one."""
    n = shard_count(F.col(pages), cpus, by_memory)
    each = F.floor(F.col(pages) / F.col("n")).cast("int")
    out = docs.where(F.col(pages) >= 1).withColumn("n", n).select("doc_id", pages, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shard"))
    last = F.when(F.col("shard") == F.col("n") - 1, F.col(pages).cast("int")).otherwise((F.col("shard") + 1) * each)
    return out.select("doc_id", "shard", (F.col("shard") * each + 1).alias("first"), last.alias("last"))


def document_peak_mb(pages: DataFrame, dpi: int, cap_px: int = 0) -> DataFrame:
    """(doc_id, peak_mb): the raster memory of each document's largest page."""
    return pages.groupBy("doc_id").agg(F.max(peak_mb(F.col("width_mm"), F.col("height_mm"), F.lit(dpi), cap_px)).alias("peak_mb"))


def shard_dpi(pages: DataFrame, shards: DataFrame, dpi: int, max_px: int) -> DataFrame:
    """(doc_id, shard, first, last, dpi): the resolution of each range, lowered for its own largest page only.

    pages has doc_id, page, width_mm and height_mm; shards are those of ``shard_ranges``."""
    px = F.col("width_mm") / 25.4 * dpi * (F.col("height_mm") / 25.4 * dpi)
    sized = pages.select("doc_id", "page", px.alias("px"))
    met = shards.join(sized, "doc_id").where((F.col("page") >= F.col("first")) & (F.col("page") <= F.col("last")))
    peak = met.groupBy("doc_id", "shard").agg(F.max("px").alias("peak"))
    out = shards.join(peak, ["doc_id", "shard"], "left")
    return out.select("doc_id", "shard", "first", "last", effective_dpi(dpi, F.coalesce("peak", F.lit(0.0)), max_px).alias("dpi"))


def sharded_dpi(lines: DataFrame, order: list[str], dpi: int, max_px: int, cpus: int, by_memory: int, rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, shard, first, last, dpi, peak_mb): what ``shard_ranges``, ``shard_dpi`` and ``document_peak_mb`` give for
    pages that are numbered by ``order``, with one shuffle and one sort.

    lines has doc_id, width_mm, height_mm and the columns of order. A document's pages meet in one array, so nothing
    is joined; the rows are dealt into so many partitions that a task has about ``rows`` of them, however many there are."""
    partitions = max(lines.sparkSession.sparkContext.defaultParallelism, lines.count() // rows + 1)
    px = F.col("width_mm") / 25.4 * dpi * (F.col("height_mm") / 25.4 * dpi)
    peak = peak_mb(F.col("width_mm"), F.col("height_mm"), F.lit(dpi), max_px)
    page = F.struct(*order, px.alias("px"), peak.alias("mb"))
    docs = lines.select("doc_id", page.alias("p")).repartition(partitions, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    docs = docs.select("doc_id", F.col("p.px").alias("px"), F.array_max("p.mb").alias("peak_mb")).withColumn("pages", F.size("px"))
    docs = docs.withColumn("n", shard_count(F.col("pages"), cpus, by_memory)).withColumn("each", F.floor(F.col("pages") / F.col("n")).cast("int"))
    shards = docs.select("doc_id", "px", "peak_mb", "pages", "n", "each", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shard"))
    shards = shards.withColumn("first", F.col("shard") * F.col("each") + 1).withColumn("last", F.when(F.col("shard") == F.col("n") - 1, F.col("pages")).otherwise((F.col("shard") + 1) * F.col("each")))
    own = F.array_max(F.slice("px", F.col("first"), F.col("last") - F.col("first") + 1))
    return shards.select("doc_id", "shard", "first", "last", effective_dpi(dpi, F.coalesce(own, F.lit(0.0)), max_px).alias("dpi"), "peak_mb")


def clamp_warnings(pages: DataFrame, dpi: int) -> DataFrame:
    """Per document the pages whose resolution fell below 95 % of what was asked."""
    eff = F.col("width_px") * 25.4 / F.col("width_mm")
    low = pages.where((F.col("width_mm") > 0) & (eff < 0.95 * dpi)).select("doc_id", "page", F.bround(eff).cast("int").alias("effective_dpi"))
    return low.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "effective_dpi"))).alias("pages"))


def image_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count_if(F.col("image_count") > 0).alias("image_page_count"), F.sum("image_count").alias("total_image_count"))


def too_large(pages: DataFrame, max_w: int, max_h: int) -> DataFrame:
    """Per document whether any page breaks the dimension limit."""
    return pages.groupBy("doc_id").agg(F.bool_or((F.col("width_px") > max_w) | (F.col("height_px") > max_h)).alias("failed"))


def best_image(original: Column, trimmed: Column, focused: Column) -> Column:
    return F.coalesce(focused, trimmed, original)


def artifacts(pages: DataFrame) -> DataFrame:
    """(doc_id, artifact, file): ids of the page images that exist, and nothing for those that do not.

    pages has doc_id, page, file, trimmed_file and focused_file."""
    p = F.concat(F.lit("p"), F.col("page").cast("string"))
    made = F.array_compact(F.array(
        F.struct(p.alias("artifact"), F.col("file").alias("file")),
        F.when(F.col("trimmed_file").isNotNull(), F.struct(F.concat(p, F.lit("-trimmed")).alias("artifact"), F.col("trimmed_file").alias("file"))),
        F.when(F.col("focused_file").isNotNull(), F.struct(F.concat(p, F.lit("-focused")).alias("artifact"), F.col("focused_file").alias("file"))),
    ))
    return pages.select("doc_id", F.explode(made).alias("a")).select("doc_id", "a.*")


def kept_crops(label: Column, blank: Column, trimmed: Column, focused: Column) -> tuple[Column, Column]:
    """(trimmed, focused): a blank page keeps neither crop, and only sheets are focused."""
    shown = ~F.coalesce(blank, F.lit(False))
    return F.when(shown, trimmed), F.when(shown & label.isin(FOCUSABLE), focused)


def by_position(pages: DataFrame, *facts: DataFrame) -> DataFrame:
    """The pages with the columns of each table of facts, by doc_id and page; the i-th row of facts is page i's.

    Facts have doc_id, page (from 1, without gaps) and columns of their own, which are null for a page beyond them;
    facts beyond the pages are left out."""
    for f in facts:
        pages = pages.join(f, ["doc_id", "page"], "left")
    return pages


def wanted(files: DataFrame) -> DataFrame:
    """The files of wanted extensions whose media type is one that such files can have."""
    mime = F.col("mime")
    fits = F.lit(False)
    for p in SAMPLE_MIME:
        fits = fits | F.startswith(mime, F.lit(p))
    return files.where(F.col("ext").isin(SAMPLE_EXTENSIONS) & F.coalesce(fits, F.lit(False)))


def sampled(files: DataFrame, per_extension: int) -> DataFrame:
    """The first N files of each extension by path.

    Partial top-N inside salts comes first, so one common extension is not ranked in a single task."""
    salted = Window.partitionBy("ext", "salt").orderBy("path", "file_id")
    some = files.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(64))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= per_extension)
    final = Window.partitionBy("ext").orderBy("path", "file_id")
    return some.withColumn("r", F.row_number().over(final)).where(F.col("r") <= per_extension).drop("salt")
