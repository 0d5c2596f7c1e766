"""Style inheritance: what each element of a page looks like, in legacy attribute terms, and the page with these put in.

A small parser gives the start tags as rows, with the places of their tags in the source and the element
they stand in. What an element is declared to be comes from joins with the style blocks: by tag, by class, by tag and
class, then by its own style attribute. An inherited property is that of the nearest element around it that sets
it; a background is not inherited. The page is then spliced: only tags that change are written anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import css_background, declarations, inherited_props
from .arrow import packed, rows

#: Elements that hold inherited values, that take bgcolor, align, and text decoration.
CONTAINERS = ["table", "tr", "td", "th", "div", "p", "span"]
BACKGROUND_ON = ["table", "td", "th", "tr"]
ALIGN_ON = ["td", "th", "p", "div"]
TEXT_ON = ["td", "th", "div", "p", "span"]
#: What is handed down, by the names of ``inherited_props``.
HANDED_DOWN = ["align", "color", "family", "size", "weight", "decoration"]


class _Tags(HTMLParser):
    """Start tags and style blocks with their places, counted in code points."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.rows, self.open, self.block = text, [], [], None
        self.lines = [0]
        for i, c in enumerate(text):
            if c == "\n":
                self.lines.append(i + 1)

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs, closed=False):
        start = self.here()
        if tag == "style" and not closed:
            self.block = start
            return
        given = {k: v or "" for k, v in attrs}
        around = self.open[-1] if self.open else None
        pos = len(self.rows)
        self.rows.append({"pos": pos, "tag": tag, "around": around, "start": start, "stop": start + len(self.get_starttag_text()), "close": None, "closed": closed, "names": list(given), "given": list(given.values())})
        if tag in CONTAINERS and not closed:
            self.open.append(pos)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag):
        if tag == "style":
            end = self.text.find(">", self.here())
            self._drop(len(self.text) if end < 0 else end + 1)
        elif tag in CONTAINERS and self.open:
            self.rows[self.open.pop()]["close"] = self.here()

    def _drop(self, stop: int) -> None:
        if self.block is not None:
            self.rows.append({"pos": len(self.rows), "tag": "style", "around": None, "start": self.block, "stop": stop, "close": stop, "closed": True, "names": [], "given": []})
            self.block = None

    def read(self) -> list[dict]:
        try:
            self.feed(self.text)
            self.close()
        except AssertionError:  # markup that the parser gives up on: such a page stays as it is
            return []
        self._drop(len(self.text))
        return self.rows


_SCHEMA = "doc_id long, pos int, tag string, around int, start int, stop int, close int, closed boolean, names array<string>, given array<string>"


def elements(html: DataFrame) -> DataFrame:
    """(doc_id, pos, tag, around, start, stop, close, closed, names, given) of every start tag and style block.

    around is the innermost open container; close is where the end tag that ends it begins; names and given are
    the attributes. A style block is one row from its start tag to its end."""

    columns = [c.split()[0] for c in _SCHEMA.split(", ")][1:]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(((doc_id, *(e[c] for c in columns)) for doc_id, text in rows(batches) for e in _Tags(text or "").read()), _SCHEMA)

    return html.select("doc_id", "html").mapInArrow(read, _SCHEMA)


def own_styles(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``styled``, the style of each element itself: its own declarations over those of the style blocks.

    rules has doc_id, selector, prop, value and at, as css_rules gives them; a document's are one map, so an element is
    joined once and its style is made within its row. In a document without rules a style attribute stays as it is
    written; else all is written again, each property where it first came."""
    tag = F.col("tag")
    inline = F.coalesce(F.try_element_at("given", F.nullif(F.array_position("names", "style"), F.lit(0)).cast("int")), F.lit(""))
    classes = F.split(F.trim(F.regexp_replace(F.coalesce(F.try_element_at("given", F.nullif(F.array_position("names", "class"), F.lit(0)).cast("int")), F.lit("")), r"\s+", " ")), " ")
    found = found.withColumns({"inline": inline, "classes": F.filter(classes, lambda c: c != "")})
    sheets = rules.groupBy("doc_id", "selector").agg(F.collect_list(F.struct("at", "prop", "value")).alias("set"))
    sheets = sheets.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("selector", "set"))).alias("sheet"))
    by_class = F.flatten(F.transform("classes", lambda c: F.array(F.concat(F.lit("."), c), F.concat(tag, F.lit("."), c))))
    none = F.array().cast(sheets.select(F.map_values("sheet")[0].alias("x")).schema["x"].dataType)

    def placed(rank: Column, at: Column, prop: Column, value: Column) -> Column:
        return F.struct(rank.cast("int").alias("rank"), at.alias("at"), prop.alias("prop"), value.alias("value"))

    listed = F.flatten(F.transform(F.concat(F.array(tag), by_class), lambda s, i: F.transform(F.coalesce(F.try_element_at("sheet", s), none), lambda x: placed(i, x["at"], x["prop"], x["value"]))))
    last = F.struct(F.lit(0).alias("b"), F.lit(0).alias("r"), F.lit(0).alias("i"))
    own = F.when(F.col("inline") != "", F.transform(F.map_entries(declarations(F.col("inline"))), lambda d, i: placed(1_000_000 + i, last, d["key"], d["value"])))
    both = found.join(sheets, "doc_id", "left").withColumn("all", F.when(F.col("sheet").isNotNull(), F.array_sort(F.concat(listed, F.coalesce(own, F.array().cast("array<struct<rank:int,at:struct<b:int,r:int,i:int>,prop:string,value:string>>"))))))
    # In order of place: a property stands where it is first set, with the value that is set last.
    value = lambda p: F.element_at(F.filter("all", lambda d: d["prop"] == p), -1)["value"]
    whole = F.array_join(F.transform(F.array_distinct(F.transform("all", lambda d: d["prop"])), lambda p: F.concat(p, F.lit(":"), value(p))), "; ")
    return both.select(*found.columns, F.when(F.col("sheet").isNotNull(), whole).otherwise(F.col("inline")).alias("styled"))


def effective(html: DataFrame, rules: DataFrame) -> DataFrame:
    """The elements with ``styled``, ``background`` and what each has of HANDED_DOWN, its own or handed down."""
    own = own_styles(elements(html), rules)
    props = inherited_props(F.col("styled"))
    own = own.withColumns({"background": css_background(F.col("styled")), **{k: F.nullif(props[k], F.lit("")) for k in HANDED_DOWN}})

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents one after the other, elements in order, so what is around an element is known before it."""
        doc, seen = object(), {}
        for batch in batches:
            docs, places, around = (batch.column(c).to_pylist() for c in ("doc_id", "pos", "around"))
            given = list(zip(*(batch.column(k).to_pylist() for k in HANDED_DOWN)))
            out = []
            for d, pos, a, values in zip(docs, places, around, given):
                if d != doc:
                    doc, seen = d, {}
                if a is not None:
                    values = tuple(o if v is None else v for v, o in zip(values, seen[a]))
                seen[pos] = values
                out.append(values)
            for k, column in zip(HANDED_DOWN, zip(*out)):
                batch = batch.set_column(batch.schema.get_field_index(k), k, pa.array(column, pa.string()))
            yield batch

    return own.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(hand_down, own.schema)


def _added(found: DataFrame) -> DataFrame:
    """The elements with bgcolor, align, color, face, size, bold and underline, null or false where they get none."""
    text = F.col("tag").isin(TEXT_ON) & ~F.col("closed")

    def missing(name: str) -> Column:
        return ~F.array_contains("names", name)

    return found.withColumns({
        "bgcolor": F.when(F.col("tag").isin(BACKGROUND_ON) & missing("bgcolor"), F.col("background")),
        "align": F.when(F.col("tag").isin(ALIGN_ON) & missing("align"), F.col("align")),
        "color": F.when(text, F.col("color")),
        "face": F.when(text, F.col("family")),
        "size": F.when(text, F.col("size")),
        "bold": F.coalesce(text & (F.col("weight") == "bold"), F.lit(False)),
        "underline": F.coalesce(text & (F.col("decoration") == "underline"), F.lit(False)),
    })


def legacy_attributes(html: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, pos, tag, bgcolor, align, color, face, size, bold, underline) of elements that get any."""
    shown = _added(effective(html, rules)).select("doc_id", "pos", "tag", "bgcolor", "align", "color", "face", "size", "bold", "underline")
    return shown.where("bgcolor is not null or align is not null or color is not null or face is not null or size is not null or bold or underline")


def inject(html: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, html) with the computed attributes in the tags and legacy elements round the text.

    Style blocks are left out, as what they say is in the tags. Every tag that gets nothing, and all between
    tags, is byte for byte as it was."""
    every = _added(effective(html, rules))
    escaped = lambda c: F.replace(c, F.lit('"'), F.lit("&quot;"))
    # Attributes in their order, a new style in the old one's place, what is added behind.
    styled = F.when((F.col("styled") != "") & (F.col("styled") != F.col("inline")), F.col("styled"))
    given = F.zip_with("names", "given", lambda n, v: F.struct(n.alias("name"), F.when(n == "style", F.coalesce(styled, v)).otherwise(v).alias("value")))
    more = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("name"), F.col(c).alias("value"))) for c in ("bgcolor", "align")]
    more.append(F.when(~F.array_contains("names", "style") & styled.isNotNull(), F.struct(F.lit("style").alias("name"), styled.alias("value"))))
    attributes = F.concat(given, F.array_compact(F.array(*more)))
    parts = F.transform(attributes, lambda a: F.when(a["value"] == "", F.concat(F.lit(" "), a["name"])).otherwise(F.concat(F.lit(" "), a["name"], F.lit('="'), escaped(a["value"]), F.lit('"'))))
    tag = F.concat(F.lit("<"), F.col("tag"), F.array_join(parts, ""), F.when(F.col("closed"), " />").otherwise(">"))
    changed = F.col("bgcolor").isNotNull() | F.col("align").isNotNull() | styled.isNotNull()
    font = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {c}="'), F.col(c), F.lit('"'))) for c in ("color", "face", "size")])), "")
    fonts = F.col("color").isNotNull() | F.col("face").isNotNull() | F.col("size").isNotNull()
    opened = F.concat(F.when(fonts, F.concat(F.lit("<font"), font, F.lit(">"))).otherwise(""), F.when(F.col("bold"), "<b>").otherwise(""), F.when(F.col("underline"), "<u>").otherwise(""))
    shut = F.concat(F.when(F.col("underline"), "</u>").otherwise(""), F.when(F.col("bold"), "</b>").otherwise(""), F.when(fonts, "</font>").otherwise(""))
    block = (F.col("tag") == "style") & F.col("close").isNotNull()
    edits = F.array(
        F.when(block, F.struct("start", F.col("stop").alias("end"), F.lit("").alias("text"))).when(changed, F.struct("start", F.col("stop").alias("end"), tag.alias("text"))),
        F.when(opened != "", F.struct(F.col("stop").alias("start"), F.col("stop").alias("end"), opened.alias("text"))),
        F.when((shut != "") & F.col("close").isNotNull(), F.struct(F.col("close").alias("start"), F.col("close").alias("end"), shut.alias("text"))),
    )
    lists = every.select("doc_id", "pos", F.posexplode(edits).alias("k", "e")).where("e is not null").groupBy("doc_id").agg(F.collect_list(F.struct("e.start", "e.end", "pos", "k", "e.text")).alias("edits"))

    def spliced(text: str | None, edits: list[dict] | None) -> str | None:
        out, at = [], 0
        for e in sorted(edits or (), key=lambda e: (e["start"], e["end"], e["pos"], e["k"])):
            out += [text[at : e["start"]], e["text"]]
            at = e["end"]
        return text if text is None else "".join([*out, text[at:]])

    schema = "doc_id long, html string"

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(((doc_id, spliced(text, edits)) for doc_id, text, edits in rows(batches)), schema)

    return html.select("doc_id", "html").join(lists, "doc_id", "left").mapInArrow(splice, schema)
