"""Attempt chains, options and legacy markup: rules by hand, and a streaming rewriter to compare with."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from vellumetry.operators import attempts as A
from vellumetry.operators import cascade, containers
from vellumetry.operators import plans as P
from vellumetry.functions import text as T


def column(spark, rule, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


def test_families_decide_names_and_filters(spark):
    rows = [("docx", "doc"), ("pptx", "ppt"), ("xlsx", "xls"), ("docx", "dotm"), ("pptx", "ppsx"), ("xlsb", "xlsx"), ("csv", "txt"), ("xps", "oxps"), ("mht", "mht"), ("zip", "zip"), ("docx", None)]
    got = spark.createDataFrame(rows, "label string, ext string").select(F.coalesce(A.needs_rename(F.col("label"), F.col("ext")), F.lit(False)).alias("x")).collect()
    assert [r.x for r in got] == [True, True, True, False, False, True, False, True, False, False, False]
    page = 'calc_pdf_Export:{"SinglePageSheets":{"type":"boolean","value":"true"}}'
    want = [[page, "calc_pdf_Export", "writer_pdf_Export"], ["impress_pdf_Export", "writer_pdf_Export"], ["draw_pdf_Export", "writer_pdf_Export"], ["writer_pdf_Export"]]
    assert column(spark, A.filters_to_try, ["XLSX", "pptx", "odg", "md"]) == want


OUTCOME = "array<struct<seconds:double,killed:boolean,exit_code:int,stderr:string,made:boolean>>"
LOST, CRASH, KILLED, NOTHING, DONE = (5.0, False, 1, "Source File could not be loaded", False), (5.0, False, 3, "crash", False), (70.0, True, 0, None, False), (5.0, False, 0, "", False), (1.0, False, 0, "", True)


@pytest.mark.parametrize(
    "label,ext,prepared,preserve,outcomes,want",
    [
        ("docx", "doc", "a.docx", False, [LOST, DONE], (True, "writer_pdf_Export", "a.doc", 2, 6.0, None)),  # once more under the original name
        ("docx", "doc", "a.docx", False, [CRASH, DONE], (False, None, None, 1, 5.0, "soffice exited 3: crash")),  # only for that message
        ("docx", "doc", "a.docx", False, [(70.0, False, 1, LOST[3], False), DONE], (False, None, None, 1, 70.0, "soffice exited 1: " + LOST[3])),  # not after the deadline
        ("pptx", "ppt", "a.pptx", False, [CRASH, DONE, DONE], (True, "writer_pdf_Export", "a.ppt", 2, 6.0, None)),  # later steps take the original
        ("pptx", "ppt", "a.html", True, [LOST, DONE], (True, "writer_pdf_Export", "a.html", 2, 6.0, None)),  # unless only the rewritten form may be exported
        ("xlsx", "xlsx", "a.xlsx", False, [KILLED, DONE, DONE], (False, None, None, 1, 70.0, "soffice killed (timeout?): ")),  # the deadline is for all
        ("xlsx", "xlsx", "a.xlsx", False, [NOTHING, CRASH, DONE], (True, "writer_pdf_Export", "a.xlsx", 3, 11.0, None)),
        ("odg", "odg", "a.odg", False, [NOTHING, NOTHING], (False, None, None, 2, 10.0, "soffice produced no PDF")),
        ("odg", "odg", "a.odg", False, [], (False, None, None, 0, 0.0, "conversion failed")),
    ],
)
def test_chains(spark, label, ext, prepared, preserve, outcomes, want):
    rows = spark.createDataFrame([(label, ext, prepared, preserve, outcomes)], f"label string, ext string, prepared string, preserve boolean, outcomes {OUTCOME}")
    planned = A.planned_attempts(F.col("label"), F.col("ext"), F.concat(F.lit("a."), "ext"), F.col("prepared"), F.col("preserve"))
    r = rows.select(A.run_chain(planned, F.col("outcomes"), 60).alias("r")).first().r
    assert (r.ok, r.filter, r.name, r.tried, r.elapsed, r.error) == want
    assert r.error_class == (None if r.ok else "empty_output" if "no PDF" in r.error else "error")


def test_options(spark):
    raw = ["5", " +7 ", "-3", "99999999999", "-99999999999", "1_0", "1__0", "_1", "x", "", None, "1.5", "0" * 20 + "9", "9" * 4301, "\x1f8\n"]
    assert column(spark, lambda x: P.option_clamp(x, 10, 1, 120), raw) == [5, 7, 1, 120, 1, 10, 10, 10, 10, 10, 10, 10, 9, 10, 8]
    assert column(spark, lambda x: P.option_flag(x, True), [None, "", " YES\n", "on", "0", "truth"]) == [True, False, True, True, False, False]
    assert column(spark, lambda x: P.option_text(x, P.FORMATS, "d"), ["a_1,b", "a,", " a ", "A", None, "a\nb"]) == ["a_1,b", "d", "a", "d", "d", "d"]
    none = spark.range(1).select(P.convert_options(F.create_map().cast("map<string,string>"), F.lit(0)).alias("o")).first().o
    assert tuple(none) == (1, True, "qr_code,micro_qr_code,rmqr_code", 10, False, False, "eng+Latin", 3, 60)


def test_pieces_outside_quotes(spark):
    got = column(spark, lambda x: T.split_unquoted(x, ";"), ["a;b", "a;", ";a", "", "'a;b';c", '"a;\'b";c', "a'b;c", '""', None])
    assert got == [["a", "b"], ["a"], ["", "a"], [], ["'a;b'", "c"], ['"a;\'b"', "c"], ["a'b;c"], ['""'], None]
    styles = ['font-family:"A; B:c", x ; Color : red;color:blue', "a:'1;2';b:\"", "x", "a: ;:b"]
    assert column(spark, T.declarations, styles) == [{"font-family": '"A; B:c", x', "color": "blue"}, {"a": "'1;2'", "b": '"'}, {}, {}]
    family = T.inherited_props(F.col("x"))["family"]
    assert column(spark, lambda _: family, ["font-family:'Arial, Helvetica', b", "FONT-FAMILY : Times,b", "color:red"]) == ["Arial, Helvetica", "Times", None]
    weight = T.inherited_props(F.col("x"))["weight"]
    assert column(spark, lambda _: weight, ["font-weight:600", "font-weight:599", "font-weight:lighter", "font-weight:bolder", "font-weight:inherit"]) == ["bold", "normal", "normal", "bold", None]


class Rewriter(HTMLParser):
    """The same rules as a stream of output, tag after tag."""

    def __init__(self, text, rules):
        super().__init__(convert_charrefs=False)
        self.source, self.rules, self.out, self.stack, self.quiet = text, rules, [], [], False
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.at = 0

    def here(self):
        return self.starts[self.getpos()[0] - 1] + self.getpos()[1]

    def copy(self, upto):
        if not self.quiet:
            self.out.append(self.source[self.at : upto])
        self.at = upto

    def style_of(self, tag, given):
        if not self.rules:
            return given.get("style", "")
        base = dict(self.rules.get(tag, {}))
        for c in given.get("class", "").split():
            base.update(self.rules.get(f".{c}", {}))
            base.update(self.rules.get(f"{tag}.{c}", {}))
        base.update(declared(given.get("style", "")))
        return "; ".join(f"{k}:{v}" for k, v in base.items())

    def handle_starttag(self, tag, attrs, closed=False):
        here = self.here()
        self.copy(here)
        if tag == "style" and not closed:
            self.quiet = True
            return
        given = {k: v or "" for k, v in attrs}
        style = self.style_of(tag, given)
        own = props(style)
        now = {k: own.get(k) or (self.stack[-1][0][k] if self.stack else None) for k in ("align", "color", "family", "size", "weight", "decoration")}
        new = dict(given)
        ground = re.search(r"(?i)background(?:-color)?\s*:\s*([^;]+)", style)
        if tag in ("table", "td", "th", "tr") and "bgcolor" not in given and ground:
            new["bgcolor"] = bare(ground[1])
        if tag in ("td", "th", "p", "div") and "align" not in given and now["align"]:
            new["align"] = now["align"]
        if style and style != given.get("style"):
            new["style"] = style
        raw = self.get_starttag_text()
        if new != given:
            raw = f"<{tag}" + "".join(f" {k}" if v == "" else ' {}="{}"'.format(k, v.replace('"', "&quot;")) for k, v in new.items()) + (" />" if closed else ">")
        self.out.append(raw)
        self.at = here + len(self.get_starttag_text())
        if closed:
            return
        shut = ""
        if tag in ("td", "th", "div", "p", "span"):
            font = "".join(f' {k}="{now[v]}"' for k, v in (("color", "color"), ("face", "family"), ("size", "size")) if now[v])
            for on, name, more in ((font, "font", font), (now["weight"] == "bold", "b", ""), (now["decoration"] == "underline", "u", "")):
                if on:
                    self.out.append(f"<{name}{more}>")
                    shut = f"</{name}>" + shut
        if tag in ("table", "tr", "td", "th", "div", "p", "span"):
            self.stack.append((now, shut))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        here = self.here()
        self.copy(here)
        if tag == "style":
            self.at, self.quiet = self.source.find(">", here) + 1, False
        elif tag in ("table", "tr", "td", "th", "div", "p", "span") and self.stack:
            self.out.append(self.stack.pop()[1])

    def done(self):
        self.feed(self.source)
        self.close()
        self.copy(len(self.source))
        return "".join(self.out)


def bare(v):
    v = v.strip().strip('"').strip("'")
    return re.sub("^#(.)(.)(.)$", r"#\1\1\2\2\3\3", v) if re.fullmatch("#[0-9a-fA-F]{3}", v) else v


def split(text, sep):
    return re.findall(rf"""(?:"[^"]*(?:"|$)|'[^']*(?:'|$)|[^{sep}"'])+""", text)


def declared(style):
    out = {}
    for d in split(style, ";"):
        name, colon, value = d.partition(":")
        if colon and name.strip() and value.strip():
            out[name.strip().lower()] = value.strip()
    return out


def props(style):
    def get(name):
        m = re.search(rf"(?i){name}\s*:\s*([^;]+)", style)
        return m[1] if m else None

    out = {"align": re.search(r"(?i)text-align\s*:\s*(center|left|right|justify)", style)}
    out["align"] = out["align"][1].lower() if out["align"] else None
    out["color"] = bare(get("(?<!-)color")) if get("(?<!-)color") else None
    family = split(get("font-family") or "", ",")
    out["family"] = bare(family[0]) if family else None
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*(px|pc|pt)?", (get("font-size") or "").strip().lower())
    if m:
        pt = float(m[1]) * {"px": 0.75, "pc": 12}.get(m[2], 1)
        out["size"] = str(1 + sum(pt >= x for x in (9, 11, 13.5, 16.5, 21, 30)))
    w = bare(get("font-weight") or "").lower()
    out["weight"] = "bold" if w in ("bold", "bolder") or (w.isdigit() and int(w) >= 600) else "normal" if w in ("normal", "lighter") or w.isdigit() else None
    line = (get("text-decoration") or "").lower()
    out["decoration"] = "underline" if "underline" in line else "none" if "none" in line else None
    return out


def rules_of(text):
    out = {}
    for css in re.findall(r"(?is)<style[^>]*>(.*?)</style>", text):
        for rule in re.sub(r"(?s)/\*.*?\*/", "", css).split("}"):
            names, brace, body = rule.partition("{")
            for name in names.split(",") if brace and declared(body) else ():
                m = re.fullmatch(r"([a-zA-Z][a-zA-Z0-9]*)?(?:\.([A-Za-z_][\w-]*))?", name.strip())
                if m and name.strip():
                    out.setdefault((m[1] or "").lower() + (f".{m[2]}" if m[2] else ""), {}).update(declared(body))
    return out


PAGES = [
    "", "no markup & nothing", "<p>plain</p>", '<table style="text-align:center"><tr><td>a<td>b</table>', '<td style="background:#abc;color:red">x</td>',
    '<style>P.k, .z{color:#0f0;font-family:"A, B",C} @media x{p{color:red}} p:hover{x:y} p{font-weight:700}</style><p class="k z" style=\'Font-Size:12px\'>a<b>c</b></p><p>d',
    '<div style="font-weight:bold;text-decoration:underline"><p style="font-weight:normal">a<span>b</span></p><p>c</p></div>', '<P ALIGN=left STYLE="text-align:right">q</P>', '<td bgcolor="#1" style="background-color: \'red\'"/>',
    "<style>p{color:red", "<style>p{color:red}</style>text<p>\n<br/>\n<img src='a>b'>\n</p></p></p>", '<p style="color:a;color:b">x</p>', '<style></style><p style="color:a;color:b" title="say &quot;hi&quot;">x</p>',
    "<!-- <p style='color:red'> --><script>'<p style=\"color:red\">'</script><p>x</p>&amp;&#65;", "<style>td{background:''}</style><td>x</td>", "<style>p{a:b}</style><p style='x'>y</p><!DOCTYPE html>", "é\U0001f600<p style='color:é'>\U0001f600</p>", None,
]


def test_markup_is_that_of_a_streaming_rewriter(spark, sf_dir):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "doc_id long, html string")
    more = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") + 1000).alias("doc_id"), "html").limit(60)
    pages = pages.unionByName(more)
    texts = {r.doc_id: r.html for r in pages.collect()}
    got = {r.doc_id: r.html for r in cascade.inject(pages, containers.css_rules(pages)).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert got[i] == (None if text is None else Rewriter(text, rules_of(text)).done()), (i, text)
    for i in (0, 1, 2, 13):
        assert got[i] == PAGES[i]


def test_deep_nesting_stays_linear(spark):
    """Elements that are never closed, each inside all before it."""
    text = '<div style="color:red">' + "<p>x" * 20_000
    pages = spark.createDataFrame([(1, text)], "doc_id long, html string")
    got = cascade.inject(pages, containers.css_rules(pages)).first().html
    assert got.count('<font color="red">') == 20_001


@pytest.mark.parametrize("name,python", [("style_cascade", 2), ("legacy_html", 3)])
def test_the_cascade_opens_a_page_once(spark, sf_dir, name, python):
    """A page is parsed once, no frame is made for a document, and elements are not exploded into selectors."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == python and "InPandas" not in plan


def test_styles_of_a_row_are_those_of_their_places(spark):
    """A property stands where it is first set and has what is set last: by tag, class, tag and class, attribute."""
    html = spark.createDataFrame([(1, '<p class="b a" style="x:9;z:5">t</p><p>u</p><i style="q:1">v</i>'), (2, '<p style=" q : 1">w</p>')], "doc_id long, html string")
    sheet = spark.createDataFrame([(1, "<style>.a{x:1;y:2} p{y:1;w:0} p.b{w:3;x:4}</style>")], "doc_id long, html string")
    got = cascade.own_styles(cascade.elements(html), containers.css_rules(sheet))
    assert [r.styled for r in got.orderBy("doc_id", "pos").collect()] == ["y:2; w:3; x:9; z:5", "y:1; w:0", "q:1", " q : 1"]
