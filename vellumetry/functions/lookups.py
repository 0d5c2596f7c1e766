"""Fixed values that results depend on, as plain tables and as lookups over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OOXML = "application/vnd.openxmlformats-officedocument."
_ODF = "application/vnd.oasis.opendocument."

#: Media type of each canonical label.
MIME = {
    "docx": _OOXML + "wordprocessingml.document",
    "xlsx": _OOXML + "spreadsheetml.sheet",
    "pptx": _OOXML + "presentationml.presentation",
    "doc": "application/msword",
    "xls": "application/vnd.ms-excel",
    "ppt": "application/vnd.ms-powerpoint",
    "odt": _ODF + "text",
    "ods": _ODF + "spreadsheet",
    "odp": _ODF + "presentation",
    "odg": _ODF + "graphics",
    "rtf": "application/rtf",
    "txt": "text/plain",
    "csv": "text/csv",
    "md": "text/markdown",
    "xps": "application/vnd.ms-xpsdocument",
    "oxps": "application/oxps",
    "xlsb": "application/vnd.ms-excel.sheet.binary.macroEnabled.12",
    "mht": "multipart/related",
}

#: Labels a classifier may give, and what they are called here.
LABELS = {k: k for k in MIME if k != "md"} | {"markdown": "md"}

#: Extensions that are let in, by the label they stand for.
EXTENSIONS_OF = {
    "docx": "docx docm dotx dotm",
    "doc": "doc dot",
    "xlsx": "xlsx xlsm xltx xltm xlam",
    "xlsb": "xlsb",
    "xls": "xls xlt xla",
    "pptx": "pptx pptm ppsx ppsm potx potm ppam",
    "ppt": "ppt pps pot ppa",
    "odt": "odt ott fodt",
    "ods": "ods ots fods",
    "odp": "odp otp fodp",
    "odg": "odg otg fodg",
    "rtf": "rtf",
    "csv": "csv",
    "md": "md markdown",
    "xps": "xps",
    "oxps": "oxps",
    "mht": "mht mhtml",
    "txt": "txt html htm",
}
EXTENSIONS = {ext: label for label, exts in EXTENSIONS_OF.items() for ext in exts.split()}

#: Extensions of formats that carry macros.
MACRO = ["docm", "dotm", "xlsm", "xltm", "xlam", "xlsb", "xla", "pptm", "ppsm", "potm", "ppam", "ppa"]

#: Media types that are text though they do not begin with text/.
TEXT_MIME = [
    "application/json",
    "application/x-powershell",
    "application/x-pem-file",
    "application/javascript",
    "application/xml",
    "application/x-yaml",
    "application/toml",
    "application/x-httpd-php",
    "application/x-sh",
    "application/x-csh",
]

#: What a magic library's media type says about a label, first match wins.
MAGIC = [
    ("presentationml", "pptx"),
    ("wordprocessingml", "docx"),
    ("spreadsheetml", "xlsx"),
    ("vnd.ms-powerpoint", "ppt"),
    ("msword", "doc"),
    ("vnd.ms-excel", "xls"),
    ("text/rtf", "rtf"),
    ("application/rtf", "rtf"),
    ("text/csv", "csv"),
]
RECHECKED = ["docx", "xlsx", "pptx", "doc", "xls", "ppt", "rtf", "txt", "csv"]

#: The export filter's application for each label; writer for the rest.
APPLICATION = {
    "calc": ["xlsx", "xlsm", "xls", "ods", "fods", "csv", "xlsb"],
    "impress": ["pptx", "pptm", "ppt", "pps", "ppsx", "odp", "fodp"],
    "draw": ["odg", "fodg", "xps", "oxps"],
}
TWO_PASS = ["xls", "ods", "fods", "csv", "xlsb"]
FOCUSABLE = ["xlsx", "xlsm", "xls", "xlsb", "ods", "fods", "csv"]

#: Labels and extensions of one family are told apart by their content alone, so a file that is named
#: for another label of its family keeps its name. What is in no family is one of its own.
FAMILIES = {
    "word-ooxml": ["docx", "docm", "dotx", "dotm"],
    "word-ole": ["doc", "dot"],
    "calc-ooxml": ["xlsx", "xlsm", "xltx", "xltm", "xlam"],
    "calc-ole": ["xls", "xlt", "xla"],
    "calc-bin": ["xlsb"],
    "impress-ooxml": ["pptx", "pptm", "ppsx", "ppsm", "potx", "potm", "ppam"],
    "impress-ole": ["ppt", "pps", "pot", "ppa"],
    "rtf": ["rtf"],
    "odf-text": ["odt", "ott", "fodt"],
    "odf-calc": ["ods", "ots", "fods"],
    "odf-impress": ["odp", "otp", "fodp"],
    "odf-draw": ["odg", "otg", "fodg"],
    "text": ["txt", "csv", "md"],
}

#: The export filter that puts each sheet on a page of its own.
ONE_PAGE_SHEETS = 'calc_pdf_Export:{"SinglePageSheets":{"type":"boolean","value":"true"}}'

#: Extensions that are sampled from a corpus, and beginnings of the media types that such files have.
SAMPLE_EXTENSIONS = ["doc", "docx", "docm", "rtf", "txt", "csv", "xls", "xlsx", "xlsm", "xlsb", "ppt", "pptx", "pptm", "pps", "ppsx", "odt", "ods", "odp"]
SAMPLE_MIME = [
    "application/msword",
    "application/vnd.ms-",
    "application/vnd.openxmlformats",
    "application/vnd.oasis.opendocument",
    "application/x-ole",
    "application/CDFV2",
    "application/cdfv2",
    "application/x-cdf",
    "application/zip",
    "application/x-zip",
    "application/octet-stream",
    "text/",
    "application/rtf",
]

#: Barcode format names in plain-text scanner output.
QR_FORMATS = {
    "qrcode": "qr_code",
    "microqrcode": "micro_qr_code",
    "rmqrcode": "rmqr_code",
    "datamatrix": "data_matrix",
    "aztec": "aztec",
    "pdf417": "pdf417",
    "code128": "code128",
    "code39": "code39",
    "code93": "code93",
    "codabar": "codabar",
    "ean13": "ean_13",
    "ean8": "ean_8",
    "upca": "upc_a",
    "upce": "upc_e",
    "itf": "itf",
    "maxicode": "maxi_code",
    "databar": "data_bar",
    "databarexpanded": "data_bar_expanded",
}

#: Sub-document types that may be embedded; True if they can be rendered.
ALTCHUNK_TYPES = {
    "message/rfc822": True,
    "text/html": True,
    "application/xhtml+xml": True,
    "application/vnd.ms-word.document.macroEnabled.main+xml": False,
    "application/msword": False,
}

#: Upper ends of the input-size histogram, and of a client's default seconds histogram.
BYTE_BUCKETS = [1024, 8192, 65536, 524288, 4194304, 33554432, 134217728]
SECOND_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small fixed table, null where the key is unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def supported_label(label: Column) -> Column:
    return lookup(LABELS, label)


def extension_label(ext: Column) -> Column:
    return lookup(EXTENSIONS, ext)


def mime_of(label: Column) -> Column:
    return lookup(MIME, label)


def application_of(label: Column) -> Column:
    out = F.lit("writer")
    for name, labels in APPLICATION.items():
        out = F.when(label.isin(labels), name).otherwise(out)
    return out


def family_of(name: Column) -> Column:
    """The family of a label or an extension."""
    return F.coalesce(lookup({member: family for family, members in FAMILIES.items() for member in members}, name), name)


def is_text_mime(mime: Column) -> Column:
    return F.coalesce(F.startswith(mime, F.lit("text/")) | mime.isin(TEXT_MIME), F.lit(False))


def is_macro_extension(ext: Column) -> Column:
    return F.coalesce(ext.isin(MACRO), F.lit(False))


def extension_table(spark: SparkSession) -> DataFrame:
    """(ext, label, mime): the allow-list as a table, of fixed size, for joins."""
    return spark.createDataFrame([(e, x, MIME[x]) for e, x in EXTENSIONS.items()], "ext string, label string, mime string")
