"""RSS feeds → news item rows (SRC-4, NEWS-U), in Spark expressions.

A feed document is decoded by its declared encoding, tested as a whole by ``from_xml``
(an unparsable document yields no items rather than an error) and cut into its ``item``
elements, which may stand at any depth; an item within an item is not an item of its own.
Each element is then read by ``from_xml``: namespaces are ignored (``dc:date`` reads as
``date``), the first child of a name counts, and ``posexplode`` keeps the item's place in
the document for stable ordering. The feed's name and registry position come from a
registry table joined on file name. ``layout='lines'`` reads one document per line instead,
a layout for large harvests that Spark can split.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATTRIBUTES = r"""(?:\s(?:[^<>"']|"[^"]*"|'[^']*')*)?"""
_ITEM = rf"(?s)<((?:[\w.-]+:)?)item{_ATTRIBUTES}(?:/>|(?<!/)>.*?</\1item\s*>)"
_BAD = "_unparsable"
_DOCUMENT = f"channel array<struct<title: array<string>>>, {_BAD} string"
_FIELDS = ("title", "link", "pubDate", "date", "description")
_ELEMENT = ", ".join(f"{f} array<string>" for f in _FIELDS)
_UTF8 = ("", "utf-8", "utf8", "us-ascii", "ascii")
_LATIN1 = ("iso-8859-1", "latin-1", "latin1")


def _decode_others(content: pd.Series, encoding: pd.Series) -> pd.Series:
    def text(data: bytes | None, name: str | None) -> str | None:
        try:
            return None if data is None else bytes(data).decode(name)
        except (LookupError, UnicodeDecodeError):
            return None

    return pd.Series([text(d, n) for d, n in zip(content, encoding, strict=True)], dtype=object)


def document_text(content: Column) -> Column:
    """Bytes of an XML document as text, by its byte order mark or declared encoding; NULL if they do not fit it.

    UTF-8, ASCII and Latin-1 are decoded in the JVM; only documents in other encodings reach Python, in Arrow batches.
    """
    start = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    utf16 = F.startswith(start, F.lit("\u00ff\u00fe")) | F.startswith(start, F.lit("\u00fe\u00ff"))
    declared = F.lower(F.regexp_extract(start, r"""^(?:\u00ef\u00bb\u00bf)?\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""", 1))
    name = F.when(utf16, F.lit("utf-16")).otherwise(declared)
    known = name.isin(*_UTF8, *_LATIN1)
    others = F.pandas_udf(_decode_others, "string")(F.when(~known, content), F.when(~known, name))
    text = (F.when(name.isin(*_UTF8), F.try_validate_utf8(content.cast("string")))
            .when(name.isin(*_LATIN1), F.decode(content, "ISO-8859-1")).otherwise(others))
    return F.regexp_replace(text, "^\ufeff", "")


def _markup_only(text: Column) -> Column:
    """The document with its CDATA sections as escaped text and without comments, so that tags in them are not seen as tags."""
    pieces = F.split(text, r"<!\[CDATA\[", -1)

    def unwrapped(piece: Column) -> Column:
        end = F.locate("]]>", piece)
        return F.when(end > 0, F.concat(xml_escape(F.substring(piece, F.lit(1), end - 1)), F.substring(piece, end + 3, F.length(piece)))).otherwise(piece)

    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), unwrapped)
    whole = F.when(F.size(pieces) == 1, text).otherwise(F.concat(F.get(pieces, 0), F.array_join(rest, "")))
    return F.regexp_replace(whole, r"(?s)<!--.*?-->", "")


def _first(values: Column) -> Column:
    """Text of the first such element without white space around it; NULL without one, empty if it holds none."""
    return F.when(values.isNotNull(), F.regexp_replace(F.coalesce(F.get(values, 0), F.lit("")), r"^\s+|\s+$", ""))


def parse_feed_documents(docs: DataFrame, value: str = "value") -> DataFrame:
    """XML documents (text or bytes) → one row per item with ``item_pos`` and the channel title."""
    kept = [c for c in docs.columns if c != value]
    binary = isinstance(docs.schema[value].dataType, T.BinaryType)
    read = {"columnNameOfCorruptRecord": _BAD, "ignoreNamespace": "true", "mode": "PERMISSIVE"}
    texts = docs.select(*kept, (document_text(F.col(value)) if binary else F.col(value)).alias("_text"))
    whole = texts.select(*kept, "_text", F.from_xml(F.coalesce("_text", F.lit("")), _DOCUMENT, read).alias("_doc"))
    sound = whole.where(F.col("_text").isNotNull() & F.col("_doc").isNotNull() & F.col(f"_doc.{_BAD}").isNull())
    items = sound.select(*kept, _first(F.get("_doc.channel", 0)["title"]).alias("channel_title"),
                         F.posexplode(F.regexp_extract_all(_markup_only(F.col("_text")), F.lit(_ITEM), F.lit(0))).alias("item_pos", "_item"))
    parsed = items.select(*kept, "channel_title", "item_pos", F.from_xml("_item", _ELEMENT, read).alias("_it"))
    field = {f: _first(F.col(f"_it.{f}")) for f in _FIELDS}
    return parsed.select(
        *kept, "channel_title", "item_pos", field["title"].alias("title"), field["link"].alias("url"),
        F.coalesce(F.nullif(field["pubDate"], F.lit("")), field["date"]).alias("raw_date"), field["description"].alias("description"))


def read_feed_items(spark: SparkSession, path: str, registry: DataFrame | None = None,
                    layout: str = "files", file_of: Column | None = None) -> DataFrame:
    """SRC-4: feed files under ``path`` → item rows.

    ``registry`` (feed_pos, name, file) names each feed; without it the file
    name is the source and feeds order by file name. ``file_of`` gives the registry's
    name of a file from its ``path``, if it is not the file's own. Files that the registry does
    not name are left out; a feed whose file is not there has no items.
    """
    if layout == "files":
        docs = (spark.read.format("binaryFile").load(path)
                .select((F.col("_metadata.file_name") if file_of is None else file_of).alias("file"), F.col("content").alias("value")))
    elif layout == "lines":
        docs = (spark.read.text(path)
                .select(F.col("_metadata.file_name").alias("file"), "value"))
    else:
        raise ValueError("layout must be 'files' or 'lines'")
    items = parse_feed_documents(docs)
    if registry is None:
        # One row per feed file: ranking the names is tiny next to the items.
        files = docs.select("file").distinct()
        registry = files.select(F.row_number().over(Window.orderBy("file")).alias("feed_pos"),
                                F.col("file").alias("name"), "file")
    reg = registry.select("feed_pos", F.col("name").alias("source"), "file")
    return items.join(reg, "file").drop("file")


def xml_escape(c):
    """Text → XML character data."""
    out = F.regexp_replace(c, "&", "&amp;")
    out = F.regexp_replace(out, "<", "&lt;")
    return F.regexp_replace(out, ">", "&gt;")
