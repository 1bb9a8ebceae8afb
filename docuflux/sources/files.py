"""File sources: text, HTML, JSON lines and layout JSON, by extension."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docuflux.functions import text as t
from docuflux.operators.structure import html_text

TEXTS, HTMLS = [".txt", ".md", ".markdown", ".text"], [".html", ".htm"]
ELEMENT = T.StructType(
    [
        T.StructField("seq", T.IntegerType()), T.StructField("id", T.IntegerType()), T.StructField("page_number", T.IntegerType()), T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()), T.StructField("heading_level", T.IntegerType()), T.StructField("next_table_id", T.IntegerType()), T.StructField("previous_table_id", T.IntegerType()),
    ]
)


PARSERS = ["pypdf", "layout"]


def dispatch(extension: Column) -> Column:
    """The loader of an extension: text, html, docx or pdf; null for one that none reads."""
    return F.when(extension.isin(TEXTS), "text").when(extension.isin(HTMLS), "html").when(extension == ".docx", "docx").when(extension == ".pdf", "pdf")


def pdf_parser(asked: Column, layout_ready: Column) -> Column:
    """The parser of a PDF: the one asked for, else the layout parser if it is there; null for an unknown name."""
    return F.when(asked.isin(PARSERS), asked).when(asked.isNull(), F.when(layout_ready, "layout").otherwise("pypdf"))


def docx_text(content: bytes) -> str | None:
    """Paragraphs of a Word document's body, a line each, tabs and breaks kept; null if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    w, out = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", []
    marks = {f"{w}tab": "\t", f"{w}br": "\n", f"{w}cr": "\n"}
    for p in body.iter(f"{w}p"):
        out.append("".join(x.text or "" if x.tag == f"{w}t" else marks.get(x.tag, "") for x in p.iter()))
    return "\n".join(out)


def loaded(files: DataFrame, parse_pdf: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """files (path, content as bytes, further columns) with extension, loader, text and file_hash.

    Files that no loader reads stay, with a null loader and text, for the caller to refuse; so do PDFs
    without parse_pdf, and what a parser can't read. Bytes that are no UTF-8 become U+FFFD in text files.
    """
    rows = files.withColumn("extension", t.extension(F.col("path"))).withColumn("loader", dispatch(F.col("extension")))

    @F.pandas_udf("string")
    def parsed(loader: pd.Series, content: pd.Series) -> pd.Series:
        def one(kind, body):
            if kind == "html":
                return html_text(bytes(body).decode("utf-8", "ignore"))
            if kind == "docx":
                return docx_text(bytes(body))
            if kind == "pdf" and parse_pdf is not None:
                return parse_pdf(bytes(body))
            return bytes(body).decode("utf-8", "ignore") if kind == "text" else None

        return pd.Series([None if b is None else one(k, b) for k, b in zip(loader, content, strict=True)], dtype=object)

    return rows.withColumn("text", parsed("loader", "content")).withColumn("file_hash", t.file_hash(F.col("content")))


def load_documents(spark: SparkSession, path: str, parse_pdf: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """(path, extension, loader, text, file_hash) of all files below path; see loaded()."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return loaded(files, parse_pdf).drop("content")


def required(rows: DataFrame) -> DataFrame:
    """rows, failing on the first file that no loader reads."""
    wrong = F.raise_error(F.concat(F.lit("unsupported document format: "), F.col("extension")))
    return rows.withColumn("loader", F.when(F.col("loader").isNull(), wrong.cast("string")).otherwise(F.col("loader")))


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(path, text, parser): the primary result where there is one, else the fallback's."""
    other = fallback.select("path", F.col("text").alias("_other"))
    joined = primary.select("path", "text").join(other, "path", "full")
    return joined.select("path", F.coalesce("text", "_other").alias("text"), F.when(F.col("text").isNotNull(), "primary").when(F.col("_other").isNotNull(), "fallback").otherwise("failed").alias("parser"))


def seeded(spark: SparkSession, path: str, name: str, text: str) -> DataFrame:
    """Documents of a folder, and the given one beside them if none has its name."""
    found = load_documents(spark, path)
    own = spark.createDataFrame([(name, text)], "path string, text string").select("path", t.extension(F.col("path")).alias("extension"), F.lit("text").alias("loader"), "text", F.sha2(F.col("text"), 256).alias("file_hash"))
    same = found.filter(F.element_at(F.split("path", "/"), -1) == name).select(F.lit(name).alias("path"))
    return found.unionByName(own.join(same, "path", "left_anti"))


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Types whose text holds that of all below them; others are walked into.
WHOLE = ("heading", "paragraph", "caption", "table", "list", "image", "formula", "picture", "header", "footer")


def walk(tree: str | None, furniture: bool = False) -> list[dict]:
    """Elements of a layout tree in reading order; those without a type are passed over, headers
    and footers too unless asked for. The walk keeps its own stack, so depth is no limit."""
    out: list[dict] = []
    stack = list(reversed((json.loads(tree) if tree else {}).get("kids") or []))
    while stack:
        node = stack.pop()
        kind = node.get("type")
        if not kind or (kind in ("header", "footer") and not furniture):
            continue
        out.append(
            {
                "seq": len(out), "id": node.get("id", 0), "page_number": node.get("page number", 1), "type": kind, "content": content(node, furniture), "heading_level": node.get("heading level"),
                "next_table_id": node.get("next table id"), "previous_table_id": node.get("previous table id"),
            }
        )
        if kind not in WHOLE:
            stack += reversed(node.get("kids") or [])
    return out


def content(node: dict, furniture: bool = False) -> str:
    """An element's own text: lists a line an item, tables the texts in their cells between bars,
    blank ones left out; images have none, pictures their description."""
    kind, below = node.get("type"), lambda x: [content(k, furniture) for k in x.get("kids") or []]
    if kind == "list":
        items = [x.get("content") or "".join(below(x)) for x in node.get("list items") or []]
        return "\n".join(i for i in items if i)
    if kind == "table":
        return " | ".join(c for row in node.get("rows") or [] for cell in row.get("cells") or [] for c in below(cell) if c)
    if kind == "image" or (kind in ("header", "footer") and not furniture):
        return ""
    return node.get("description" if kind == "picture" else "content") or ""


def elements(trees: DataFrame, furniture: bool = False) -> DataFrame:
    """(doc_id, element columns) of layout JSON. trees: doc_id, json."""

    @F.pandas_udf(T.ArrayType(ELEMENT))
    def flat(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: walk(x, furniture))

    return trees.select("doc_id", F.explode(flat("json")).alias("e")).select("doc_id", "e.*")
