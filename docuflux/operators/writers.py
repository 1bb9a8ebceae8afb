"""Documents as Markdown, HTML and plain text, from elements, tables and lists.

elements: doc_id, page, seq, type, level, text. Tables come as cells: doc_id, seq (the table's), row,
col, row_span, col_span, text. Headers, footers and art are left out unless asked for.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FURNITURE = ["header", "footer", "art", "line"]


def escaped(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def in_order(rows: DataFrame, keys: list[str], order: list[str], text: str, between: str, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["_t"]), between).alias(name))


def grid(cells: DataFrame) -> DataFrame:
    """Every place of each table with the cell that covers it: doc_id, seq, row, col, text, own
    (whether the cell begins there). Places without a cell are empty."""
    size = cells.groupBy("doc_id", "seq").agg(F.max(F.col("row") + F.col("row_span")).alias("rows"), F.max(F.col("col") + F.col("col_span")).alias("cols"))
    places = size.select("doc_id", "seq", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols").select("doc_id", "seq", "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    return places.join(cells.select("doc_id", "seq", "row", "col", F.col("text").alias("text"), F.lit(True).alias("own")), ["doc_id", "seq", "row", "col"], "left")


def markdown_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, seq, text): rows between bars, a rule after the first; spanned and empty places are blank."""
    clean = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    place = F.when(F.length(clean) > 0, clean).otherwise(" ")
    rows = in_order(grid(cells).withColumn("_p", place), ["doc_id", "seq", "row"], ["col"], "_p", "|", "line")
    count = F.size(F.split(F.regexp_replace("line", r"\\\|", ""), r"\|"))
    line = F.concat(F.lit("|"), F.col("line"), F.lit("|"))
    line = F.when(F.col("row") == 0, F.concat(line, F.lit("\n|"), F.array_join(F.array_repeat(F.lit("---"), count), "|"), F.lit("|"))).otherwise(line)
    return in_order(rows.withColumn("_l", line), ["doc_id", "seq"], ["row"], "_l", "\n", "text")


def html_tables(cells: DataFrame) -> DataFrame:
    """(doc_id, seq, text): rows of cells with their spans; the first row's cells are heads."""
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c), F.lit('"'))).otherwise("")
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, span("colspan", "col_span"), span("rowspan", "row_span"), F.lit(">"), escaped(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    rows = in_order(cells.withColumn("_c", cell), ["doc_id", "seq", "row"], ["col"], "_c", "", "line")
    whole = in_order(rows.withColumn("_l", F.concat(F.lit("<tr>"), F.col("line"), F.lit("</tr>"))), ["doc_id", "seq"], ["row"], "_l", "", "body")
    return whole.select("doc_id", "seq", F.concat(F.lit("<table>"), F.col("body"), F.lit("</table>")).alias("text"))


def with_tables(elements: DataFrame, tables: DataFrame) -> DataFrame:
    t = tables.select("doc_id", "seq", F.col("text").alias("_table"))
    joined = elements.join(t, ["doc_id", "seq"], "left")
    return joined.withColumn("text", F.when(F.col("type") == "table", F.coalesce("_table", F.lit(""))).otherwise(F.col("text"))).drop("_table")


def shown(elements: DataFrame, furniture: bool) -> DataFrame:
    return elements if furniture else elements.filter(~F.col("type").isin(FURNITURE))


def list_lines(text: Column, mark: str) -> Column:
    return F.array_join(F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.concat(F.lit(mark), F.trim(x))), "\n")


def markdown(elements: DataFrame, cells: DataFrame, html: bool = False, separator: str | None = None, furniture: bool = False) -> DataFrame:
    """(doc_id, markdown): headings by their level (6 at most), lists item by item, captions slanted, tables with
    bars, or as HTML with their spans; with a separator (which may name %page-number%) before each page."""
    rows = shown(with_tables(elements, html_tables(cells) if html else markdown_tables(cells)), furniture)
    kind, text = F.col("type"), F.col("text")
    body = (
        F.when(kind == "heading", F.concat(F.expr("repeat('#', least(6, greatest(1, coalesce(level, 1))))"), F.lit(" "), text)).when(kind == "list", list_lines(text, "- "))
        .when(kind == "caption", F.concat(F.lit("*"), text, F.lit("*"))).when(kind == "struck", F.concat(F.lit("~~"), text, F.lit("~~"))).when(kind == "image", F.concat(F.lit("!["), F.coalesce(text, F.lit("image")), F.lit("]()"))).otherwise(text)
    )
    return paged(rows.withColumn("_b", body).filter(F.length("_b") > 0), separator, "\n\n", "markdown")


def paged(rows: DataFrame, separator: str | None, between: str, name: str) -> DataFrame:
    pages = in_order(rows, ["doc_id", "page"], ["seq"], "_b", between, "_t")
    if separator:
        mark = F.replace(F.lit(separator), F.lit("%page-number%"), F.col("page").cast("string"))
        pages = pages.withColumn("_t", F.concat(mark, F.lit(between), F.col("_t")))
    return in_order(pages, ["doc_id"], ["page"], "_t", between, name)


def html(elements: DataFrame, cells: DataFrame, furniture: bool = False) -> DataFrame:
    """(doc_id, html): a body of headings, paragraphs, lists, figures and tables; texts are escaped."""
    rows = shown(with_tables(elements.withColumn("text", escaped(F.col("text"))), html_tables(cells)), furniture)
    kind, text = F.col("type"), F.col("text")
    tag = F.concat(F.lit("h"), F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6)))
    wrap = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    items = F.array_join(F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.concat(F.lit("<li>"), F.trim(x), F.lit("</li>"))), "")
    body = F.when(kind == "heading", F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">"))).when(kind == "list", wrap("ul", items)).when(kind == "table", text).when(kind == "caption", wrap("figcaption", text)).otherwise(wrap("p", text))
    out = paged(rows.withColumn("_b", body), None, "\n", "body")
    return out.select("doc_id", F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body>\n'), F.col("body"), F.lit("\n</body></html>")).alias("html"))


def plain(elements: DataFrame, separator: str | None = None, furniture: bool = False) -> DataFrame:
    """(doc_id, text): elements a line each, list items set in by two spaces, tables as they are."""
    rows = shown(elements, furniture)
    body = F.when(F.col("type") == "list", list_lines(F.col("text"), "  ")).otherwise(F.col("text"))
    return paged(rows.withColumn("_b", body).filter(F.length("_b") > 0), separator, "\n", "text")


def document_json(elements: DataFrame, furniture: bool = False) -> DataFrame:
    """(doc_id, json): number of pages and the kids in order, null fields left out."""
    kid = F.struct("seq", F.col("type"), F.col("page").alias("page number"), F.col("level").alias("heading level"), F.col("text").alias("content"))
    kids = F.transform(F.array_sort(F.collect_list(kid)), lambda k: k.dropFields("seq"))
    return shown(elements, furniture).groupBy("doc_id").agg(F.to_json(F.struct(F.count_distinct("page").alias("number of pages"), kids.alias("kids"))).alias("json"))


def data_uri(content: Column, kind: str = "png") -> Column:
    """An image's bytes as a data address, without the line ends that Spark puts after every 76 signs."""
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def data_uri_of(content: bytes, kind: str = "png") -> str:
    return f"data:image/{kind};base64,{base64.b64encode(content).decode()}"


def report(metrics: DataFrame) -> DataFrame:
    """One row, report: the metrics of all strategies as a JSON object by name, in order of their names."""
    names = [c for c in metrics.columns if c != "strategy"]
    parts = F.array_sort(F.collect_list(F.struct("strategy", F.struct(*names).alias("m"))))
    return metrics.agg(F.to_json(F.map_from_entries(F.transform(parts, lambda p: F.struct(p["strategy"].alias("k"), p["m"].alias("v"))))).alias("report"))
