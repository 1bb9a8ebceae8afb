"""Queries of the writers over pages' elements; every seventh paragraph is a list, tables are made of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.operators import writers as w
from docuflux.registry import register

from . import hierarchy as h
from .text import read

ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
E = f"""{h.E}, el AS (SELECT doc_id, page, seq, CASE WHEN type = 'paragraph' AND seq % 6 = 5 THEN 'header' WHEN type = 'paragraph' AND seq % 6 = 4 THEN 'caption' ELSE type END AS type, level, content AS text FROM e5)"""
#: A table of three columns for each page: a cell of two columns, a blank and a bar in it.
CELLS = """cells AS (SELECT page_id AS doc_id, 1000 AS seq, r AS "row", c AS col, 1 AS row_span, CASE WHEN r = 1 AND c = 0 THEN 2 ELSE 1 END AS col_span,
  CASE WHEN r = 2 AND c = 1 THEN '' WHEN r = 0 THEN 'h|' || c ELSE 'v' || page_id || '<' || r || c END AS text FROM pages, range(3) a(r), range(3) b(c) WHERE NOT (r = 1 AND c = 1))"""


def elements(spark, sf_dir):
    t, s = F.col("type"), F.col("seq")
    kind = F.when((t == "paragraph") & (s % 6 == 5), "header").when((t == "paragraph") & (s % 6 == 4), "caption").otherwise(t)
    return h.elements(spark, sf_dir).select("doc_id", "page", "seq", kind.alias("type"), "level", F.col("content").alias("text"))


def cells(spark, sf_dir):
    at = spark.range(9).select(F.floor(F.col("id") / 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col")).filter("not (row = 1 and col = 1)")
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")).crossJoin(F.broadcast(at))  # eight places
    text = F.when((F.col("row") == 2) & (F.col("col") == 1), "").when(F.col("row") == 0, F.concat(F.lit("h|"), F.col("col"))).otherwise(F.concat(F.lit("v"), F.col("doc_id"), F.lit("<"), F.col("row"), F.col("col")))
    return rows.select("doc_id", F.lit(1000).alias("seq"), "row", "col", F.lit(1).alias("row_span"), F.when((F.col("row") == 1) & (F.col("col") == 0), 2).otherwise(1).alias("col_span"), text.alias("text"))


GRID = f"""{CELLS}, places AS (SELECT DISTINCT doc_id, seq, r AS "row", c AS col FROM cells, range(3) a(r), range(3) b(c)),
  g AS (SELECT p.*, CASE WHEN coalesce(text, '') = '' THEN ' ' ELSE replace(text, '|', '\\|') END AS place FROM places p LEFT JOIN cells USING (doc_id, seq, "row", col)),
  mr AS (SELECT doc_id, seq, "row", '|' || string_agg(place, '|' ORDER BY col) || '|' || CASE WHEN "row" = 0 THEN chr(10) || '|---|---|---|' ELSE '' END AS line FROM g GROUP BY doc_id, seq, "row"),
  mt AS (SELECT doc_id, seq, string_agg(line, chr(10) ORDER BY "row") AS text FROM mr GROUP BY ALL)"""


@register("b18_markdown_tables", f"WITH {GRID} SELECT doc_id, seq, text FROM mt")
def b18(spark, sf_dir):
    return w.markdown_tables(cells(spark, sf_dir))


HTML = f"""{CELLS}, hr AS (SELECT doc_id, seq, "row", '<tr>' || string_agg('<' || CASE "row" WHEN 0 THEN 'th' ELSE 'td' END || CASE WHEN col_span > 1 THEN ' colspan="' || col_span || '"' ELSE '' END || '>' || {ESC.format('text')} || '</' || CASE "row" WHEN 0 THEN 'th' ELSE 'td' END || '>', '' ORDER BY col) || '</tr>' AS line FROM cells GROUP BY ALL),
  ht AS (SELECT doc_id, seq, '<table>' || string_agg(line, '' ORDER BY "row") || '</table>' AS text FROM hr GROUP BY ALL)"""


@register("g11_html_tables", f"WITH {HTML} SELECT doc_id, seq, text FROM ht")
def g11(spark, sf_dir):
    return w.html_tables(cells(spark, sf_dir))


def with_table(spark, sf_dir):
    rows, c = elements(spark, sf_dir), cells(spark, sf_dir)
    tables = c.select("doc_id", F.lit(999).alias("page"), "seq", F.lit("table").alias("type"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text")).distinct()
    return rows.unionByName(tables), c


ITEMS = "list_transform(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0), lambda x: {})"
WHOLE = "whole AS (SELECT doc_id, page, seq, type, level, text FROM el UNION ALL SELECT doc_id, 999, seq, 'table', NULL, text FROM {t})"
BODY = f"CASE type WHEN 'heading' THEN repeat('#', least(6, greatest(1, coalesce(level, 1)))) || ' ' || text WHEN 'list' THEN array_to_string({ITEMS.format(chr(39) + '- ' + chr(39) + ' || trim(x)')}, chr(10)) WHEN 'caption' THEN '*' || text || '*' ELSE text END"
MARKDOWN = """WITH {e}, {t}, {whole}, b AS (SELECT doc_id, page, seq, {body} AS body FROM whole WHERE type <> 'header'),
  p AS (SELECT doc_id, page, '--- ' || page || ' ---' || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY seq) AS body FROM b WHERE length(body) > 0 GROUP BY doc_id, page)
  SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY page) AS markdown FROM p GROUP BY 1"""


@register("k5_document_markdown", MARKDOWN.format(e=E, t=GRID, whole=WHOLE.format(t="mt"), body=BODY))
def k5(spark, sf_dir):
    return w.markdown(*with_table(spark, sf_dir), separator="--- %page-number% ---")


@register("k6_markdown_html", MARKDOWN.format(e=E, t=HTML, whole=WHOLE.format(t="ht"), body=BODY))
def k6(spark, sf_dir):
    return w.markdown(*with_table(spark, sf_dir), html=True, separator="--- %page-number% ---")


@register("k7_html", f"""WITH {E}, {HTML}, {WHOLE.format(t='ht')}, safe AS (SELECT * REPLACE (CASE type WHEN 'table' THEN text ELSE {ESC.format('text')} END AS text) FROM whole WHERE type <> 'header'),
  b AS (SELECT doc_id, page, seq, CASE type WHEN 'heading' THEN '<h' || least(6, greatest(1, coalesce(level, 1))) || '>' || text || '</h' || least(6, greatest(1, coalesce(level, 1))) || '>' WHEN 'list' THEN '<ul>' || array_to_string({ITEMS.format("'<li>' || trim(x) || '</li>'")}, '') || '</ul>'
    WHEN 'table' THEN text WHEN 'caption' THEN '<figcaption>' || text || '</figcaption>' ELSE '<p>' || text || '</p>' END AS body FROM safe)
  SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"></head><body>' || chr(10) || string_agg(body, chr(10) ORDER BY page, seq) || chr(10) || '</body></html>' AS html FROM b GROUP BY 1""")
def k7(spark, sf_dir):
    return w.html(*with_table(spark, sf_dir))


@register("k8_plain_text", f"""WITH {E}, b AS (SELECT doc_id, page, seq, CASE type WHEN 'list' THEN array_to_string({ITEMS.format("'  ' || trim(x)")}, chr(10)) ELSE text END AS body FROM el WHERE type <> 'header'),
  p AS (SELECT doc_id, page, '[' || page || ']' || chr(10) || string_agg(body, chr(10) ORDER BY seq) AS body FROM b WHERE length(body) > 0 GROUP BY doc_id, page) SELECT doc_id, string_agg(body, chr(10) ORDER BY page) AS text FROM p GROUP BY 1""")
def k8(spark, sf_dir):
    return w.plain(elements(spark, sf_dir), "[%page-number%]")


@register("p15_shown", f"WITH {E} SELECT doc_id, count(*) AS every, count_if(type <> 'header') AS shown FROM el GROUP BY 1")
def p15(spark, sf_dir):
    rows = elements(spark, sf_dir)
    return w.shown(rows, True).groupBy("doc_id").agg(F.count("*").alias("every")).join(w.shown(rows, False).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", "every", F.coalesce("n", F.lit(0)).alias("shown"))


@register("k4_document_json", f"""WITH {E} SELECT doc_id, '{{"number of pages":' || count(DISTINCT page) || ',"kids":[' || string_agg('{{"type":"' || type || '","page number":' || page || CASE WHEN level IS NOT NULL THEN ',"heading level":' || level ELSE '' END || ',"content":' || to_json(text) || '}}', ',' ORDER BY seq) || ']}}' AS json FROM el WHERE type <> 'header' GROUP BY 1""")
def k4(spark, sf_dir):
    return w.document_json(elements(spark, sf_dir))


@register("k9_data_uris", "SELECT page_id, 'data:image/png;base64,' || to_base64(encode(url)) AS uri FROM pages")
def k9(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", w.data_uri(F.encode("url", "UTF-8")).alias("uri"))


@register("k12_report", """SELECT '{' || string_agg('"' || source || '":{"chunks":' || n || ',"longest":' || m || '}', ',' ORDER BY source) || '}' AS report FROM (SELECT source, count(*) AS n, max(n_chars) AS m FROM documents GROUP BY 1)""")
def k12(spark, sf_dir):
    return w.report(read(spark, sf_dir, "documents").groupBy(F.col("source").alias("strategy")).agg(F.count("*").alias("chunks"), F.max("n_chars").alias("longest")))


@register("a12_page_counts", "SELECT doc_id, len(string_split(text || chr(10) || '---' || chr(10) || 'x', chr(10) || '---' || chr(10)))::INT AS pages FROM documents")
def a12(spark, sf_dir):
    """Pages of a Markdown text by its rules; each document gets one rule at its end."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.split(F.concat(F.col("text"), F.lit("\n---\nx")), "\n---\n")).alias("pages"))
