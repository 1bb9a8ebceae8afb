"""Queries of tables that the documents themselves hold (lines of cells between bars), and of pages' own layout trees."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.operators import hybrid as y
from docuflux.operators import structure as st
from docuflux.operators import writers as w
from docuflux.registry import register
from docuflux.sources import files

from .text import read
from .writers import ESC

#: Lines with bars that follow each other are a table, named by its first line; a row's last cell spans what the longest row has more.
PIPED = """l AS (SELECT doc_id, unnest(range(len(x))) AS s, unnest(x) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
  b AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS run FROM l WHERE contains(l, '|')),
  p AS MATERIALIZED (SELECT doc_id, min(s) OVER (PARTITION BY doc_id, run) AS seq, s, l, string_split(l, '|') AS x, max(len(string_split(l, '|'))) OVER (PARTITION BY doc_id, run) AS cols FROM b),
  cells AS MATERIALIZED (SELECT doc_id, seq, s - seq AS "row", c AS col, CASE WHEN c = len(x) - 1 THEN cols - c ELSE 1 END AS col_span, trim(x[c + 1]) AS text, cols FROM (SELECT *, unnest(range(len(x))) AS c FROM p))"""


def piped(spark, sf_dir):
    """(doc_id, seq, s, l): lines with bars, with the first line of their table."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("s", "l")).filter(F.contains("l", F.lit("|")))
    run = F.col("s") - F.row_number().over(Window.partitionBy("doc_id").orderBy("s"))
    return rows.withColumn("run", run).withColumn("seq", F.min("s").over(Window.partitionBy("doc_id", "run"))).select("doc_id", "seq", "s", "l")


def cells(spark, sf_dir):
    split = piped(spark, sf_dir).withColumn("x", F.split("l", r"\|")).withColumn("cols", F.max(F.size("x")).over(Window.partitionBy("doc_id", "seq")))
    flat = split.select("doc_id", "seq", (F.col("s") - F.col("seq")).alias("row"), F.size("x").alias("n"), "cols", F.posexplode("x").alias("col", "text"))
    span = F.when(F.col("col") == F.col("n") - 1, F.col("cols") - F.col("col")).otherwise(1)
    return flat.select("doc_id", "seq", "row", "col", F.lit(1).alias("row_span"), span.alias("col_span"), F.trim("text").alias("text"))


@register("b18_piped_tables", f"""WITH {PIPED}, pl AS (SELECT DISTINCT doc_id, seq, "row", unnest(range(cols)) AS col FROM cells),
  g AS (SELECT pl.*, CASE WHEN coalesce(text, '') = '' THEN ' ' ELSE text END AS place FROM pl LEFT JOIN cells USING (doc_id, seq, "row", col)),
  r AS (SELECT doc_id, seq, "row", '|' || string_agg(place, '|' ORDER BY col) || '|' || CASE WHEN "row" = 0 THEN chr(10) || '|' || repeat('---|', count(*)) ELSE '' END AS line FROM g GROUP BY doc_id, seq, "row")
  SELECT doc_id, seq, string_agg(line, chr(10) ORDER BY "row") AS text FROM r GROUP BY ALL""")
def b18_piped(spark, sf_dir):
    return w.markdown_tables(cells(spark, sf_dir))


@register("g11_piped_tables", f"""WITH {PIPED}, r AS (SELECT doc_id, seq, "row", '<tr>' || string_agg('<' || CASE "row" WHEN 0 THEN 'th' ELSE 'td' END || CASE WHEN col_span > 1 THEN ' colspan="' || col_span || '"' ELSE '' END || '>' || {ESC.format('text')} || '</' || CASE "row" WHEN 0 THEN 'th' ELSE 'td' END || '>', '' ORDER BY col) || '</tr>' AS line FROM cells GROUP BY ALL)
  SELECT doc_id, seq, '<table>' || string_agg(line, '' ORDER BY "row") || '</table>' AS text FROM r GROUP BY ALL""")
def g11_piped(spark, sf_dir):
    return w.html_tables(cells(spark, sf_dir))


@register("a15_piped_quality", f"""WITH {PIPED} SELECT doc_id, 0 AS page, seq AS "table", count(DISTINCT "row") AS "rows", count(DISTINCT col) AS "columns", count(DISTINCT CASE WHEN text <> '' THEN "row" END) AS filled_rows,
  count(DISTINCT CASE WHEN text <> '' THEN col END) AS filled_columns, count_if(text <> '') AS lines FROM cells GROUP BY ALL""")
def a15_piped(spark, sf_dir):
    return y.table_quality(cells(spark, sf_dir).select("doc_id", F.lit(0).alias("page"), F.col("seq").alias("table"), "row", "col", "text"))


@register("j9_piped_chains", f"""WITH {PIPED}, f AS (SELECT doc_id, seq, s // 5 AS page, string_agg(l, chr(10) ORDER BY s) AS content, min(s) AS first FROM p GROUP BY ALL)
  SELECT doc_id, min(first) AS id, count(*) AS n_parts, string_agg(content, chr(10) ORDER BY page) AS content, max(page) AS page_end FROM f GROUP BY doc_id, seq""")
def j9_piped(spark, sf_dir):
    """Tables that pages of five lines cut into fragments, which name the one before and the one behind, as one again."""
    cut = piped(spark, sf_dir).withColumn("page_number", F.floor(F.col("s") / 5))
    parts = F.array_sort(F.collect_list(F.struct("s", "l")))
    fragments = cut.groupBy("doc_id", "seq", "page_number").agg(F.min("s").cast("long").alias("id"), F.array_join(F.transform(parts, lambda x: x["l"]), "\n").alias("content"))
    along = Window.partitionBy("doc_id", "seq").orderBy("page_number")
    rows = fragments.withColumns({"next_table_id": F.lead("id").over(along), "previous_table_id": F.lag("id").over(along)})
    return st.merged_tables(rows.select("doc_id", "id", F.col("page_number").cast("long").alias("page_number"), "content", "next_table_id", "previous_table_id"))


BARE = r"trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
PART = r"(?s)<(?:h[1-6]|p|ul)(?:\s[^>]*)?>.*?</(?:h[1-6]|p|ul)>"


@register("g3_page_trees", rf"""WITH x AS (SELECT page_id, regexp_extract_all(html, '{PART}') AS tags FROM pages), r AS (SELECT page_id, unnest(range(len(tags))) AS i, unnest(tags) AS tag FROM x),
  e AS (SELECT page_id, i, 1 AS k, i + 1 AS id, i // 5 + 1 AS page_number, CASE WHEN starts_with(tag, '<h') THEN 'heading' WHEN starts_with(tag, '<ul') THEN 'list' ELSE 'paragraph' END AS type,
      CASE WHEN starts_with(tag, '<ul') THEN array_to_string(list_filter(list_transform(regexp_extract_all(tag, '(?s)<li(?:\s[^>]*)?>(.*?)</li>', 1), lambda v: {BARE.format('v')}), lambda v: v <> ''), chr(10)) ELSE {BARE.format('tag')} END AS content,
      CASE WHEN starts_with(tag, '<h') THEN substr(tag, 3, 1)::INT END AS heading_level FROM r
    UNION ALL SELECT page_id, i, 0, 0, 1, 'nav', '', NULL FROM r WHERE starts_with(tag, '<ul'))
  SELECT page_id AS doc_id, (row_number() OVER (PARTITION BY page_id ORDER BY i, k) - 1)::INT AS seq, id::INT AS id, page_number::INT AS page_number, type, content, heading_level FROM e""")
def g3_trees(spark, sf_dir):
    """Each page's headings, paragraphs and lists as a layout tree (lists stand in a part of their own), walked."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    tags = F.regexp_extract_all("html", F.lit(PART), F.lit(0))

    def node(tag, i):
        is_list = F.startswith(tag, F.lit("<ul"))
        items = F.transform(F.regexp_extract_all(tag, F.lit(r"(?s)<li(?:\s[^>]*)?>(.*?)</li>"), F.lit(1)), lambda v: F.struct(bare(v).alias("content")))
        kind = F.when(is_list, "list").when(F.startswith(tag, F.lit("<h")), "heading").otherwise("paragraph")
        own = F.struct(
            kind.alias("type"), (i + 1).alias("id"), (F.floor(i / 5) + 1).alias("page number"), F.when(F.startswith(tag, F.lit("<h")), F.substring(tag, 3, 1).cast("int")).alias("heading level"),
            F.when(~is_list, bare(tag)).alias("content"), F.when(is_list, items).alias("list items"),
        )
        return F.when(is_list, F.concat(F.lit('{"type":"nav","kids":['), F.to_json(own), F.lit("]}"))).otherwise(F.to_json(own))

    tree = F.concat(F.lit('{"kids":['), F.array_join(F.transform(tags, node), ","), F.lit("]}"))
    trees = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), tree.alias("json"))
    return files.elements(trees).drop("previous_table_id", "next_table_id")
