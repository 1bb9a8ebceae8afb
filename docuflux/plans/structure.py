"""Structure queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.operators import structure as st
from docuflux.operators import trees as tr
from docuflux.registry import register

from .text import read

ELEMENTS = r"""x AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:h[1-6]|p)(?:\s[^>]*)?>.*?</(?:h[1-6]|p)>') AS tags FROM pages),
  r AS (SELECT page_id, unnest(range(len(tags))) AS seq, unnest(tags) AS tag FROM x),
  e AS (SELECT page_id, seq, CASE WHEN starts_with(tag, '<h') THEN 'heading' ELSE 'paragraph' END AS type,
    CASE WHEN starts_with(tag, '<h') THEN substr(tag, 3, 1)::INT END AS level,
    trim(regexp_replace(regexp_replace(tag, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS content FROM r)"""


@register("g2_elements", f"WITH {ELEMENTS} SELECT * FROM e")
def g2(spark, sf_dir):
    return st.elements(read(spark, sf_dir, "pages"))


@register("w1_section_titles", f"WITH {ELEMENTS} SELECT page_id, seq, type, CASE WHEN type <> 'heading' THEN last_value(CASE WHEN type = 'heading' THEN content END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY seq) END AS section_title FROM e")
def w1(spark, sf_dir):
    return st.titled(st.elements(read(spark, sf_dir, "pages"))).select("page_id", "seq", "type", "section_title")


@register("w2_sections", f"WITH {ELEMENTS}, s AS (SELECT *, sum((type = 'heading')::INT) OVER (PARTITION BY page_id ORDER BY seq) AS section FROM e) SELECT page_id, section, min(CASE WHEN type = 'heading' THEN content END) AS title, count(*) AS n_elements, string_agg(content, chr(10) ORDER BY seq) AS content FROM s GROUP BY page_id, section")
def w2(spark, sf_dir):
    return st.sections(st.elements(read(spark, sf_dir, "pages")))


@register("g1_chunks")
def g1(spark, sf_dir):
    return st.chunked(read(spark, sf_dir, "documents"))


@register("s4_html_text")
def s4(spark, sf_dir):
    return st.loaded_html(read(spark, sf_dir, "pages"))


@register("f10_sanitize")
def f10(spark, sf_dir):
    return st.sanitized(read(spark, sf_dir, "documents")).select("doc_id", F.md5("text").alias("clean_md5"))


@register("k5_markdown", f"WITH {ELEMENTS} SELECT page_id, string_agg(CASE WHEN type = 'heading' THEN repeat('#', level) || ' ' || content ELSE content END, chr(10) || chr(10) ORDER BY seq) AS markdown FROM e GROUP BY 1")
def k5(spark, sf_dir):
    rows = st.elements(read(spark, sf_dir, "pages"))
    line = F.when(F.col("type") == "heading", F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("content"))).otherwise(F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("markdown"))


@register("k8_text", f"WITH {ELEMENTS} SELECT page_id, string_agg(content, chr(10) ORDER BY seq) AS text FROM e GROUP BY 1")
def k8(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("seq", "content")))
    return st.elements(read(spark, sf_dir, "pages")).groupBy("page_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("text"))


@register("k4_json", f"""WITH {ELEMENTS} SELECT page_id, '{{"number of kids":' || count(*) || ',"kids":[' || string_agg('{{"id":' || seq || ',"type":"' || type || '"' || CASE WHEN level IS NOT NULL THEN ',"heading level":' || level ELSE '' END || ',"content":' || to_json(content) || '}}', ',' ORDER BY seq) || ']}}' AS json FROM e GROUP BY 1""")
def k4(spark, sf_dir):
    kid = F.struct(F.col("seq").alias("id"), "type", F.col("level").alias("heading level"), "content")
    return st.elements(read(spark, sf_dir, "pages")).groupBy("page_id").agg(F.to_json(F.struct(F.count("*").alias("number of kids"), F.array_sort(F.collect_list(kid)).alias("kids"))).alias("json"))


@register("a6_chunk_metrics", r"SELECT source AS strategy, count(*) AS chunks, round(avg((text LIKE '%|%')::INT), 4) AS tables, round(avg((length(lang) > 0)::INT), 4) AS titled, bool_or(text LIKE '%|%') AS any_table FROM documents GROUP BY 1")
def a6(spark, sf_dir):
    bar = F.contains("text", F.lit("|"))
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("strategy")).agg(
        F.count("*").alias("chunks"), F.round(F.avg(bar.cast("int")), 4).alias("tables"), F.round(F.avg((F.length("lang") > 0).cast("int")), 4).alias("titled"), F.bool_or(bar).alias("any_table")
    )


NODE = "cast('0x' || substr(md5(page_id || ':' || {}), 1, 12) AS bigint)"
#: The tags as tree rows, and the walk by recursion.
TREE = rf"""tk AS (SELECT page_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT page_id, regexp_extract_all(html, '{tr.TOKEN.replace("(/?)", "/?")}') AS t FROM pages)),
  pt AS (SELECT page_id, pos, starts_with(token, '</') AS closing, regexp_extract(token, '^</?([a-z0-9]+)', 1) AS role, trim(regexp_extract(token, '>([^<]*)$', 1)) AS text FROM tk),
  hd AS (SELECT *, regexp_full_match(role, '{tr.HOLDING}') AS holding FROM pt),
  lv AS (SELECT *, coalesce(sum(CASE WHEN NOT holding THEN 0 WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS level FROM hd WHERE holding OR NOT closing),
  op AS MATERIALIZED (SELECT * FROM lv WHERE NOT closing),
  up AS (SELECT c.page_id, c.pos, c.role, c.text, max(p.pos) AS up FROM op c LEFT JOIN op p ON p.page_id = c.page_id AND p.holding AND p.level = c.level - 1 AND p.pos < c.pos GROUP BY ALL),
  nd AS MATERIALIZED (SELECT page_id, {NODE.format("pos")} AS node, CASE WHEN up IS NOT NULL THEN {NODE.format("up")} END AS parent, row_number() OVER (PARTITION BY page_id, up ORDER BY pos) AS place, role, text FROM up),
  wk AS (SELECT *, [place] AS path FROM nd WHERE parent IS NULL UNION ALL SELECT nd.*, path || [nd.place] FROM wk JOIN nd ON nd.page_id = wk.page_id AND nd.parent = wk.node)"""
TYPES = "CASE WHEN regexp_full_match(role, 'h[1-6]|title') THEN 'heading' WHEN role = 'p' THEN 'paragraph' WHEN role IN ('ul', 'ol', 'nav') THEN 'list' WHEN role = 'li' THEN 'list item' WHEN role = 'table' THEN 'table' WHEN role = 'tr' THEN 'row' WHEN role IN ('td', 'th') THEN 'cell' WHEN role = 'a' THEN 'link' WHEN role IN ('article', 'section', 'main') THEN 'section' WHEN role = 'html' THEN 'document' ELSE 'other' END"


@register("s15_structure_tree", f"""WITH RECURSIVE {TREE}, sz AS (SELECT a.page_id, a.node, count(*) AS size FROM wk a JOIN wk b ON a.page_id = b.page_id AND b.path[1:len(a.path)] = a.path GROUP BY ALL)
  SELECT wk.page_id, row_number() OVER (PARTITION BY wk.page_id ORDER BY path) - 1 AS "order", len(path) AS depth, size, {TYPES} AS type, CASE WHEN regexp_full_match(role, 'h[1-6]') THEN substr(role, 2, 1)::INT WHEN role = 'title' THEN 1 END AS heading_level, text FROM wk JOIN sz USING (page_id, node)""")
def s15(spark, sf_dir):
    """The tags of all pages as a structure tree in reading order, with standard types."""
    rows = tr.preorder(tr.tagged(read(spark, sf_dir, "pages")), "page_id")
    kind, level = tr.standard(F.col("role"))
    return rows.select("page_id", "order", "depth", "size", kind.alias("type"), level.alias("heading_level"), "text")
