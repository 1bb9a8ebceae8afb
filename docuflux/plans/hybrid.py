"""Queries that join the objects of plans.layout with a second reader's: the same boxes, moved and thinned."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.operators import hybrid as y
from docuflux.registry import register

from .layout import OBJECTS, objects, pages
from .text import read

#: What a second reader found: every third object's box, shifted; words are all texts.
NODES = f"""{OBJECTS}, n AS (SELECT doc_id, page, seq, x0 + 3 AS x0, y0 - 40 AS y0, x1 + 3 + seq % 2 * 200 AS x1, y1 + 2 AS y1, text FROM o WHERE seq % 3 = 0),
  t AS (SELECT * FROM o WHERE kind = 'text')"""
CX, CY = "(t.x0 + t.x1) / 2", "(t.y0 + t.y1) / 2"


def both(spark, sf_dir):
    o = objects(spark, sf_dir)
    n = o.filter("seq % 3 = 0").select("doc_id", "page", "seq", (F.col("x0") + 3).alias("x0"), (F.col("y0") - 40).alias("y0"), (F.col("x1") + 3 + F.col("seq") % 2 * 200).alias("x1"), (F.col("y1") + 2).alias("y1"), "text")
    return n, o.filter("kind = 'text'")


NEAR = "JOIN n ON n.doc_id = t.doc_id AND n.page = t.page AND {cx} BETWEEN n.x0 - {d} AND n.x1 + {d} AND {cy} BETWEEN n.y0 - {d} AND n.y1 + {d}"
NEAR5 = NEAR.format(cx=CX, cy=CY, d=5)


@register("j10_matched_chunks", f"WITH {NODES} SELECT t.doc_id, t.page, t.seq, min(n.seq) AS node FROM t {NEAR5} GROUP BY ALL")
def j10(spark, sf_dir):
    return y.matched_chunks(*both(spark, sf_dir))


@register("j12_words_in_nodes", f"WITH {NODES} SELECT n.doc_id, n.page, n.seq, count(*) AS words FROM t {NEAR5} GROUP BY ALL")
def j12(spark, sf_dir):
    n, t = both(spark, sf_dir)
    return y.words_in_nodes(t, n)


@register("j11_nearest_images", f"""WITH {NODES} SELECT n.doc_id, n.page, n.seq, arg_min(t.seq, (sqrt(({CX} - (n.x0 + n.x1) / 2) ** 2 + ({CY} - (n.y0 + n.y1) / 2) ** 2), t.seq)) AS image FROM t {NEAR.format(cx=CX, cy=CY, d=1)} GROUP BY ALL""")
def j11(spark, sf_dir):
    n, t = both(spark, sf_dir)
    return y.nearest_images(n, t)


@register("b14_trusted", rf"""WITH {NODES}, ascii AS (SELECT * REPLACE (regexp_replace(text, '[^ -~]', '?', 'g') AS text) FROM t), na AS (SELECT * REPLACE (regexp_replace(text, '[^ -~]', '?', 'g') AS text) FROM n),
  m AS (SELECT t.doc_id, t.page, t.seq, min(n.seq) AS node FROM t {NEAR5} GROUP BY ALL), st AS (SELECT m.doc_id, m.page, m.node AS seq, string_agg(a.text, ' ' ORDER BY m.seq) AS stream FROM m JOIN ascii a USING (doc_id, page, seq) GROUP BY ALL),
  s AS (SELECT na.doc_id, na.page, na.seq, stream, CASE WHEN stream IS NULL THEN NULL WHEN stream = text THEN 1.0 WHEN stream = '' OR text = '' THEN 0.0 ELSE 1 - levenshtein(stream, text) / greatest(length(stream), length(text)) END AS sim FROM na LEFT JOIN st USING (doc_id, page, seq))
  SELECT doc_id, page, seq, round(sim, 6) AS similarity, CASE WHEN stream IS NULL THEN 'ocr-fallback' WHEN sim >= 0.5 THEN 'stream' ELSE 'ocr' END AS source FROM s""")
def b14(spark, sf_dir):
    """Whole texts; each other character counts as a question mark, as the SQL's distance is one of bytes."""
    label = F.regexp_replace("text", "[^ -~]", "?")
    n, t = both(spark, sf_dir)
    return y.trusted(n.withColumn("text", label), t.withColumn("text", label)).select("doc_id", "page", "seq", F.round("similarity", 6).alias("similarity"), "source")


AREA = "((t.x1 - t.x0) * (t.y1 - t.y0))"
SHARE = f"CASE WHEN {AREA} > 0 THEN greatest(0, least(t.x1, n.x1) - greatest(t.x0, n.x0)) * greatest(0, least(t.y1, n.y1) - greatest(t.y0, n.y0)) / {AREA} ELSE 0 END"


@register("b2_cell_words", f"WITH {NODES} SELECT n.doc_id, n.page, n.seq AS cell, string_agg(t.text, ' ' ORDER BY t.y1 DESC, t.x0, t.seq) AS text FROM t JOIN n ON n.doc_id = t.doc_id AND n.page = t.page AND {SHARE} > 0.5 GROUP BY ALL")
def b2(spark, sf_dir):
    n, t = both(spark, sf_dir)
    return y.cell_words(t, n)


@register("b3_overlapping", f"WITH {NODES} SELECT DISTINCT t.doc_id, t.page, t.seq FROM t JOIN n ON n.doc_id = t.doc_id AND n.page = t.page AND {SHARE} > 0.5")
def b3(spark, sf_dir):
    n, t = both(spark, sf_dir)
    return y.overlapping(t, n).select("doc_id", "page", "seq")


@register("j15_cells", f"""WITH {NODES}, c AS (SELECT t.doc_id, t.page, t.seq, n.seq % 2 AS "table", n.seq AS cell, {SHARE} AS share FROM t JOIN n ON n.doc_id = t.doc_id AND n.page = t.page)
  SELECT doc_id, page, seq, "table", cell FROM c WHERE share > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, page, seq ORDER BY share DESC, "table", cell) = 1""")
def j15(spark, sf_dir):
    n, t = both(spark, sf_dir)
    return y.in_cells(t, n.withColumns({"table": F.col("seq") % 2, "cell": F.col("seq")}))


@register("g9_into_tables", f"""WITH {NODES}, w AS (SELECT t.doc_id, t.page, t.seq, min(n.seq) AS "table" FROM t JOIN n ON n.doc_id = t.doc_id AND n.page = t.page AND {SHARE} >= 0.5 GROUP BY ALL)
  SELECT t.doc_id, t.page, t.seq, "table", CASE WHEN "table" IS NOT NULL THEN min(t.seq) OVER (PARTITION BY t.doc_id, t.page, "table") ELSE t.seq END AS place FROM t LEFT JOIN w ON w.doc_id = t.doc_id AND w.page = t.page AND w.seq = t.seq""")
def g9(spark, sf_dir):
    n, t = both(spark, sf_dir)
    return y.into_tables(t, n).select("doc_id", "page", "seq", "table", "place")


@register("j13_merged_pages", f"""WITH {OBJECTS}, p AS (SELECT DISTINCT doc_id, page FROM o) SELECT doc_id, page, CASE WHEN (doc_id + page) % 3 = 0 THEN 'a' || page WHEN (doc_id + page) % 4 < 2 THEN 'b' || page ELSE '' END AS contents,
  CASE WHEN (doc_id + page) % 3 = 0 THEN 'local' WHEN (doc_id + page) % 4 < 2 THEN 'backend' ELSE 'empty' END AS source FROM p""")
def j13(spark, sf_dir):
    p = pages(spark, sf_dir).select("doc_id", "page")
    at = F.col("doc_id") + F.col("page")
    local = p.filter(at % 3 == 0).withColumn("contents", F.concat(F.lit("a"), F.col("page")))
    return y.merged_pages(local, p.filter(at % 4 < 2).withColumn("contents", F.concat(F.lit("b"), F.col("page"))), p)


@register("j14_rekeyed", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000 ELSE doc_id END AS id, source FROM documents")
def j14(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("id"), "source")
    return y.rekeyed(docs, docs.filter("doc_id % 3 = 0").select("doc_id", F.col("id").alias("old_id"), (F.col("id") + 1000000).alias("new_id")))


@register("b15_present", "SELECT doc_id, id, source FROM (SELECT doc_id, unnest([1, 2, 3]) AS id, source FROM documents) WHERE (doc_id + id) % 2 = 0")
def b15(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("id"), "source")
    return y.still_present(rows, rows.filter((F.col("doc_id") + F.col("id")) % 2 == 0))


PIXELS = f"{OBJECTS}, px AS (SELECT doc_id, page, seq, x0 * 4 AS l, 3000 - y1 * 4 AS t, x1 * 4 AS r, 3000 - y0 * 4 AS b, CASE WHEN seq % 2 = 0 THEN 'TOPLEFT' ELSE 'BOTTOMLEFT' END AS origin FROM o)"


@register("b1_points", f"WITH {PIXELS} SELECT doc_id, page, seq, l * 0.24 AS x0, 842.0 - b * 0.24 AS y0, r * 0.24 AS x1, 842.0 - t * 0.24 AS y1 FROM px")
def b1(spark, sf_dir):
    o, p = pixels(spark, sf_dir)
    return rounded(y.to_points(o, p))


def pixels(spark, sf_dir):
    o = objects(spark, sf_dir).select(
        "doc_id", "page", "seq", (F.col("x0") * 4).alias("left"), (3000 - F.col("y1") * 4).alias("top"), (F.col("x1") * 4).alias("right"), (3000 - F.col("y0") * 4).alias("bottom"),
        F.when(F.col("seq") % 2 == 0, "TOPLEFT").otherwise("BOTTOMLEFT").alias("origin"),
    )
    return o, pages(spark, sf_dir).select("doc_id", "page", "height")


def rounded(rows):
    return rows.select("doc_id", "page", "seq", "x0", "y0", "x1", "y1")


@register("b1_origins", f"WITH {PIXELS} SELECT doc_id, page, seq, l AS x0, CASE WHEN seq % 2 = 0 THEN 842.0 - b ELSE t END AS y0, r AS x1, CASE WHEN seq % 2 = 0 THEN 842.0 - t ELSE b END AS y1 FROM px")
def b1_origins(spark, sf_dir):
    o, p = pixels(spark, sf_dir)
    return rounded(y.to_points(o, p, pixels=False))


@register("b4_title_levels", f"WITH {OBJECTS} SELECT doc_id, seq, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY y1 - y0 DESC) + 1, 6) AS level FROM o WHERE kind = 'heading'")
def b4(spark, sf_dir):
    return y.title_levels(objects(spark, sf_dir).filter("kind = 'heading'")).select("doc_id", "seq", "level")


@register("b6_grouped_items", f"""WITH {OBJECTS}, i AS (SELECT *, sum((seq % 5 NOT IN (1, 2, 3))::INT) OVER (PARTITION BY doc_id, page ORDER BY seq) AS run FROM o)
  SELECT doc_id, page, count(*) AS items, min(seq) AS seq, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i WHERE seq % 5 IN (1, 2, 3) GROUP BY doc_id, page, run""")
def b6(spark, sf_dir):
    return y.grouped_items(objects(spark, sf_dir).withColumn("kind", F.when((F.col("seq") % 5).isin(1, 2, 3), "item").otherwise("text")))


@register("b7_split_items", """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: length(x) > 0) AS l FROM documents),
  u AS (SELECT doc_id, len(l) AS n, unnest(range(len(l))) AS item, unnest(l) AS text FROM l) SELECT doc_id, 0 AS page, 0 AS seq, item, text, 10.0 AS x0, 100.0 - (item + 1) * (80.0::DOUBLE / n) AS y0, 50.0 AS x1, 100.0 - item * (80.0::DOUBLE / n) AS y1 FROM u""")
def b7(spark, sf_dir):
    blocks = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("seq"), "text", F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(100.0).alias("y1"))
    return y.split_items(blocks)


@register("b10_rows_sorted", f"""WITH {OBJECTS}, f AS (SELECT *, y1 - (seq % 3) * 2 + (seq % 10) // 2 * 120 AS top FROM o), g AS (SELECT *, coalesce(lag(top) OVER d - top > 5, true)::INT AS fresh FROM f WINDOW d AS (PARTITION BY doc_id, page ORDER BY top DESC, x0, seq)),
  h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY top DESC, x0, seq) AS band FROM g) SELECT doc_id, page, seq, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, x0, seq) AS place FROM h""")
def b10(spark, sf_dir):
    o = objects(spark, sf_dir).withColumn("y1", F.col("y1") - F.col("seq") % 3 * 2 + F.floor(F.col("seq") % 10 / 2) * 120)
    return y.rows_sorted(o).select("doc_id", "page", "seq", "place")


@register("b11_classified", """WITH i AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'page_header' WHEN 1 THEN 'section_header' WHEN 2 THEN 'formula' WHEN 3 THEN 'list_item' ELSE 'text' END AS label, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS text FROM pages)
  SELECT page_id, CASE label WHEN 'page_header' THEN NULL WHEN 'section_header' THEN 'heading' WHEN 'formula' THEN 'formula' ELSE 'paragraph' END AS type, CASE WHEN text = '' THEN 'orig' ELSE text END AS text FROM i""")
def b11(spark, sf_dir):
    label = F.expr("case page_id % 5 when 0 then 'page_header' when 1 then 'section_header' when 2 then 'formula' when 3 then 'list_item' else 'text' end")
    kind, text = y.classified(label, F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")), F.lit("orig"))
    return read(spark, sf_dir, "pages").select("page_id", kind.alias("type"), text.alias("text"))


@register("s16_backend_objects", """SELECT page_id AS doc_id, 1 AS page, 0 AS seq, 'heading' AS type, url AS text, 10.0 AS x0, 742.0 AS y0, 60.0 AS x1, 792.0 AS y1 FROM pages
  UNION ALL SELECT page_id, 1, 2, 'paragraph', 'orig', 5.0, 20.0, 30.0, 40.0 FROM pages""")
def s16(spark, sf_dir):
    box = lambda l, t, r, b, o: F.array(F.struct(F.lit(1).alias("page_no"), F.struct(F.lit(l).alias("l"), F.lit(t).alias("t"), F.lit(r).alias("r"), F.lit(b).alias("b"), F.lit(o).alias("coord_origin")).alias("bbox")))  # noqa: E731, E741
    item = lambda label, text, prov: F.struct(F.lit(label).alias("label"), text.alias("text"), F.lit("orig").alias("orig"), prov.alias("prov"))
    texts = F.array(
        item("section_header", F.col("url"), box(10.0, 50.0, 60.0, 100.0, "TOPLEFT")), item("page_footer", F.lit("1"), box(0.0, 0.0, 1.0, 1.0, "TOPLEFT")),
        item("text", F.lit(""), box(5.0, 40.0, 30.0, 20.0, "BOTTOMLEFT")),
    )
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.to_json(F.struct(texts.alias("texts"))).alias("json"))
    return y.docling_objects(rows, rows.select("doc_id", F.lit(1).alias("page"), F.lit(842.0).alias("height")))


@register("a15_table_quality", """WITH c AS (SELECT doc_id, 0 AS page, doc_id % 2 AS t, (i // 3) AS r, i % 3 AS c, CASE WHEN (doc_id + i) % 4 = 0 THEN ' ' WHEN i % 3 = 2 THEN NULL ELSE 'a' || chr(10) || 'b' END AS text FROM documents, range(9) x(i))
  SELECT doc_id, page, t AS "table", count(DISTINCT r) AS "rows", count(DISTINCT c) AS "columns", count(DISTINCT CASE WHEN trim(text) <> '' THEN r END) AS filled_rows, count(DISTINCT CASE WHEN trim(text) <> '' THEN c END) AS filled_columns, (count_if(trim(text) <> '') * 2)::BIGINT AS lines FROM c GROUP BY ALL""")
def a15(spark, sf_dir):
    i = F.col("i")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"))
    text = F.when((F.col("doc_id") + i) % 4 == 0, " ").when(i % 3 == 2, None).otherwise("a\nb")
    return y.table_quality(rows.select("doc_id", F.lit(0).alias("page"), (F.col("doc_id") % 2).alias("table"), F.floor(i / 3).alias("row"), (i % 3).alias("col"), text.alias("text")))


@register("g8_clustered_cells", f"""WITH {OBJECTS}, t AS (SELECT * FROM o WHERE kind = 'text'), a AS (SELECT *, coalesce(-y1 - max(-y0) OVER (PARTITION BY doc_id, page ORDER BY -y1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 0, true)::INT AS f FROM t),
  b AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, page ORDER BY -y1, seq) AS "row" FROM a), c AS (SELECT *, coalesce(x0 - max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 10, true)::INT AS f2 FROM b),
  d AS (SELECT *, sum(f2) OVER (PARTITION BY doc_id, page ORDER BY x0, seq) AS col FROM c) SELECT doc_id, page, seq, "row", col FROM d QUALIFY max("row") OVER (PARTITION BY doc_id, page) > 1 AND max(col) OVER (PARTITION BY doc_id, page) > 1""")
def g8(spark, sf_dir):
    return y.clustered_cells(objects(spark, sf_dir).filter("kind = 'text'")).select("doc_id", "page", "seq", "row", "col")


SAID = "CASE kind WHEN 'heading' THEN 'HEADING' WHEN 'image' THEN 'FIGURE' WHEN 'line' THEN 'FORMULA' WHEN 'art' THEN 'TABLE' ELSE ['PARAGRAPH', 'LIST_ITEM', 'NOTE', 'PAGE_FOOTER'][seq % 4 + 1] END"


@register("s16_category_objects", f"""WITH {OBJECTS}, c AS (SELECT *, {SAID} AS said, y1 - (seq % 10) // 2 * 50 AS top FROM o), k AS (SELECT * FROM c WHERE said <> 'PAGE_FOOTER' AND NOT (said = 'NOTE' AND text = '')),
  t AS (SELECT *, CASE said WHEN 'HEADING' THEN 'heading' WHEN 'FIGURE' THEN 'picture' WHEN 'FORMULA' THEN 'formula' WHEN 'TABLE' THEN 'table' ELSE 'paragraph' END AS type FROM k),
  f AS (SELECT *, coalesce(lag(top) OVER d - top > 5, true)::INT AS fresh, CASE WHEN type = 'picture' THEN count(*) FILTER (type = 'picture') OVER (PARTITION BY doc_id ORDER BY seq) END AS picture FROM t WINDOW d AS (PARTITION BY doc_id, page ORDER BY top DESC, x0, seq)),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY top DESC, x0, seq) AS band FROM f)
  SELECT doc_id, page + 1 AS page, seq, type, CASE WHEN type NOT IN ('table', 'picture') THEN text END AS text, CASE WHEN type = 'heading' THEN 1 END AS heading_level, picture, x0, top - (y1 - y0) AS y0, x1, top AS y1, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, x0, seq) AS place FROM g""")
def s16_categories(spark, sf_dir):
    """All lines as a backend would return them, one JSON text for each document."""
    o = objects(spark, sf_dir)
    text = F.element_at(F.array(*map(F.lit, ("PARAGRAPH", "LIST_ITEM", "NOTE", "PAGE_FOOTER"))), (F.col("seq") % 4 + 1).cast("int"))
    said = F.when(F.col("kind") == "heading", "HEADING").when(F.col("kind") == "image", "FIGURE").when(F.col("kind") == "line", "FORMULA").when(F.col("kind") == "art", "TABLE").otherwise(text)
    top = F.col("y1") - F.floor(F.col("seq") % 10 / 2) * 50
    box = F.struct(F.col("x0").alias("left"), (842.0 - top).alias("top"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    element = F.struct("seq", F.struct(said.alias("type")).alias("category"), F.col("page").alias("pageIndex"), box.alias("bbox"), F.struct("text").alias("content"))
    rows = o.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(element)).alias("elements"))).alias("json"))
    return y.category_objects(rows)
