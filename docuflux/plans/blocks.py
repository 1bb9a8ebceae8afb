"""Queries of text lines, paragraphs, headings, lists, levels and page edges, over the objects of plans.layout."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.operators import blocks as b
from docuflux.operators import layout as lay
from docuflux.operators import paragraphs as pg
from docuflux.operators import run
from docuflux.registry import register
from docuflux.session import parts_for

from .layout import OBJECTS, objects
from .text import read

P = "(PARTITION BY doc_id, page ORDER BY seq)"


@register("p4_visible", f"WITH {OBJECTS} SELECT doc_id, page, seq FROM o WHERE NOT (kind = 'text' AND contrast < 1.2) AND NOT hidden")
def p4(spark, sf_dir):
    return b.visible(objects(spark, sf_dir)).select("doc_id", "page", "seq")


@register("p7_layers", f"WITH {OBJECTS} SELECT doc_id, count(*) AS shown, count_if(NOT hidden) AS without_hidden FROM o WHERE NOT (kind = 'text' AND contrast < 1.0) GROUP BY 1")
def p7(spark, sf_dir):
    o = objects(spark, sf_dir)
    return b.visible(o, 1.0, layers=False).groupBy("doc_id").agg(F.count("*").alias("shown"), F.count_if(~F.col("hidden")).alias("without_hidden"))


MOVED = f"""{OBJECTS}, m AS (SELECT * REPLACE (CASE WHEN kind = 'image' THEN 50.0 + ((seq + 1) % 2) * 280 + 0.5 ELSE x0 END AS x0, CASE WHEN kind = 'image' THEN 50.0 + ((seq + 1) % 2) * 280 + 1 + doc_id % 3 ELSE x1 END AS x1,
  CASE WHEN kind = 'image' THEN y0 + 60 ELSE y0 END AS y0, CASE WHEN kind = 'image' THEN y1 + 60 ELSE y1 END AS y1) FROM o)"""


def moved(spark, sf_dir):
    """Objects with images laid over the text before them."""
    image, side = F.col("kind") == "image", 50.0 + (F.col("seq") + 1) % 2 * 280
    o = objects(spark, sf_dir)
    return o.withColumns({"x0": F.when(image, side + 0.5).otherwise(F.col("x0")), "x1": F.when(image, side + 1 + F.col("doc_id") % 3).otherwise(F.col("x1")), "y0": F.when(image, F.col("y0") + 60).otherwise(F.col("y0")), "y1": F.when(image, F.col("y1") + 60).otherwise(F.col("y1"))})


@register("p6_decoration", f"""WITH {MOVED}, t AS (SELECT *, last_value(CASE WHEN kind = 'text' THEN x0 END IGNORE NULLS) OVER {P} AS tx0, last_value(CASE WHEN kind = 'text' THEN x1 END IGNORE NULLS) OVER {P} AS tx1,
  last_value(CASE WHEN kind = 'text' THEN y0 END IGNORE NULLS) OVER {P} AS ty0, last_value(CASE WHEN kind = 'text' THEN y1 END IGNORE NULLS) OVER {P} AS ty1 FROM m)
  SELECT doc_id, page, seq FROM t WHERE NOT coalesce(kind = 'image' AND abs(y1 - ty1) <= 0.3 * (ty1 - ty0) AND abs(y0 - ty0) <= 0.1 * (ty1 - ty0) AND (abs(x0 - tx0) <= 0.1 * (ty1 - ty0) OR x0 > tx0) AND (abs(x1 - tx1) <= 1.5 * (ty1 - ty0) OR x1 < tx1), false)""")
def p6(spark, sf_dir):
    return b.undecorated(moved(spark, sf_dir)).select("doc_id", "page", "seq")


@register("p8_zones", f"WITH {OBJECTS} SELECT doc_id, page, seq, y0 >= 842.0 * 2 / 3 AS in_head, y1 <= 842.0 / 3 AS in_foot FROM o")
def p8(spark, sf_dir):
    return objects(spark, sf_dir).select("doc_id", "page", "seq", b.in_zone(True, F.lit(842.0)).alias("in_head"), b.in_zone(False, F.lit(842.0)).alias("in_foot"))


RULED = f"""{OBJECTS}, m AS (SELECT * REPLACE (CASE WHEN kind = 'line' THEN 50.0 + ((seq + 1) % 2) * 280 ELSE x0 END AS x0, CASE WHEN kind = 'line' THEN 50.0 + ((seq + 1) % 2) * 280 + 20 + (doc_id * 37 + seq * 11) % 300 ELSE x1 END AS x1,
  CASE WHEN kind = 'line' THEN y0 + 66 ELSE y0 END AS y0, CASE WHEN kind = 'line' THEN y0 + 67 ELSE y1 END AS y1) FROM o)"""


@register("p13_struck", f"""WITH {RULED}, h AS (SELECT t.doc_id, t.page, t.seq, l.seq AS line FROM m t JOIN m l ON l.doc_id = t.doc_id AND l.page = t.page AND l.kind = 'line' WHERE t.kind = 'text' AND length(trim(t.text)) > 0 AND t.y1 > t.y0 AND t.x1 > t.x0
  AND l.y1 - l.y0 <= 1.3 * (t.y1 - t.y0) AND abs((l.y0 + l.y1) / 2 - (t.y0 + t.y1) / 2) <= 0.2 * (t.y1 - t.y0) AND least(t.x1, l.x1) > greatest(t.x0, l.x0) AND (least(t.x1, l.x1) - greatest(t.x0, l.x0)) / (t.x1 - t.x0) >= 0.8 AND (l.x1 - l.x0) / (t.x1 - t.x0) <= 1.5)
  SELECT DISTINCT doc_id, page, seq FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, page, line) AS n FROM h) WHERE n = 1""")
def p13(spark, sf_dir):
    line, side = F.col("kind") == "line", 50.0 + (F.col("seq") + 1) % 2 * 280
    o = objects(spark, sf_dir)
    return b.struck(o.withColumns({"x0": F.when(line, side).otherwise(F.col("x0")), "x1": F.when(line, side + 20 + (F.col("doc_id") * 37 + F.col("seq") * 11) % 300).otherwise(F.col("x1")), "y0": F.when(line, F.col("y0") + 66).otherwise(F.col("y0")), "y1": F.when(line, F.col("y0") + 67).otherwise(F.col("y1"))}))


#: Chunks of a baseline: four to a line, each beginning where the one before it ends, or apart.
CHUNKS = f"""{OBJECTS}, q AS (SELECT * REPLACE (50.0 + (seq % 4) * 20 + CASE WHEN seq % 8 = 6 THEN 9 ELSE 0 END AS x0, 70.0 + (seq % 4) * 20 AS x1, 700.0 - (seq % 10) // 4 * 20 AS y0, 710.0 - (seq % 10) // 4 * 20 AS y1, 702.0 - (seq % 10) // 4 * 20 AS baseline, 10.0 + seq // 40 % 2 AS font_size, 400.0 AS font_weight, 'c' AS color) FROM o)"""


def chunks(spark, sf_dir):
    s, o = F.col("seq"), objects(spark, sf_dir)
    row = F.floor(s % 10 / 4) * 20
    return o.withColumns({
        "x0": 50.0 + s % 4 * 20 + F.when(s % 8 == 6, 9).otherwise(0), "x1": 70.0 + s % 4 * 20, "y0": 700.0 - row, "y1": 710.0 - row, "baseline": 702.0 - row, "font_size": 10.0 + F.floor(s / 40) % 2,
        "font_weight": F.lit(400.0), "color": F.lit("c")
    })


LAGS = ", ".join(f"lag({c}) OVER {P} AS p_{c}" for c in ("kind", "font_size", "baseline", "x0", "y0", "x1", "y1"))


@register("w5_merged_chunks", f"""WITH {CHUNKS}, near AS (SELECT *, {LAGS} FROM q),
  f AS (SELECT *, NOT coalesce(p_kind = 'text' AND kind = 'text' AND p_font_size = font_size AND abs(p_baseline - baseline) <= 0.1 * (p_y1 - p_y0) AND abs(p_x1 - x0) <= 0.1 * (p_y1 - p_y0), false) AS fresh FROM near),
  r AS (SELECT *, sum(fresh::INT) OVER {P} AS run FROM f) SELECT doc_id, page, max(seq) AS seq, count(*) AS n, string_agg(coalesce(text, ''), '' ORDER BY seq) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM r GROUP BY doc_id, page, run""")
def w5(spark, sf_dir):
    return b.merged_chunks(chunks(spark, sf_dir))


LINES = f"""{CHUNKS}, lt AS (SELECT *, {LAGS} FROM q WHERE kind = 'text'),
  lf AS (SELECT *, NOT coalesce(least(p_y1, y1) - greatest(p_y0, y0) >= 0.5 * least(p_y1 - p_y0, y1 - y0) AND x0 >= p_x0, false) AS fresh FROM lt), ln AS (SELECT *, sum(fresh::INT) OVER {P} AS line FROM lf)"""


@register("w7_lines", f"WITH {LINES} SELECT doc_id, page, seq, line FROM ln")
def w7(spark, sf_dir):
    return b.text_lines(chunks(spark, sf_dir)).select("doc_id", "page", "seq", "line")


PARAGRAPHS = f"""{LINES}, li AS (SELECT doc_id, page, max(seq) AS seq, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(font_size) AS font_size FROM ln GROUP BY doc_id, page, line),
  lg AS (SELECT *, lag(x0) OVER {P} AS px0, lag(y0) OVER {P} AS py0, lag(x1) OVER {P} AS px1, lag(y1) OVER {P} AS py1, lag(font_size) OVER {P} AS pf FROM li), hh AS (SELECT *, least(y1 - y0, py1 - py0) AS h FROM lg),
  al AS (SELECT *, CASE WHEN abs(pf - font_size) <= 0.1 * h AND py0 - y1 <= h AND py0 >= y0 THEN CASE WHEN abs(px0 - x0) <= 0.1 * h AND abs(px1 - x1) <= 0.1 * h THEN 'justify' WHEN abs(px0 - x0) <= 0.1 * h THEN 'left'
    WHEN abs(px0 + px1 - x0 - x1) <= 0.2 * h THEN 'centre' WHEN abs(px1 - x1) <= 0.1 * h THEN 'right' WHEN px0 > x0 AND px0 - x0 <= 3 * h THEN 'first line' END END AS alignment FROM hh),
  pa AS (SELECT *, sum((alignment IS NULL)::INT) OVER {P} AS paragraph FROM al)"""


@register("w8_aligned_runs", f"WITH {PARAGRAPHS} SELECT doc_id, page, seq, alignment, paragraph FROM pa")
def w8(spark, sf_dir):
    rows = b.text_lines(chunks(spark, sf_dir))
    lines = rows.groupBy("doc_id", "page", "line").agg(F.max("seq").alias("seq"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1", "font_size")]).drop("line")
    return b.paragraphs(lines).select("doc_id", "page", "seq", "alignment", "paragraph")


def set_lines(spark, sf_dir):
    """Whole documents as set lines: each of their lines is cut into rows of 60 characters, eight to a
    page; a document is set justified (every other first row moved in), left, centred or right, by
    its id, and with or without room between its lines."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "whole"))
    i, p, way = F.col("i"), F.col("p"), F.col("doc_id") % 4
    cut = rows.select("doc_id", "p", "whole", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("whole"), F.lit(1)) - 1) / 60).cast("int"))).alias("i"))
    page = Window.partitionBy("doc_id", "page").orderBy("p", "i")
    dealt = cut.select("doc_id", F.floor(p / 8).cast("long").alias("page"), "p", "i", F.trim(F.expr("substring(whole, i * 60 + 1, 60)")).alias("text")).repartition(parts_for(docs), "doc_id", "page")
    flat = dealt.withColumn("seq", F.row_number().over(page).cast("long"))
    wide = F.when((way == 0) & (F.length("text") > 55), 300.0).otherwise(F.length("text") * 5.0)
    left = F.when(way == 2, 200.0 - wide / 2).when(way == 3, 350.0 - wide).otherwise(50.0 + F.when((way == 0) & (i == 0) & (p % 2 == 0), 20.0).otherwise(0.0))
    right = F.when((way == 0) & (i == 0) & (p % 2 == 0), F.least(left + wide, F.lit(350.0))).otherwise(left + wide)
    y0 = 20000.0 - F.col("seq") * 14 - F.when(F.col("doc_id") % 3 > 0, p % 8 * 10).otherwise(0)
    return flat.select("doc_id", "page", "seq", left.alias("x0"), y0.alias("y0"), right.alias("x1"), (y0 + 10).alias("y1"), "text", (10.0 + p % 8 % 7 % 2).alias("font_size"), F.lit(400.0).alias("font_weight"), F.lit("c").alias("color"))


@register("w8_paragraphs")
def w8_paragraphs(spark, sf_dir):
    """The nine passes over all documents; a plain version is in the tests."""
    return pg.detected(set_lines(spark, sf_dir))


BOOST = """c{n} AS (SELECT doc_id, page, {v}, count(*) AS n FROM o GROUP BY ALL), m{n} AS (SELECT *, coalesce(arg_min({v}, (-n, {v})) FILTER ({v} BETWEEN {lo} AND {hi}) OVER (PARTITION BY doc_id, page), 0) AS m FROM c{n}),
  b{n} AS (SELECT doc_id, page, {v}, row_number() OVER (PARTITION BY doc_id, page ORDER BY {v}) / count(*) OVER (PARTITION BY doc_id, page) AS boost FROM m{n} WHERE {v} > m AND {v} BETWEEN {a} AND {z})"""
RARE = BOOST.format(n=1, v="font_size", lo=10, hi=13, a=10, z=32) + ",\n  " + BOOST.format(n=2, v="font_weight", lo=395, hi=405, a=400, z=900)


@register("f26_rarity", f"WITH {OBJECTS}, {RARE} SELECT doc_id, page, seq, round(coalesce(b1.boost, 0), 6) AS rarity FROM o LEFT JOIN b1 USING (doc_id, page, font_size)")
def f26(spark, sf_dir):
    out = b.rarity(objects(spark, sf_dir), "font_size", b.SIZE_MODE, b.SIZE_RANGE, lay.PAGE, "rarity")
    return out.select("doc_id", "page", "seq", F.round("rarity", 6).alias("rarity"))


@register("w9_headings", f"""WITH {OBJECTS}, {RARE}, sc AS (SELECT doc_id, page, seq, 0.2 + 0.5 * coalesce(b1.boost, 0) + 0.3 * coalesce(b2.boost, 0) + CASE WHEN regexp_matches(text, '{b.LABEL}') THEN 0.1 ELSE 0 END AS score
  FROM o LEFT JOIN b1 USING (doc_id, page, font_size) LEFT JOIN b2 USING (doc_id, page, font_weight)) SELECT doc_id, page, seq, round(score, 6) AS score, round(score, 9) > 0.75 AS heading FROM sc""")
def w9(spark, sf_dir):
    out = b.headings(objects(spark, sf_dir), F.lit(0.2))
    return out.select("doc_id", "page", "seq", F.round("score", 6).alias("score"), (F.round("score", 9) > b.HEADING).alias("heading"))


@register("w10_styled_levels", f"""WITH {OBJECTS}, h AS (SELECT * FROM o WHERE kind = 'heading'), c AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC, font_weight DESC, color) AS level FROM h WHERE color IS NOT NULL),
  n AS (SELECT h.doc_id, h.seq, coalesce(arg_min(c.level, (abs(h.font_size - c.font_size), c.level)), 1) AS level FROM h LEFT JOIN c ON c.doc_id = h.doc_id WHERE h.color IS NULL GROUP BY ALL)
  SELECT doc_id, seq, level FROM c UNION ALL SELECT doc_id, seq, level FROM n""")
def w10(spark, sf_dir):
    return b.styled_levels(objects(spark, sf_dir).filter("kind = 'heading'")).select("doc_id", "seq", "level")


@register("w17_shown_levels", f"""WITH RECURSIVE {OBJECTS}, h AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i, dense_rank() OVER (PARTITION BY doc_id ORDER BY seq % 4) AS step FROM o WHERE kind = 'heading'),
  r AS (SELECT doc_id, seq, i, 1 AS shown FROM h WHERE i = 1 UNION ALL SELECT h.doc_id, h.seq, h.i, least(h.step, r.shown + 1) FROM r JOIN h ON h.doc_id = r.doc_id AND h.i = r.i + 1) SELECT doc_id, seq, shown FROM r""")
def w17(spark, sf_dir):
    rows = objects(spark, sf_dir).filter("kind = 'heading'").withColumn("level", (F.col("seq") % 4).cast("int"))
    return b.normal_levels(rows).select("doc_id", "seq", "shown")


@register("w11_page_edges")
def w11(spark, sf_dir):
    """Pages of documents whose first line is a running head with the page's number, and second one too on every other document."""
    head = F.concat(F.lit("Report page "), F.col("page"))
    first, second = F.col("seq") % 10 == 0, (F.col("seq") % 10 == 1) & (F.col("doc_id") % 2 == 0)
    rows = objects(spark, sf_dir).withColumns({"text": F.when(first, head).when(second, "Same").otherwise(F.col("text")), "kind": F.when(first | second, "text").otherwise(F.col("kind"))})
    rows = rows.withColumns({"font_size": F.lit(10.0), "y0": F.when(second, F.col("y0") + 40).otherwise(F.col("y0")), "y1": F.when(second, F.col("y1") + 40).otherwise(F.col("y1"))})
    return b.page_edges(rows, F.lit(842.0))


@register("w14_lists")
def w14(spark, sf_dir):
    mark = F.expr("case when seq % 8 < 3 then concat(seq % 8 + 1, '. ') when seq % 8 in (4, 6) then '• ' else '' end")
    return b.labelled_lists(objects(spark, sf_dir).withColumn("text", F.concat(mark, F.col("text"))))


@register("w21_bulleted", f"WITH {OBJECTS} SELECT doc_id, page, seq FROM o WHERE regexp_matches(CASE WHEN seq % 3 = 0 THEN '(' || seq % 200 || ') ' ELSE '' END || text, '{b.LABEL}')")
def w21(spark, sf_dir):
    marked = F.concat(F.when(F.col("seq") % 3 == 0, F.concat(F.lit("("), F.col("seq") % 200, F.lit(") "))).otherwise(""), F.col("text"))
    return objects(spark, sf_dir).filter(b.bulleted(marked)).select("doc_id", "page", "seq")


@register("w15_levels")
def w15(spark, sf_dir):
    o = objects(spark, sf_dir)
    kind = F.when(F.col("kind") == "heading", "heading").when(F.col("seq") % 5 == 1, "list").when(F.col("seq") % 5 == 2, "table").otherwise("text")
    linked = F.when((F.col("seq") % 5 == 2) & (F.col("seq") % 3 == 0) & (F.col("seq") > 5), F.col("seq") - 5)
    return b.levels(o.select("doc_id", "seq", kind.alias("type"), (F.col("seq") % 2 + 1).cast("int").alias("heading_level"), F.concat(kind, F.col("seq") % 4).alias("style"), linked.alias("linked")))


@register("w16_ids", f"WITH {OBJECTS} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY page, seq) AS id FROM o")
def w16(spark, sf_dir):
    return b.numbered(objects(spark, sf_dir)).select("doc_id", "seq", "id")


TABLES = f"""{OBJECTS}, tb AS (SELECT doc_id, seq, CASE WHEN seq % 3 = 1 THEN 'header' WHEN seq % 4 = 3 THEN 'text' ELSE 'table' END AS kind, (2 + seq // 6 % 2)::INT AS columns, [100.0, 50.0 + (seq % 12) // 6 * 0.1 + CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END]::DOUBLE[] AS widths FROM o)"""


@register("w12_linked_tables", f"""WITH {TABLES}, n AS (SELECT *, lead(seq) OVER w AS next_seq, lead(kind) OVER w AS nk, lead(columns) OVER w AS nc, lead(widths) OVER w AS nw FROM tb WHERE kind <> 'header' WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
  SELECT doc_id, seq, next_seq FROM n WHERE kind = 'table' AND nk = 'table' AND columns = nc AND abs(widths[1] - nw[1]) <= 0.2 AND abs(widths[2] - nw[2]) <= 0.2 AND abs(list_sum(widths) - list_sum(nw)) <= 0.2""")
def w12(spark, sf_dir):
    s = F.col("seq")
    rows = objects(spark, sf_dir).select(
        "doc_id", "seq", F.when(s % 3 == 1, "header").when(s % 4 == 3, "text").otherwise("table").alias("kind"), (2 + F.floor(s / 6) % 2).cast("int").alias("columns"),
        F.array(F.lit(100.0), 50.0 + F.floor(s % 12 / 6) * 0.1 + F.when(s % 5 == 0, 1).otherwise(0)).alias("widths"),
    )
    return b.linked_tables(rows)


@register("j16_captions", f"""WITH {OBJECTS}, c AS (SELECT *, CASE WHEN kind = 'text' AND length(trim(text)) > 0 THEN 0.6 + (seq % 5) / 10.0 END AS p FROM o),
  n AS (SELECT *, last_value(CASE WHEN p IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS bs, coalesce(last_value(p IGNORE NULLS) OVER b, 0) AS bp, first_value(CASE WHEN p IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS xs, coalesce(first_value(p IGNORE NULLS) OVER a, 0) AS xp FROM c
    WINDOW b AS (PARTITION BY doc_id, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id, page ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  SELECT doc_id, page, CASE WHEN bp > xp THEN bs ELSE xs END AS seq, seq AS float_seq FROM n WHERE kind = 'image' AND greatest(bp, xp) >= 0.75""")
def j16(spark, sf_dir):
    return b.captions(objects(spark, sf_dir), 0.6 + F.col("seq") % 5 / 10)


@register("g10_address_tables", r"""WITH d AS (SELECT doc_id, 0 AS page, unnest(range(8)) AS seq FROM documents), x AS (SELECT doc_id, page, seq, CASE seq WHEN 1 THEN '(수신) a : b' || doc_id WHEN 2 THEN '경유' WHEN 4 + doc_id % 3 THEN '제목: ' || doc_id ELSE 'text' END AS text FROM d),
  h AS (SELECT *, regexp_matches(text, '^\(?(수신|경유|제목)\)?.*') AS hit FROM x), g AS (SELECT *, coalesce(hit AND lag(hit) OVER (PARTITION BY doc_id, page ORDER BY seq), false) AS goes_on FROM h),
  r AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id, page ORDER BY seq) AS run FROM g)
  SELECT doc_id, page, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY run) AS "table", row_number() OVER (PARTITION BY doc_id, page, run ORDER BY seq) AS "row",
    CASE WHEN contains(text, ':') THEN trim(split_part(text, ':', 1)) ELSE text END AS "first", CASE WHEN contains(text, ':') THEN trim(substr(text, instr(text, ':') + 1)) END AS "second" FROM r WHERE hit""".replace("\\\\", "\\"))
def g10(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seq"))
    text = F.when(F.col("seq") == 1, F.concat(F.lit("(수신) a : b"), F.col("doc_id"))).when(F.col("seq") == 2, "경유").when(F.col("seq") == 4 + F.col("doc_id") % 3, F.concat(F.lit("제목: "), F.col("doc_id"))).otherwise("text")
    return b.address_tables(rows.withColumn("text", text))


def set_objects(spark, sf_dir):
    """set_lines as page objects: each line in two texts, the first lines of pages in large bold type, labels
    on the second to fourth; with tiny text, art behind the page and text beside it among them."""
    rows = set_lines(spark, sf_dir)
    seq, half = F.col("seq"), F.floor(F.length("text") / 2).cast("int")
    label = F.when(seq.between(2, 4), F.concat((seq - 1).cast("string"), F.lit(". "))).otherwise("")
    part = lambda n, kind, text, x0, x1, y1: F.struct((seq * 8 + n).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"), x0.alias("x0"), x1.alias("x1"), y1.alias("y1"))
    middle = F.col("x0") + (F.col("x1") - F.col("x0")) / 2
    parts = [
        part(0, "text", F.concat(label, F.substring("text", F.lit(1), half)), F.col("x0"), middle, F.col("y1")), part(1, "text", F.expr("substring(text, cast(length(text) / 2 as int) + 1)"), middle, F.col("x1"), F.col("y1")),
        part(2, "text", F.lit("tiny"), F.col("x0"), middle, F.col("y0") + 1), part(3, "art", F.lit(None).cast("string"), F.lit(0.0), F.lit(595.0), F.lit(30000.0)), part(4, "text", F.lit("beside"), F.lit(-90.0), F.lit(-10.0), F.col("y1")),
    ]
    flat = rows.select("doc_id", "page", "y0", F.when(seq == 1, 14.0).otherwise(F.lit(10.0)).alias("font_size"), F.when(seq == 1, 700.0).otherwise(400.0).alias("font_weight"), "color", F.explode(F.array(*parts)).alias("p"))
    return flat.select("doc_id", "page", "p.seq", "p.kind", "p.text", "p.x0", F.when(F.col("p.kind") == "art", 0.0).otherwise(F.col("y0")).alias("y0"), "p.x1", "p.y1", "font_size", "font_weight", "color")


@register("b19_layout_run")
def b19(spark, sf_dir):
    """The whole run over all documents; the tests hold it against its steps one after the other."""
    return run.layout(set_objects(spark, sf_dir), F.lit(595.0), F.lit(30000.0), parts_for(read(spark, sf_dir, "documents")))
