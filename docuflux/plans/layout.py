"""Layout queries. Page objects are the lines of documents, ten to a page, put in boxes by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.operators import layout as lay
from docuflux.registry import register

from .text import read

OBJECTS = """l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
  u AS (SELECT doc_id, unnest(range(len(l))) AS s, unnest(l) AS text FROM l),
  o AS (SELECT doc_id, s // 10 AS page, s AS seq,
    CASE WHEN s % 11 = 10 THEN 'line' WHEN s % 23 = 22 THEN 'image' WHEN s % 29 = 28 THEN 'art' WHEN s % 7 = 0 THEN 'heading' ELSE 'text' END AS kind,
    50.0::DOUBLE + (s % 2) * 280 AS x0, 700.0::DOUBLE - (s % 10) * 60 AS y0, 50.0::DOUBLE + (s % 2) * 280 + least(length(text), 250) AS x1,
    700.0::DOUBLE - (s % 10) * 60 + CASE WHEN s % 13 = 12 THEN 1 ELSE 12 + (doc_id + s) % 3 END AS y1, text, 10.0::DOUBLE + (s % 5) AS font_size,
    CASE WHEN s % 5 = 0 THEN 700.0::DOUBLE ELSE 400.0::DOUBLE END AS font_weight, CASE WHEN s % 9 > 0 THEN 'c' || s % 3 END AS color, 702.0::DOUBLE - (s % 10) * 60 AS baseline,
    1.0::DOUBLE + (s % 10) / 10.0 AS contrast, s % 17 = 16 AS hidden FROM u)"""


def objects(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("s", "text"))
    s = F.col("s").cast("long")
    kind = F.when(s % 11 == 10, "line").when(s % 23 == 22, "image").when(s % 29 == 28, "art").when(s % 7 == 0, "heading").otherwise("text")
    x0, y0 = F.lit(50.0) + (s % 2) * 280, F.lit(700.0) - (s % 10) * 60
    return rows.select(
        "doc_id", F.floor(s / 10).cast("long").alias("page"), s.alias("seq"), kind.alias("kind"), x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.length("text"), F.lit(250))).alias("x1"),
        (y0 + F.when(s % 13 == 12, 1).otherwise(12 + (F.col("doc_id") + s) % 3)).alias("y1"), "text", (F.lit(10.0) + s % 5).alias("font_size"),
        F.when(s % 5 == 0, 700.0).otherwise(400.0).alias("font_weight"), F.when(s % 9 > 0, F.concat(F.lit("c"), s % 3)).alias("color"), (y0 + 2).alias("baseline"),
        (1.0 + (s % 10) / 10).alias("contrast"), (s % 17 == 16).alias("hidden"),
    )


def pages(spark, sf_dir):
    return objects(spark, sf_dir).select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height")).distinct()


@register("p2_filters", f"WITH {OBJECTS} SELECT doc_id, page, seq FROM o WHERE NOT (kind = 'text' AND y1 - y0 <= 1) AND NOT (x1 < 0 OR x0 > 595 OR y1 < 0 OR y0 > 842) AND NOT (kind = 'art' AND ((x1 - x0 > 297.5 AND y1 - y0 > 84.2) OR (x1 - x0 > 59.5 AND y1 - y0 > 421)))")
def p2(spark, sf_dir):
    return lay.filtered(objects(spark, sf_dir), pages(spark, sf_dir)).select("doc_id", "page", "seq")


@register("t7_placed", f"WITH {OBJECTS} SELECT doc_id, page, seq, row_number() OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, x0, y0, x1, seq) AS place FROM o")
def t7(spark, sf_dir):
    return lay.placed(objects(spark, sf_dir)).select("doc_id", "page", "seq", "place")


@register("w6_dedup", f"WITH {OBJECTS}, n AS (SELECT *, least(x1, lead(x1) OVER w) - greatest(x0, lead(x0) OVER w) AS wide, least(y1, lead(y1) OVER w) - greatest(y0, lead(y0) OVER w) AS high, lead(x0) OVER w IS NOT NULL AS more, lead(x1) OVER w - lead(x0) OVER w AS nw, lead(y1) OVER w - lead(y0) OVER w AS nh FROM o WINDOW w AS (PARTITION BY doc_id, page, text ORDER BY seq)) SELECT doc_id, page, seq FROM n WHERE NOT (kind = 'text' AND more AND abs((x1 - x0) - nw) <= 0.01 AND abs((y1 - y0) - nh) <= 0.01 AND wide > 0 AND high > 0 AND wide * high > 0.5 * (x1 - x0) * (y1 - y0))")
def w6(spark, sf_dir):
    return lay.deduped(objects(spark, sf_dir)).select("doc_id", "page", "seq")


SIGNALS = f"""WITH {OBJECTS}, k AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, kind = 'text' AND length(trim(text)) > 0 AS t FROM o), k1 AS (SELECT *, kind = 'line' AND w > 3 * h AS flat FROM k),
  v AS (SELECT *, last_value(CASE WHEN t THEN x0 END IGNORE NULLS) OVER b AS px0, last_value(CASE WHEN t THEN y0 END IGNORE NULLS) OVER b AS py0, last_value(CASE WHEN t THEN x1 END IGNORE NULLS) OVER b AS px1,
    last_value(CASE WHEN t THEN y1 END IGNORE NULLS) OVER b AS py1, last_value(CASE WHEN t THEN baseline END IGNORE NULLS) OVER b AS pb, last_value(CASE WHEN flat THEN true WHEN t THEN false END IGNORE NULLS) OVER b AS ruled
    FROM k1 WINDOW b AS (PARTITION BY doc_id, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  r0 AS (SELECT *, t AND coalesce(CASE WHEN py1 < y0 THEN NOT (px1 > px0 AND px0 - x0 > 2 * (px1 - px0)) ELSE abs(pb - baseline) < 0.1 * ((py1 - py0) + h) / 2 AND x0 - px1 > 1.5 * h END, false) AS odd FROM v),
  r AS (SELECT *, sum((t AND NOT odd)::INT) OVER (PARTITION BY doc_id, page ORDER BY seq) AS run FROM r0),
  st AS (SELECT doc_id, page, max(n) AS streak FROM (SELECT doc_id, page, run, count_if(odd) AS n FROM r GROUP BY ALL) GROUP BY ALL),
  al AS (SELECT DISTINCT a.doc_id, a.page FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.page = b.page AND a.seq <> b.seq AND a.flat AND b.flat AND abs(a.x0 - b.x0) <= 0.05 * greatest(a.w, b.w) AND abs(a.w - b.w) <= 0.05 * greatest(a.w, b.w) AND greatest(a.w, b.w) > 0),
  im AS (SELECT doc_id, page, max(w * h) AS area, arg_max(CASE WHEN h > 0 THEN w / h ELSE 0 END, (w * h, -seq)) AS aspect FROM r WHERE kind = 'image' GROUP BY ALL),
  c AS (SELECT doc_id, page, count(*) AS n, count_if(kind = 'line') AS lines, count_if(kind = 'art') AS arts, count_if(kind = 'text') AS texts, count_if(t) AS words, count_if(flat) AS flat, count_if(kind = 'line' AND NOT flat AND h > 3 * w) AS upright,
    count_if(flat AND NOT coalesce(ruled, false)) AS separators, count_if(odd) AS odd, sum(length(text)) AS chars, sum(length(text) - length(replace(text, chr(65533), ''))) AS lost FROM r GROUP BY ALL),
  s AS (SELECT c.*, streak, al.doc_id IS NOT NULL AS aligned, lines / n AS line_ratio, CASE WHEN words > 0 THEN odd / words ELSE 0 END AS density, coalesce(area / (595.0 * 842.0), 0) AS image_area, coalesce(aspect, 0) AS image_aspect,
    CASE WHEN chars > 0 THEN lost / chars ELSE 0 END AS lost_ratio FROM c LEFT JOIN st USING (doc_id, page) LEFT JOIN im USING (doc_id, page) LEFT JOIN al ON al.doc_id = c.doc_id AND al.page = c.page),
  d AS (SELECT *, CASE WHEN lost_ratio >= 0.3 THEN 1.0 WHEN (flat >= 3 AND upright >= 3) OR flat + upright >= 8 OR arts >= 8 OR separators >= 5 OR aligned THEN 0.95
    WHEN (streak >= 2 OR odd >= 30) AND (odd >= 3 OR (density >= 0.1 AND odd >= 2)) THEN 0.9 WHEN image_area >= 0.11 AND image_aspect >= 1.75 THEN 0.85 WHEN line_ratio > 0.3 THEN 0.8 END::DOUBLE AS sure FROM s),
  e AS (SELECT *, CASE WHEN sure IS NULL THEN 'LOCAL' ELSE 'BACKEND' END AS decision, coalesce(sure, 0.9) AS confidence FROM d)"""


@register("a8_triage", f"{SIGNALS} SELECT doc_id, page, n, lines, arts, texts, flat, upright, separators, odd, streak, aligned, round(density, 6) AS density, round(line_ratio, 6) AS line_ratio, round(image_area, 6) AS image_area, round(image_aspect, 6) AS image_aspect, decision, confidence FROM e")
def a8(spark, sf_dir):
    out = lay.routed(lay.signals(objects(spark, sf_dir), pages(spark, sf_dir)))
    near = {c: F.round(c, 6) for c in ("density", "line_ratio", "image_area", "image_aspect")}
    return out.withColumns(near).drop("lost_ratio", "tables")


@register("k10_triage_log", f"""{SIGNALS} SELECT doc_id, string_agg('{{"page":' || page || ',"decision":"' || decision || '","lines":' || lines || '}}', ',' ORDER BY page) AS log FROM e GROUP BY 1""")
def k10(spark, sf_dir):
    """The log of a document's routing: a JSON object for each page, in order."""
    out = lay.routed(lay.signals(objects(spark, sf_dir), pages(spark, sf_dir)))
    line = F.to_json(F.struct("page", "decision", "lines"))
    return out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", line.alias("j")))), lambda x: x["j"]), ",").alias("log"))


@register("a13_routing", f"{SIGNALS} SELECT decision, count(*) AS pages FROM e GROUP BY 1")
def a13(spark, sf_dir):
    return lay.routed(lay.signals(objects(spark, sf_dir), pages(spark, sf_dir))).groupBy("decision").agg(F.count("*").alias("pages"))


@register("w10_heading_levels", f"WITH {OBJECTS} SELECT doc_id, seq, font_size, dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC) AS level FROM o WHERE kind = 'heading'")
def w10(spark, sf_dir):
    return lay.heading_levels(objects(spark, sf_dir)).select("doc_id", "seq", "font_size", "level")


@register("t8_reading_order")
def t8(spark, sf_dir):
    return lay.reading_order(objects(spark, sf_dir))


@register("b5_captions", f"WITH {OBJECTS}, p AS (SELECT c.doc_id, c.page, c.seq, f.seq AS float_seq, abs((c.y0 + c.y1) / 2 - (f.y0 + f.y1) / 2) AS far FROM o c JOIN o f USING (doc_id, page) WHERE c.kind = 'heading' AND f.kind = 'image') SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, page, seq ORDER BY far, float_seq) = 1")
def b5(spark, sf_dir):
    o = objects(spark, sf_dir)
    return lay.nearest(o.filter("kind = 'heading'"), o.filter("kind = 'image'"))


@register("a9_baseline_groups", f"WITH {OBJECTS}, g AS (SELECT doc_id, page, round(baseline, 1) AS at_, coalesce(x0 - lag(x1) OVER (PARTITION BY doc_id, page, round(baseline, 1) ORDER BY x0, seq) > 3 * (y1 - y0), false) AS gap FROM o WHERE kind = 'text'), b AS (SELECT doc_id, page, at_, bool_or(gap) AS gap FROM g GROUP BY ALL) SELECT doc_id, page, count_if(gap) AS groups FROM b GROUP BY ALL")
def a9(spark, sf_dir):
    return lay.baseline_groups(objects(spark, sf_dir))


@register("a10_font_modes", f"WITH {OBJECTS}, c AS (SELECT doc_id, font_size, count(*) AS n FROM o WHERE kind = 'text' GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font_size) = 1")
def a10(spark, sf_dir):
    return lay.font_modes(objects(spark, sf_dir))


@register("a10_weight_modes", f"WITH {OBJECTS}, c AS (SELECT doc_id, font_weight, count(*) AS n FROM o WHERE kind = 'text' GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font_weight) = 1")
def a10_weights(spark, sf_dir):
    return lay.font_modes(objects(spark, sf_dir), "font_weight")


@register("a11_regions", f"WITH {OBJECTS}, r AS (SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum((x1 - x0) * (y1 - y0)) AS a FROM o GROUP BY ALL) SELECT doc_id, page, x0, y0, x1, y1, round(CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN least(1.0, a / ((x1 - x0) * (y1 - y0))) ELSE 1.0 END, 6) AS density FROM r")
def a11(spark, sf_dir):
    return lay.regions(objects(spark, sf_dir)).withColumn("density", F.round("density", 6))
