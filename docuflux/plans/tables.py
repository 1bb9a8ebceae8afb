"""Queries of nested tables, row bands and clusters over the lines of all documents, in the boxes of plans.layout.

Each page has an outer table of two by two cells; a table in its upper right cell, whose two cells
stand apart; a table in a cell of that; and one of three columns in its lower left cell. Where
columns stand hangs on the document, so that lines straddle them differently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docuflux.operators import tables as tb
from docuflux.registry import register

from .layout import OBJECTS, objects, pages
from .text import read

#: table, row, col, x0, y0, x1, y1; m is where the outer table's columns meet.
CELLS = [
    (1, 0, 0, "60.0", 500, "m", 730), (1, 0, 1, "m", 500, "560.0", 730), (1, 1, 0, "60.0", 280, "m", 500), (1, 1, 1, "m", 280, "560.0", 500),
    (2, 0, 0, "m + 10", 560, "m + 70", 640), (2, 0, 1, "m + 74", 560, "550.0", 640), (2, 1, 0, "m + 10", 640, "m + 70", 725), (2, 1, 1, "m + 74", 640, "550.0", 725),
    (3, 0, 0, "m + 80", 645, "m + 190", 720), (3, 0, 1, "m + 190", 645, "540.0", 720),
    (4, 0, 0, "70.0", 290, "90.0", 490), (4, 0, 1, "90.0", 290, "m - 60", 490), (4, 0, 2, "m - 60", 290, "m - 10", 490),
]
MEET = "180.0 + doc_id % 5 * 30"
CELL = "(SELECT p.doc_id, p.page, " + '"table", "row", col, CASE i {x0} END::DOUBLE AS x0, y0, CASE i {x1} END::DOUBLE AS x1, y1 FROM (SELECT DISTINCT doc_id, page, {meet} AS m FROM o) p, (VALUES {rows}) v(i, "table", "row", col, y0, y1))'
CELL_SQL = CELL.format(
    meet=MEET, x0=" ".join(f"WHEN {i} THEN {c[3]}" for i, c in enumerate(CELLS)), x1=" ".join(f"WHEN {i} THEN {c[5]}" for i, c in enumerate(CELLS)),
    rows=", ".join(f"({i}, {t}, {r}, {c}, {y0}::DOUBLE, {y1}::DOUBLE)" for i, (t, r, c, _, y0, _, y1) in enumerate(CELLS)),
)


def cells(spark, sf_dir):
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip((t, r, c), ("table", "row", "col"), strict=True)], *[F.expr(f"double({v})").alias(n) for v, n in zip((x0, y0, x1, y1), tb.BOX, strict=True)]) for t, r, c, x0, y0, x1, y1 in CELLS]
    known = pages(spark, sf_dir).withColumn("m", F.expr(MEET))
    return known.select("doc_id", "page", F.explode(F.array(*rows)).alias("c")).select("doc_id", "page", "c.*")


TREE = f"""{OBJECTS}, cl AS MATERIALIZED {CELL_SQL}, tab AS (SELECT doc_id, page, "table", min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM cl GROUP BY ALL),
  up AS (SELECT t.doc_id, t.page, t."table" AS child, c."table" AS parent, c."row" AS prow, c.col AS pcol, (c.x1 - c.x0) * (c.y1 - c.y0) AS area FROM tab t JOIN cl c ON c.doc_id = t.doc_id AND c.page = t.page AND c."table" <> t."table"
    AND c.x0 <= t.x0 AND c.y0 <= t.y0 AND c.x1 >= t.x1 AND c.y1 >= t.y1),
  pa AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY doc_id, page, child ORDER BY area, parent DESC) = 1),
  tree AS (SELECT doc_id, page, "table", NULL::INT AS parent, NULL::INT AS parent_row, NULL::INT AS parent_col, 1 AS depth FROM tab WHERE ("table", doc_id, page) NOT IN (SELECT child, doc_id, page FROM pa)
    UNION ALL SELECT pa.doc_id, pa.page, pa.child, pa.parent, pa.prow, pa.pcol, tree.depth + 1 FROM tree JOIN pa ON pa.doc_id = tree.doc_id AND pa.page = tree.page AND pa.parent = tree."table")"""


@register("g9_table_forest", f'WITH RECURSIVE {TREE} SELECT doc_id, page, "table", parent, parent_row, parent_col, depth FROM tree')
def g9_forest(spark, sf_dir):
    return tb.forest(cells(spark, sf_dir)).drop(*tb.BOX)


def shown(rows):
    return rows.select("doc_id", "page", "seq", "part", F.coalesce("text", F.lit("")).alias("text"), F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"), "table", "row", "col", "depth")


#: Every bound at a line's height, then the deepest table around each part's middle.
PARTS = f"""{TREE}, tb AS (SELECT tree.depth, tab.* FROM tree JOIN tab USING (doc_id, page, "table")),
  lv AS MATERIALIZED (SELECT c.*, t.depth, t.x0 AS tx0, t.x1 AS tx1, t.y0 AS ty0, t.y1 AS ty1 FROM cl c JOIN tb t USING (doc_id, page, "table")),
  ob AS MATERIALIZED (SELECT *, (y0 + y1) / 2 AS my, (x0 + x1) / 2 AS mx FROM o),
  cand AS MATERIALIZED (SELECT ob.doc_id, ob.page, seq, kind, ob.x0 AS ox0, ob.x1 AS ox1, my, mx, lv.* EXCLUDE (doc_id, page) FROM ob JOIN lv ON lv.doc_id = ob.doc_id AND lv.page = ob.page AND my >= ty0 AND my < ty1),
  bound AS (SELECT DISTINCT doc_id, page, seq, x FROM (SELECT doc_id, page, seq, ox0, ox1, unnest([tx0, tx1] || CASE WHEN my >= y0 AND my < y1 THEN [x0, x1] ELSE [] END) AS x FROM cand WHERE kind = 'text') WHERE x > ox0 AND x < ox1
    UNION SELECT doc_id, page, seq, x0 FROM ob),
  piece AS (SELECT b.doc_id, b.page, b.seq, b.x AS a, coalesce(lead(b.x) OVER (PARTITION BY b.doc_id, b.page, b.seq ORDER BY b.x), ob.x1) AS b, ob.my, CASE WHEN kind = 'text' THEN NULL ELSE mx END AS mx FROM bound b JOIN ob USING (doc_id, page, seq)),
  own AS (SELECT p.doc_id, p.page, p.seq, p.a, p.b, c."table", c."row", c.col, c.depth, CASE WHEN coalesce(p.mx, (p.a + p.b) / 2) >= c.x0 AND coalesce(p.mx, (p.a + p.b) / 2) < c.x1 AND p.my >= c.y0 AND p.my < c.y1 THEN 0 ELSE 1 END AS apart,
    greatest(c.y0 - p.my, p.my - c.y1, 0) AS high, abs(coalesce(p.mx, (p.a + p.b) / 2) - (c.x0 + c.x1) / 2) AS wide FROM piece p LEFT JOIN cand c ON c.doc_id = p.doc_id AND c.page = p.page AND c.seq = p.seq AND coalesce(p.mx, (p.a + p.b) / 2) >= c.tx0 AND coalesce(p.mx, (p.a + p.b) / 2) < c.tx1
    QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.page, p.seq, p.a ORDER BY c.depth DESC NULLS LAST, apart, high, wide, c."table", c."row", c.col) = 1),
  br AS (SELECT *, coalesce(lag({{'t': "table", 'r': "row", 'c': col}}) OVER w IS DISTINCT FROM {{'t': "table", 'r': "row", 'c': col}}, true) OR row_number() OVER w = 1 AS fresh FROM own WINDOW w AS (PARTITION BY doc_id, page, seq ORDER BY a)),
  rn AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, page, seq ORDER BY a) AS run FROM br),
  mg AS (SELECT doc_id, page, seq, run, min(a) AS a, max(b) AS b, any_value("table") AS "table", any_value("row") AS "row", any_value(col) AS col, any_value(depth) AS depth FROM rn GROUP BY ALL),
  tx AS (SELECT mg.*, ob.text AS entire, a = ob.x0 AND b = ob.x1 AS alone, length(ob.text) AS n, ob.x0, ob.x1 FROM mg JOIN ob USING (doc_id, page, seq)),
  lt AS (SELECT *, CASE WHEN x1 > x0 THEN ceil((a - x0) * n / (x1 - x0) - 0.5) ELSE 0 END::INT AS i, CASE WHEN b = x1 THEN n ELSE ceil((b - x0) * n / (x1 - x0) - 0.5) END::INT AS j FROM tx),
  cu AS (SELECT *, CASE WHEN alone THEN entire ELSE substr(entire, i + 1, j - i) END AS text FROM lt)"""


@register("j15_nested_cells", f"""WITH RECURSIVE {PARTS} SELECT doc_id, page, seq, (row_number() OVER (PARTITION BY doc_id, page, seq ORDER BY a) - 1)::INT AS part, coalesce(text, '') AS text, round(a, 6) AS x0, round(b, 6) AS x1, "table", "row", col, depth
  FROM cu WHERE alone OR length(trim(text)) > 0""")
def j15_nested(spark, sf_dir):
    return shown(tb.placed(objects(spark, sf_dir), cells(spark, sf_dir)))


def near_baselines(spark, sf_dir):
    """Four texts to a line, whose baselines stray by some hundredths to either side of a tenth."""
    s, o = F.col("seq"), objects(spark, sf_dir)
    left = 50.0 + s % 4 * 120
    return o.withColumns({"x0": left, "x1": left + F.least(F.length("text"), F.lit(100)), "y0": F.lit(700.0), "y1": F.lit(710.0), "baseline": 702.0 - F.floor(s % 10 / 4) * 2 + ((F.col("doc_id") * 7 + s * 3) % 9 - 4) * 0.21})


STRAY = f"""{OBJECTS}, q AS (SELECT doc_id, page, seq, 50.0 + seq % 4 * 120 AS x0, 50.0 + seq % 4 * 120 + least(length(text), 100) AS x1, 702.0 - (seq % 10) // 4 * 2 + ((doc_id * 7 + seq * 3) % 9 - 4) * 0.21 AS baseline FROM o WHERE kind = 'text'),
  nu AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY baseline DESC, x0, seq) AS i FROM q),
  cl AS (SELECT doc_id, page, seq, x0, x1, i, 0 AS cluster, 1 AS n, baseline AS total FROM nu WHERE i = 1
    UNION ALL SELECT u.doc_id, u.page, u.seq, u.x0, u.x1, u.i, c.cluster + CASE WHEN abs(c.total / c.n - u.baseline) < 1.0 THEN 0 ELSE 1 END, CASE WHEN abs(c.total / c.n - u.baseline) < 1.0 THEN c.n + 1 ELSE 1 END,
      CASE WHEN abs(c.total / c.n - u.baseline) < 1.0 THEN c.total + u.baseline ELSE u.baseline END FROM cl c JOIN nu u ON u.doc_id = c.doc_id AND u.page = c.page AND u.i = c.i + 1)"""


@register("a9_aligned_groups", f"""WITH RECURSIVE {STRAY}, g AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY doc_id, page, cluster ORDER BY x0, seq) > 30, false) AS gap FROM cl),
  b AS (SELECT doc_id, page, cluster, bool_or(gap) AS gap FROM g GROUP BY ALL) SELECT doc_id, page, count_if(gap) AS groups FROM b GROUP BY ALL""")
def a9_groups(spark, sf_dir):
    return tb.aligned_groups(near_baselines(spark, sf_dir))


def lines_in_columns(spark, sf_dir):
    """Thirty lines of a document to a page, in three columns; rows stray by a point and a table's ruled rows are two."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("s", "text"))
    s, band = F.col("s"), F.floor(F.col("s") % 30 / 3)
    y0 = 700.0 - band * 20 + (F.col("doc_id") + s) % 3
    contents = rows.select("doc_id", F.floor(s / 30).cast("int").alias("page"), s.alias("seq"), F.lit(0).alias("part"), F.lit(1).alias("table"), (band > 4).cast("int").alias("row"), (s % 3).alias("col"), "text", (s % 3 * 100.0).alias("x0"), y0.alias("y0"), (s % 3 * 100.0 + 90).alias("x1"), (y0 + 10).alias("y1"))
    ruled = contents.select("doc_id", "page", "table").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return contents, ruled.select("doc_id", "page", "table", F.floor(F.col("i") / 3).cast("int").alias("row"), (F.col("i") % 3).alias("col"))


@register("w20_split_rows")
def w20(spark, sf_dir):
    return tb.split_rows(*lines_in_columns(spark, sf_dir)).select("doc_id", "page", "seq", "row", "col", "new_row")


def side_by_side(spark, sf_dir):
    """Two grids of four lines on each page, side by side, and two lines apart; lines are as wide as their text, up to fifty points."""
    k = F.col("seq") % 10
    left = F.when(k < 4, 50.0).when(k < 8, 300.0).otherwise(500.0) + k % 2 * 60
    y0 = 700.0 - F.floor(k % 4 / 2) * 20 - F.when(k > 7, k * 100).otherwise(0)
    return objects(spark, sf_dir).filter("kind = 'text'").select("doc_id", "page", "seq", left.alias("x0"), y0.alias("y0"), (left + F.least(F.length("text"), F.lit(50))).alias("x1"), (y0 + 10 + F.col("doc_id") % 3).alias("y1"))


GRIDS = f"""{OBJECTS}, t AS MATERIALIZED (SELECT doc_id, page, seq, x0, y0, x0 + least(length(text), 50) AS x1, y0 + 10 + doc_id % 3 AS y1 FROM (SELECT doc_id, page, seq, text,
    CASE WHEN seq % 10 < 4 THEN 50.0 WHEN seq % 10 < 8 THEN 300.0 ELSE 500.0 END + seq % 10 % 2 * 60 AS gx, 700.0 - (seq % 10 % 4) // 2 * 20 - CASE WHEN seq % 10 > 7 THEN seq % 10 * 100 ELSE 0 END AS gy FROM o WHERE kind = 'text') q, LATERAL (SELECT gx::DOUBLE AS x0, gy::DOUBLE AS y0) z(x0, y0)),
  nb AS MATERIALIZED (SELECT a.doc_id, a.page, a.seq AS u, b.seq AS v FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND (
    (least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0) AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 30) OR (least(a.x1, b.x1) > greatest(a.x0, b.x0) AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 20))),
  reach AS (SELECT doc_id, page, seq AS u, seq AS v FROM t UNION SELECT r.doc_id, r.page, r.u, n.v FROM reach r JOIN nb n ON n.doc_id = r.doc_id AND n.page = r.page AND n.u = r.v),
  gr AS (SELECT doc_id, page, u AS seq, min(v) AS "table" FROM reach GROUP BY ALL),
  b1 AS (SELECT *, coalesce(-y1 >= max(-y0) OVER (PARTITION BY doc_id, page, "table" ORDER BY -y1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS f FROM t JOIN gr USING (doc_id, page, seq)),
  b2 AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, page, "table" ORDER BY -y1, seq) AS "row", coalesce(x0 >= max(x1) OVER (PARTITION BY doc_id, page, "table" ORDER BY x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS f2 FROM b1),
  b3 AS (SELECT *, sum(f2) OVER (PARTITION BY doc_id, page, "table" ORDER BY x0, seq) AS col FROM b2)"""


@register("g8_borderless_tables", f"""WITH RECURSIVE {GRIDS} SELECT doc_id, page, seq, "table", "row", col FROM b3 QUALIFY max("row") OVER (PARTITION BY doc_id, page, "table") > 1 AND max(col) OVER (PARTITION BY doc_id, page, "table") > 1""")
def g8_borderless(spark, sf_dir):
    return tb.borderless(side_by_side(spark, sf_dir))
