"""The layout run against its steps one after the other, and its exchanges."""

import re

from pyspark.sql import functions as F

from docuflux.operators import blocks as b
from docuflux.operators import layout as lay
from docuflux.operators import lists as ls
from docuflux.operators import paragraphs as pg
from docuflux.operators import run
from docuflux.plans.blocks import set_objects
from docuflux.registry import queries

from .compare import TINY


def in_sequence(spark, objects):
    """Each step by its own operator, with its own shuffles and joins; rows by (doc_id, page, paragraph)."""
    size = objects.select("doc_id", "page").distinct().withColumns({"width": F.lit(595.0), "height": F.lit(30000.0)})
    lines = run.lines_of(b.text_lines(lay.filtered(objects, size)))
    found = {(r.doc_id, r.page, r.seq): r for r in pg.detected(lines).collect()}
    marked = {(r.doc_id, r.page, r.seq): r.heading for r in b.headings(lines, F.lit(0.0)).collect()}
    blocks = {}
    for r in lines.orderBy("doc_id", "page", "seq").collect():
        at = found[r.doc_id, r.page, r.seq]
        blocks.setdefault((r.doc_id, r.page, at.paragraph), []).append((at, r))
    rows = [(k[0], k[1], part[0][1].seq, "\n".join(r.text for _, r in part), min(r.x0 for _, r in part), part[0][1].font_size, part[0][1].font_weight, part[0][1].color, all(marked[r.doc_id, r.page, r.seq] for _, r in part)) for k, part in blocks.items()]
    frame = spark.createDataFrame(rows, "doc_id long, page long, seq long, text string, x0 double, font_size double, font_weight double, color string, heading boolean")
    items = {(r.doc_id, r.page, r.seq): r for r in ls.items(frame.filter("not heading")).collect()}
    level = {(r.doc_id, r.page, r.seq): r.level for r in b.styled_levels(frame.filter("heading")).collect()}
    ids = {(r.doc_id, r.page, r.seq): r.id for r in b.numbered(frame).collect()}
    deep = [(r[0], ids[r[:3]], "heading" if r[8] else "list", level.get(r[:3]), None if r[8] else f"{items[r[:3]].style}{r[4]}", None) for r in rows if r[8] or (r[:3] in items and items[r[:3]].item == 1)]
    levels = {(r.doc_id, r.seq): r.level for r in b.levels(spark.createDataFrame(deep, "doc_id long, seq long, type string, heading_level int, style string, linked long")).collect()}
    out = {}
    for (k, part), r in zip(blocks.items(), rows, strict=True):
        item = items.get(r[:3])
        kind = "heading" if r[8] else "list item" if item else "paragraph"
        out[k] = (ids[r[:3]], kind, r[3], len(part), part[0][0].alignment, level.get(r[:3]), levels.get((r[0], ids[r[:3]])), *((item.list_page, item.list_seq, item.item) if item else (None,) * 3))
    return out


def test_run_equals_its_steps(spark):
    got = {(r.doc_id, r.page, r.paragraph): tuple(r)[3:] for r in queries()["b19_layout_run"](spark, TINY).collect()}
    assert got == in_sequence(spark, set_objects(spark, TINY))
    kinds = [v[1] for v in got.values()]
    assert min(kinds.count(k) for k in ("heading", "list item", "paragraph")) > 50 and not any("tiny" in v[2] or "beside" in v[2] for v in got.values())


def test_two_exchanges(spark):
    """Setting the lines deals pages out; the run finds them so, and deals out once more, by document."""
    plan = queries()["b19_layout_run"](spark, TINY)._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert [re.findall(r"[a-z_]+(?=#)", keys) for keys in found] == [["doc_id"], ["doc_id", "page"]] and "Join" not in plan


def test_no_objects(spark):
    empty = spark.createDataFrame([], "doc_id long, page long, seq long, kind string, text string, x0 double, y0 double, x1 double, y1 double, font_size double, font_weight double, color string")
    assert run.layout(empty, F.lit(595.0), F.lit(842.0)).collect() == []
