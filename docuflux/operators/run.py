"""A document's layout in one run: filters, lines, headings and paragraphs over pages that are shuffled once,
then levels, ids and lists over documents that are shuffled once.

Everything by page is a window, a grouping or a flow over one partitioning by document and page, and
everything by document one over a partitioning by document, so the plan has two exchanges whatever
the number of steps.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.operators import blocks as b
from docuflux.operators import layout as lay
from docuflux.operators.groups import flowed
from docuflux.operators.lists import Intervals
from docuflux.operators.paragraphs import blocks_of

PARAGRAPHS = "doc_id long, page long, paragraph int, seq long, text string, n_lines int, heading boolean, font_size double, font_weight double, color string, x0 double, alignment string"
NODES = "doc_id long, page long, paragraph int, id int, type string, text string, n_lines int, alignment string, heading_level int, level string, list_page long, list_seq long, item int"


def scored(lines: DataFrame) -> DataFrame:
    """lines with `heading`, as blocks.headings marks them without a model's chance: how rare a value is, is
    its rank among the distinct ones in its span above the page's commonest, over their number."""
    rows = lines
    for value, name, mode, span in (("font_size", "_size", b.SIZE_MODE, b.SIZE_RANGE), ("font_weight", "_weight", b.WEIGHT_MODE, b.WEIGHT_RANGE)):
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*lay.PAGE, value)))
        common = F.min(F.when(F.col(value).between(*mode), F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))).over(Window.partitionBy(*lay.PAGE))["v"]
        rows = rows.withColumn("_m", F.coalesce(common, F.lit(0.0)))
        # ranks are windows over a window's column, so each has its step
        v = F.col(value)
        rows = rows.withColumn("_above", F.coalesce((v > F.col("_m")) & v.between(*span), F.lit(False)))
        rows = rows.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*lay.PAGE, "_above").orderBy(value)))
        rows = rows.withColumn(name, F.when(F.col("_above"), F.col("_rank") / F.max("_rank").over(Window.partitionBy(*lay.PAGE, "_above"))).otherwise(0.0))
    score = b.SIZE_BOOST * F.col("_size") + b.WEIGHT_BOOST * F.col("_weight") + F.when(b.bulleted(F.col("text")), b.BULLETED).otherwise(0.0)
    return rows.withColumn("heading", score > b.HEADING).drop("_n", "_m", "_above", "_rank", "_size", "_weight")


def lines_of(texts: DataFrame) -> DataFrame:
    """One row for each line (blocks.text_lines): seq of its first text, texts joined by a blank, box and style."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    first = lambda c: F.min_by(c, "seq").alias(c)
    return texts.groupBy(*lay.PAGE, "line").agg(
        F.min("seq").alias("seq"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), *[F.min(c).alias(c) for c in ("x0", "y0")], *[F.max(c).alias(c) for c in ("x1", "y1", "font_size", "font_weight")], first("color")
    ).drop("line")


def paragraphs(group: Iterator) -> Iterator[tuple]:
    """A page's lines to PARAGRAPHS; a paragraph is a heading if all its lines are, and has its first line's style."""
    head = next(group)
    lines: dict[int, tuple] = {}

    def every():
        for line in (head, *group):
            lines[line.seq] = line
            yield line

    for n, block in enumerate(blocks_of(every()), 1):
        own = [lines.pop(seq) for seq in block.seqs]
        yield head.doc_id, head.page, n, own[0].seq, "\n".join(r.text for r in own), len(own), all(r.heading for r in own), own[0].font_size, own[0].font_weight, own[0].color, min(r.x0 for r in own), block.alignment


def nodes(group: Iterator) -> Iterator[tuple]:
    """A document's paragraphs, with ids and heading levels, to NODES. Holds the document's paragraphs."""
    rows, known, items = list(group), Intervals(), {}
    for row in rows:
        if not row.heading:
            for found in known.take(row):
                items[found[1], found[2]] = found
    shown = []
    for row in rows:
        item = items.get((row.page, row.seq))
        if row.heading or (item and item[5] == 1):
            kind = "heading" if row.heading else "list"
            shown.append({"doc_id": row.doc_id, "seq": row.id, "type": kind, "heading_level": row.heading_level, "style": item and (item[6], row.x0), "linked": None})
    levels = {r["seq"]: r["level"] for r in b.level_walk(shown)}
    for row in rows:
        item = items.get((row.page, row.seq))
        kind = "heading" if row.heading else "list item" if item else "paragraph"
        yield row.doc_id, row.page, row.paragraph, row.id, kind, row.text, row.n_lines, row.alignment, row.heading_level, levels.get(row.id), *(item[3:6] if item else (None, None, None))


def layout(objects: DataFrame, width: Column, height: Column, parts: int | None = None) -> DataFrame:
    """NODES: the paragraphs, headings and list items of all documents, in order.

    objects: doc_id, page, seq, kind, text, box, font_size, font_weight, color. Tiny text, what lies off the
    page and background art are left out (layout.filtered), texts become lines and lines
    paragraphs; headings have the level of their style among their document's (size, weight,
    colour), ids count paragraphs through a document, and lists are those of the paragraphs'
    labels. level: Doctitle and Subtitle of headings, and how deep the style of a list stands (on
    its first item). Pages and documents without text give no rows. parts: partitions by document
    (session.parts_for), the session's number without; a task's sorts take memory by its share.
    """
    drop = lay.tiny() | lay.off_page(width, height) | lay.background(width, height)
    # by page: the first window deals the pages out, and all that follows finds them together
    lines = scored(lines_of(b.text_lines(objects.filter(~F.coalesce(drop, F.lit(False))))))
    style = F.concat_ws("|", "font_size", "font_weight", "color")
    ready = lines.select(*lay.PAGE, "seq", "text", "x0", "y0", "x1", "y1", "font_size", "font_weight", "color", style.alias("style"), b.bulleted(F.col("text")).alias("labelled"), "heading")
    by_page = flowed(ready, lay.PAGE, ["seq"], paragraphs, PARAGRAPHS, dealt=True)
    # by document
    if parts:
        by_page = by_page.repartition(parts, "doc_id")
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "heading").orderBy(F.desc("font_size"), F.desc("font_weight"), F.asc_nulls_last("color")))
    placed = by_page.withColumns({"id": F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "paragraph")), "heading_level": F.when(F.col("heading"), rank)})
    return flowed(placed, ["doc_id"], ["page", "paragraph"], nodes, NODES, dealt=True)
