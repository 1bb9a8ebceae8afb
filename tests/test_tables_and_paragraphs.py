"""Nested tables, row bands, clusters and the nine paragraph passes against plain loops and on stated pages."""

from collections import defaultdict
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from docuflux.operators import paragraphs as pg
from docuflux.operators import tables as tb
from docuflux.plans import blocks as block_plans
from docuflux.plans import tables as table_plans
from docuflux.registry import queries

from .compare import TINY

OBJECT = "doc_id long, page long, seq long, kind string, text string, x0 double, y0 double, x1 double, y1 double"
CELL = "doc_id long, page long, table int, row int, col int, x0 double, y0 double, x1 double, y1 double"


def nested(levels):
    """A table of one cell in a table of one cell, and so on; table 1 is the outermost."""
    return [(1, 0, k, 0, 0, float(k), float(k), 1000.0 - k, 1000.0 - k) for k in range(1, levels + 1)]


def test_forest_beyond_ten(spark):
    cells = spark.createDataFrame(nested(13), CELL)
    rows = {r.table: (r.parent, r.depth) for r in tb.forest(cells).collect()}
    assert rows == {k: (k - 1 if k > 1 else None, k) for k in range(1, 14)}
    word = spark.createDataFrame([(1, 0, 5, "text", "in all of them", 400.0, 400.0, 500.0, 410.0)], OBJECT)
    # what is in tables that are nested deeper stays in the tenth
    assert [(r.table, r.depth, r.text) for r in tb.placed(word, cells).collect()] == [(10, 10, "in all of them")]


def test_forest_of_equal_boxes(spark):
    cells = spark.createDataFrame([(1, 0, t, 0, 0, 0.0, 0.0, 10.0, 10.0) for t in (1, 2, 3)], CELL)
    assert {r.table: (r.parent, r.depth) for r in tb.forest(cells).collect()} == {1: (None, 1), 2: (1, 2), 3: (2, 3)}


def test_straddling_text(spark):
    """An outer row of three cells, the last of which holds a table of two; the line crosses all and sticks out."""
    cells = [(1, 0, 1, 0, c, 10.0 + 10 * c, 0.0, 20.0 + 10 * c, 100.0) for c in range(3)] + [(1, 0, 2, 0, c, 31.0 + 4 * c, 40.0, 35.0 + 4 * c, 60.0) for c in range(2)]
    line = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWX"  # a letter a point
    rows = [(1, 0, 1, "text", line, 0.0, 45.0, 50.0, 55.0), (1, 0, 2, "text", "under the inner table", 10.0, 5.0, 31.0, 9.0), (1, 0, 3, "image", None, 29.0, 41.0, 38.0, 59.0), (1, 0, 4, "text", "elsewhere", 0.0, 200.0, 9.0, 210.0), (1, 0, 5, "text", None, 0.0, 300.0, 0.0, 310.0), (2, 0, 1, "text", "no tables", 0.0, 45.0, 50.0, 55.0)]
    got = [(r.doc_id, r.seq, r.part, r.text, r.x0, r.x1, r.table, r.col) for r in tb.placed(spark.createDataFrame(rows, OBJECT), spark.createDataFrame(cells, CELL)).orderBy("doc_id", "seq", "part").collect()]
    assert got == [
        (1, 1, 0, line[:10], 0.0, 10.0, None, None), (1, 1, 1, line[10:20], 10.0, 20.0, 1, 0), (1, 1, 2, line[20:30], 20.0, 30.0, 1, 1), (1, 1, 3, line[30:31], 30.0, 31.0, 1, 2),
        (1, 1, 4, line[31:35], 31.0, 35.0, 2, 0), (1, 1, 5, line[35:39], 35.0, 39.0, 2, 1), (1, 1, 6, line[39:40], 39.0, 40.0, 1, 2), (1, 1, 7, line[40:], 40.0, 50.0, None, None),
        (1, 2, 0, "under the ", 10.0, 20.0, 1, 0), (1, 2, 1, "inner tabl", 20.0, 30.0, 1, 1), (1, 2, 2, "e", 30.0, 31.0, 1, 2),
        (1, 3, 0, None, 29.0, 38.0, 2, 0), (1, 4, 0, "elsewhere", 0.0, 9.0, None, None), (1, 5, 0, None, 0.0, 0.0, None, None), (2, 1, 0, "no tables", 0.0, 50.0, None, None),
    ]
    assert tb.placed(spark.createDataFrame([], OBJECT), spark.createDataFrame(cells, CELL)).collect() == []
    assert tb.placed(spark.createDataFrame(rows, OBJECT), spark.createDataFrame([], CELL)).filter("table is not null").collect() == []


def test_all_letters_stay(spark):
    """Parts of every line of all documents make the line again, but for white space that was left out."""
    whole = {(r.doc_id, r.seq): r.text for r in table_plans.objects(spark, TINY).select("doc_id", "seq", "text").collect()}
    parts = defaultdict(str)
    for r in queries()["j15_nested_cells"](spark, TINY).orderBy("doc_id", "seq", "part").collect():
        parts[r.doc_id, r.seq] += r.text
    assert {k: "".join(v.split()) for k, v in parts.items()} == {k: "".join(v.split()) for k, v in whole.items()}


def test_values_that_straddle_a_tenth(spark):
    rows = [(1, 0, i, v) for i, v in enumerate([10.04, 10.06, 10.16, 10.25, 12.0, None])] + [(2, 0, 0, 10.0)]
    got = tb.clusters(spark.createDataFrame(rows, "doc_id long, page long, seq long, v double"), ["doc_id", "page"], "v", F.lit(0.15), ["seq"]).collect()
    # from the top: 10.25 and 10.16 have the mean 10.205, from which 10.06 is less than 0.15 away; that of the three is 10.157
    assert {(r.doc_id, r.seq): r.cluster for r in got} == {(1, 4): 0, (1, 3): 1, (1, 2): 1, (1, 1): 1, (1, 0): 1, (2, 0): 0}


def test_tables_side_by_side(spark):
    """Two grids are two tables, a line of texts and texts alone none, and a text that overlaps nothing is apart."""
    rows = [(1, 0, 10 * t + 2 * r + c, 50.0 + 300 * t + 60 * c, 700.0 - 20 * r, 90.0 + 300 * t + 60 * c, 710.0 - 20 * r) for t in range(2) for r in range(3) for c in range(2)]
    rows += [(1, 0, 30 + c, 50.0 + 60 * c, 100.0, 90.0 + 60 * c, 110.0) for c in range(5)] + [(1, 0, 50, 400.0, 300.0, 440.0, 310.0), (1, 0, 51, None, 1.0, 2.0, 3.0), (2, 0, 0, 1.0, 1.0, 2.0, 2.0)]
    got = {r.seq: (r.table, r.row, r.col) for r in tb.borderless(spark.createDataFrame(rows, "doc_id long, page long, seq long, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert got == {10 * t + 2 * r + c: (10 * t, r + 1, c + 1) for t in range(2) for r in range(3) for c in range(2)}


def split(lines, ruled):
    """The row bands of one table by plain loops; None where its rows stay."""
    lines = [r for r in lines if (r.text or "").strip(" ")]
    by_col = defaultdict(int)
    for r in lines:
        by_col[r.col] += 1
    rows, cols = {r for r, _ in ruled}, {c for _, c in ruled}
    if len(rows) > 2 or len(cols) < 3 or sum(n >= 8 for n in by_col.values()) < 2:
        return None
    bands = []
    for r in sorted(lines, key=lambda r: (-(r.y0 + r.y1) / 2, r.x0, r.seq)):
        for band in bands:
            mean = sum((x.y0 + x.y1) / 2 for x in band) / len(band)
            high = sum(x.y1 - x.y0 for x in band) / len(band)
            if abs(mean - (r.y0 + r.y1) / 2) <= max(3.0, 0.6 * min(high, r.y1 - r.y0)) or min(r.y1, max(x.y1 for x in band)) > max(r.y0, min(x.y0 for x in band)):
                band.append(r)
                break
        else:
            bands.append([r])
    bands.sort(key=lambda b: -sum((x.y0 + x.y1) / 2 for x in b) / len(b))
    new = {r.seq: i for i, b in enumerate(bands) for r in b}

    def sizes(key):
        out = defaultdict(int)
        for r in lines:
            out[key(r), r.col] += 1
        return sum(n >= 4 for n in out.values()), max(out.values())

    was, now = sizes(lambda r: r.row), sizes(lambda r: new[r.seq])
    better = len(bands) >= len(rows) + 2 and len(bands) > len({r.row for r in lines}) and (now[0] < was[0] or now[1] < was[1])
    return new if better else None


def test_row_bands_by_plain_loops(spark):
    contents, ruled = (x.collect() for x in table_plans.lines_in_columns(spark, TINY))
    cells, wanted = defaultdict(set), {}
    for r in ruled:
        cells[r.doc_id, r.page].add((r.row, r.col))
    key = lambda r: (r.doc_id, r.page)
    for k, part in groupby(sorted(contents, key=key), key=key):
        part = list(part)
        new = split(part, cells[k]) or {}
        wanted |= {(*k, r.seq): new.get(r.seq, r.row) for r in part}
    assert {(r.doc_id, r.page, r.seq): r.new_row for r in queries()["w20_split_rows"](spark, TINY).collect()} == wanted
    assert max(wanted.values()) > 2


# paragraphs -------------------------------------------------------------------------------------

LINE = "doc_id long, page long, seq long, x0 double, y0 double, x1 double, y1 double, text string, font_size double, font_weight double, color string"


def page(*lines):
    """(x0, x1) or with text, font size and colour; a line is 10 high, the next one 4 lower."""
    out = []
    for i, line in enumerate(lines):
        x0, x1, text, size, color = [*line, *("word", 10.0, "black")[len(line) - 2 :]]
        out.append((1, 0, i, float(x0), 800.0 - 14 * i, float(x1), 810.0 - 14 * i, text, size, 400.0, color))
    return out


#: Lines of a page, and the pass that joins each to the one above it.
PAGES = {
    "justified": ([(50, 300), (50, 300), (50, 300)], [None, 1, 1]),
    "another size": ([(50, 300), (50, 300, "w", 14.0)], [None, None]),
    "first line moved in, last line short": ([(70, 300), (50, 300), (50, 300), (50, 120)], [None, 2, 1, 2]),
    "two first lines": ([(70, 300), (50, 300), (50, 300), (70, 300), (50, 300), (50, 300)], [None, 2, 1, None, 2, 1]),
    "ragged": ([(50, 280), (50, 300), (50, 240)], [None, 3, 3]),
    "ragged, of two colours": ([(50, 280), (50, 300, "w", 10.0, "red"), (50, 240, "w", 10.0, "red")], [None, 4, 3]),
    "ragged, before a label": ([(50, 280), (50, 300), (50, 240, "1. item")], [None, 3, None]),
    "first line of ragged lines": ([(70, 200), (50, 280), (50, 300), (50, 240)], [None, 5, 3, 3]),
    "two lines": ([(70, 300), (50, 240)], [None, 6]),
    "centred": ([(100, 300), (120, 280), (80, 320)], [None, 7, 7]),
    "right-aligned": ([(90, 300), (100, 300), (150, 300)], [None, 8, 8]),
    "unlike each other": ([(50, 200), (60, 290)], [None, 9]),
    "side by side": ([(50, 100), (160, 290)], [None, None]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pass_on_a_stated_page(spark, name):
    lines, wanted = PAGES[name]
    got = pg.detected(spark.createDataFrame(page(*lines), LINE)).orderBy("seq").collect()
    assert [r.joined for r in got] == wanted


def test_lines_far_apart_and_without_boxes(spark):
    rows = page((50, 300), (50, 300), (50, 300))
    rows[2] = (*rows[2][:4], 700.0, 300.0, 710.0, *rows[2][7:])
    rows += [(1, 0, 3, None, None, None, None, None, None, None, None), (2, 7, 0, 1.0, 1.0, 2.0, 2.0, "", 1.0, 1.0, None)]
    got = {(r.doc_id, r.seq): (r.paragraph, r.line) for r in pg.detected(spark.createDataFrame(rows, LINE)).collect()}
    assert got == {(1, 0): (1, 1), (1, 1): (1, 2), (1, 2): (2, 1), (1, 3): (3, 1), (2, 0): (1, 1)}
    assert pg.detected(spark.createDataFrame([], LINE)).collect() == []


def plain(lines):
    """Blocks as lists of lines, rewritten pass by pass; everything about a block is read off its lines."""
    blocks = [([r], None, False, False) for r in lines]

    def shape(b):
        return "line" if len(b[0]) == 1 else b[1] or "free"

    def joins(rule, a, b):
        above, below = a[0][-1], b[0][0]
        h = min(above.y1 - above.y0, below.y1 - below.y0)
        left, right, mid = abs(above.x0 - below.x0) <= 0.1 * h, abs(above.x1 - below.x1) <= 0.1 * h, abs((above.x0 + above.x1) - (below.x0 + below.x1)) <= 0.2 * h
        meet = "justify" if left and right else "left" if left else "centre" if mid else "right" if right else None
        steps = [p.y0 - q.y0 for part in (a[0][-2:], b[0][:2]) for p, q in zip(part, part[1:])]
        step, gap = above.y0 - below.y0, above.y0 - below.y1
        strict = rule.strict_with_justified and "justify" in (shape(a), shape(b))
        return all([
            rule.aligned in (None, meet), not rule.above or shape(a) in rule.above, not rule.below or shape(b) in rule.below, rule.both or 1 in (len(a[0]), len(b[0])),
            any(abs(p.font_size - q.font_size) <= 0.1 for p in a[0] for q in b[0]), not (rule.unlabelled and below.labelled), not (rule.unstarted and b[2]), not (rule.unended and a[3]),
            not (rule.style or strict) or above.style == below.style, not rule.overlapping or min(above.x1, below.x1) > max(above.x0, below.x0), not rule.hanging or (above.x0 >= below.x0 and above.x1 >= below.x1),
            step > 0, -0.5 * h <= gap <= h, all(step - s <= 0.3 * h for s in steps), not strict or all(abs(step - s) <= 0.1 * h for s in steps),
        ])

    for _, rules in pg.PASSES:
        new = []
        for b in blocks:
            rule = next((r for r in rules if new and joins(r, new[-1], b)), None)
            if rule is None:
                new.append(b)
            else:
                a = new[-1]
                end = a[3] if rule.end is None else b[3] if rule.end == "below" else rule.end
                new[-1] = (a[0] + b[0], rule.to or a[1], a[2] if rule.start is None else rule.start, end)
        blocks = new
    return blocks


def test_passes_over_all_documents(spark):
    """All documents of the table; one weight, so that the close style of the last pass is that of sizes."""
    rows = block_plans.set_lines(spark, TINY).withColumns({"labelled": pg.bulleted(F.col("text")), "style": F.col("font_size")}).orderBy("doc_id", "page", "seq").collect()
    wanted = {}
    for (doc, at), part in groupby(rows, key=lambda r: (r.doc_id, r.page)):
        for n, (lines, alignment, started, ended) in enumerate(plain(list(part)), 1):
            wanted |= {(doc, at, r.seq): (n, k, alignment, started, ended) for k, r in enumerate(lines, 1)}
    got = {(r.doc_id, r.page, r.seq): (r.paragraph, r.line, r.alignment, r.started, r.ended) for r in queries()["w8_paragraphs"](spark, TINY).collect()}
    assert got == wanted
