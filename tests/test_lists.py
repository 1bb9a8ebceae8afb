"""Labels, lists over whole documents against the rule that numbered them, and lists that go on over pages."""

from collections import defaultdict

import pytest

from docuflux.operators import lists as ls
from docuflux.plans import lists as plans
from docuflux.registry import queries

from .compare import TINY

LINE = "doc_id long, page long, seq long, kind string, text string, x0 double, x1 double, font_size double"


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("1. one", [("decimal", "", ".", 1)]), ("(12) x", [("decimal", "(", ")", 12)]), ("1.2.3 x", [("decimal", "1.2.", "", 3)]), ("Article 4: x", [("decimal", "Article ", ":", 4)]),
        ("c) x", [("lower letter", "", ")", 3), ("lower roman", "", ")", 100)]), ("XIV. x", [("upper roman", "", ".", 14)]), ("iix. x", []), ("⑦ x", [("circled", "", "", 7)]), ("다. x", [("hangul0", "", ".", 3)]),
        ("• x", [("bullet", "•", "", 0)]), ("-", [("bullet", "-", "", 0)]), ("12 monkeys", []), ("a dog", []), ("1.5kg", []), ("", []), (None, []), ("see 3.", [("decimal", "see ", ".", 3)]),
    ],
)
def test_readings(text, wanted):
    assert [(r.style, r.prefix, r.suffix, r.value) for r in ls.readings(text)] == wanted


def test_all_roman_numerals():
    def plain(n):
        out = ""
        for value, sign in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, n = out + sign * (n // value), n % value
        return out

    assert [ls.roman(plain(n)) for n in range(1, 400)] == list(range(1, 400))
    assert [ls.roman(x) for x in ("", "iiii", "vx", "cd", "ic", "cccc")] == [None] * 6


def lines(spark, *rows):
    """(page, text), (page, text, left) or (page, text, left, kind)."""
    out = []
    for i, row in enumerate(rows):
        page, text, left, kind = [*row, *(None, 50.0, "text")[len(row) - 1 :]]
        out.append((1, page, i, kind, text, float(left), left + 100.0, 10.0))
    return spark.createDataFrame(out, LINE)


def named(spark, *rows):
    """By line: its list's first line and its number."""
    return {r.seq: (r.list_seq, r.item) for r in ls.items(lines(spark, *rows)).collect()}


def test_nested_and_ambiguous_lists(spark):
    texts = ["1. a", "a) b", "b) c", "2. d", "a) e", "b) f", "c) g", "3. h", "h. x", "i. y", "ii. z", "i) p", "ii) q", "• r", "- s", "• t"]
    got = named(spark, *[(0, t, 70 if ")" in t[:3] else 50) for t in texts])
    assert got == {0: (0, 1), 3: (0, 2), 7: (0, 3), 1: (1, 1), 2: (1, 2), 4: (4, 1), 5: (4, 2), 6: (4, 3), 8: (8, 1), 9: (8, 2), 11: (11, 1), 12: (11, 2), 13: (13, 1), 15: (13, 2)}


def test_labels_apart(spark):
    assert named(spark, (0, "1. a", 50), (0, "2. b", 61), (0, "3. c", 74)) == {0: (0, 1), 1: (0, 2)}
    assert named(spark, (0, "• a", 50), (0, "• b", 56)) == {}
    assert named(spark, (0, "1. a"), (1, None), (2, "2. b"), (3, "4. c")) == {0: (0, 1), 2: (0, 2)}
    assert ls.items(lines(spark, (0, "1. a")).limit(0)).collect() == []


def test_far_back(spark):
    """A list goes on after lines without labels, however many, but not after too many other open lists."""
    few = [(0, "1. a")] + [(i, "plain") for i in range(3000)] + [(4000, "2. b")]
    assert named(spark, *few) == {0: (0, 1), 3001: (0, 2)}
    many = [(0, "1. a")] + [(i, f"({20 + 2 * (i % 400)}) x", 50) for i in range(ls.LOOK_BACK + 20)] + [(4000, "2. b")]
    assert named(spark, *many) == {}


def test_items_of_all_documents(spark):
    """Runs of counters that go on by one, as the lines were numbered."""
    rows = plans.labelled(spark, TINY).orderBy("doc_id", "seq").collect()
    runs, wanted = defaultdict(list), set()
    for r in rows:
        place = r.seq % 10
        if place in (1, 2, 3, 5, 6):
            n = (r.page * 5 + (place if place <= 3 else place - 1) - 1) % 14 + 1
            key = (r.doc_id, r.page if r.doc_id % 10 == 6 else 0)
            part = runs[key]
            if not part or (r.doc_id % 10 != 7 and n != part[-1][-1][1] + 1):
                part.append([])
            part[-1].append((r.seq, n))
    for (doc, _), parts in runs.items():
        for part in parts:
            if len(part) > 1:
                wanted |= {(doc, seq, part[0][0], i + 1) for i, (seq, _) in enumerate(part)}
    labelled = {(r.doc_id, r.seq) for r in rows if r.seq % 10 in (1, 2, 3, 5, 6)}
    got = {(r.doc_id, r.seq, r.list_seq, r.item) for r in queries()["w14_label_lists"](spark, TINY).collect() if (r.doc_id, r.seq) in labelled}
    assert got == wanted and len(wanted) > 500


def linked(spark, *rows):
    objects = lines(spark, *rows)
    return {r.seq: (r.chain_seq, r.item, r.role) for r in ls.linked(objects, ls.items(objects.filter("kind = 'text'"))).collect()}


def test_list_over_three_pages(spark):
    got = linked(
        spark, (0, "1. a"), (0, "2. b"), (0, "more of b", 62), (0, "footer", 50, "footer"), (1, "header", 50, "header"), (1, "and more", 62), (1, "3. c"), (1, "within c", 62), (1, "4. d"), (1, "a rule", 50, "line"),
        (2, "5. e"), (2, "a figure", 50, "image"), (2, "6. f"), (2, "the end"),
    )
    # the paragraph below b is followed by one more, so neither is absorbed and the list is cut there
    assert got == {0: (0, 1, "item"), 1: (0, 2, "item"), 6: (6, 1, "item"), 7: (6, 1, "body"), 8: (6, 2, "item"), 10: (6, 3, "item"), 12: (6, 4, "item")}
    got = linked(spark, (0, "1. a"), (0, "2. b"), (1, "rest of b", 62), (1, "3. c"), (1, "4. d"), (2, "5. e"), (2, "6. f"))
    assert got == {0: (0, 1, "item"), 1: (0, 2, "item"), 2: (0, 3, "lead"), 3: (0, 4, "item"), 4: (0, 5, "item"), 5: (0, 6, "item"), 6: (0, 7, "item")}


def test_lists_that_do_not_go_on(spark):
    # two lists of one page with a paragraph between: absorbed where the labels go on, a paragraph where not or where it begins further left
    assert linked(spark, (0, "1. a"), (0, "2. b"), (0, "x", 62), (0, "1. c"), (0, "2. d"))[3] == (3, 1, "item")
    far = linked(spark, (0, "1. a", 50), (0, "2. b", 50), (0, "x", 62), (0, "3. c", 90), (0, "4. d", 90))
    assert far == {0: (0, 1, "item"), 1: (0, 2, "item"), 3: (3, 1, "item"), 4: (3, 2, "item")}
    near = linked(spark, (0, "1. a", 50), (0, "2. b", 50), (0, "x", 92), (0, "3. c", 90), (0, "4. d", 90))
    assert near == {0: (0, 1, "item"), 1: (0, 2, "item"), 2: (0, 2, "body"), 3: (0, 3, "item"), 4: (0, 4, "item")}
    assert linked(spark, (0, "1. a"), (0, "2. b"), (0, "t", 50, "table"), (1, "3. c", 90), (1, "4. d", 90))[3] == (3, 1, "item")
    assert ls.linked(lines(spark, (0, "x")), ls.items(lines(spark, (0, "x")))).collect() == []


def test_objects_by_category(spark):
    """A backend's elements: furniture, unknown empty ones and those without a box go, boxes are turned over, rows of a band are read from the left."""
    from docuflux.operators import hybrid

    box = '"bbox":{"left":%s,"top":%s,"width":10,"height":5}'
    texts = [
        '{"elements":[{"category":{"type":"PARAGRAPH"},"pageIndex":1,%s,"content":{"text":"right"}},{"category":{"type":"HEADING"},"pageIndex":1,%s,"content":{"text":"left \\u00e9"}},{"category":{"type":"PAGE_HEADER"},%s},'
        '{"category":{"type":"FIGURE"},%s},{"category":{"type":"ODD"},%s,"content":{"text":""}},{"category":{"type":"ODD"},%s,"content":{"text":"odd"}},{"category":{},%s},{"category":{"type":"TABLE"}},{"category":{"type":"FIGURE"},%s}]}'
        % tuple(box % at for at in ((50, 13), (5, 10), (0, 0), (0, 100), (0, 0), (0, 40), (0, 0), (0, 700))),
        "no json", "{}", None, '{"elements":[{"category":{"type":"FORMULA"},"bbox":{},"content":{"text":"x"}}]}',
    ]
    heights = spark.createDataFrame([(0, 2, 100.0)], "doc_id long, page long, height double")
    got = hybrid.category_objects(spark.createDataFrame(list(enumerate(texts)), "doc_id long, json string"), heights).orderBy("doc_id", "page", "place").collect()
    assert [(r.doc_id, r.page, r.seq, r.type, r.text, r.heading_level, r.picture, r.x0, r.y0, r.x1, r.y1) for r in got] == [
        (0, 1, 5, "paragraph", "odd", None, None, 0.0, 797.0, 10.0, 802.0), (0, 1, 3, "picture", None, None, 1, 0.0, 737.0, 10.0, 742.0), (0, 1, 8, "picture", None, None, 2, 0.0, 137.0, 10.0, 142.0),
        (0, 2, 1, "heading", "left é", 1, None, 5.0, 85.0, 15.0, 90.0), (0, 2, 0, "paragraph", "right", None, None, 50.0, 82.0, 60.0, 87.0), (4, 1, 0, "formula", "x", None, None, 0.0, 842.0, 0.0, 842.0),
    ]
