"""Reading order by pointer doubling against a recursive walk, for deep, wide, broken and many trees."""

import random

from pyspark.sql import functions as F

from docuflux.operators import trees as tr

ROW = "page long, node long, parent long, place long, order string"


def walked(rows):
    """(page, node): order, depth, size; by an own stack, from the roots."""
    out = {}
    for page in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == page]
        ids, below = {r[1] for r in own}, {}
        for r in own:
            below.setdefault(r[2] if r[2] in ids else None, []).append((r[3], r[1]))
        stack, order, open_ = [(n, 1) for _, n in sorted(below.get(None, []), reverse=True)], 0, []
        while stack:
            node, depth = stack.pop()
            open_ = open_[: depth - 1] + [node]
            for up in open_:
                out.setdefault((page, up), [None, None, 0])[2] += 1
            out[page, node][:2] = order, depth
            order += 1
            stack += [(n, depth + 1) for _, n in sorted(below.get(node, []), reverse=True)]
    return {k: tuple(v) for k, v in out.items()}


def ordered(spark, rows):
    nodes = spark.createDataFrame([(*r, "x") for r in rows], ROW).withColumnRenamed("order", "text")
    return {(r.page, r.node): (r.order, r.depth, r.size) for r in tr.preorder(nodes, "page").collect()}


def test_random_trees(spark):
    rng, rows = random.Random(7), []
    for page in range(12):
        ids = rng.sample(range(10**6), rng.randint(1, 60))
        for i, node in enumerate(ids):
            rows.append((page, node, rng.choice([*ids[:i], None, -5]) if i else None, rng.randint(0, 3)))
    rng.shuffle(rows)
    assert ordered(spark, rows) == walked(rows)


def test_deep_and_wide_trees(spark):
    rows = [(1, i, i - 1 if i else None, 0) for i in range(1500)] + [(2, 0, None, 0)] + [(2, i, 0, i) for i in range(1, 1500)]
    got = ordered(spark, rows)
    assert got[1, 1499] == (1499, 1500, 1) and got[1, 0] == (0, 1, 1500) and got[2, 1499] == (1499, 2, 1) and got == walked(rows)


def test_cycles_are_left_out(spark):
    rows = [(1, 1, None, 0), (1, 2, 1, 0), (1, 10, 11, 0), (1, 11, 12, 0), (1, 12, 10, 0), (1, 13, 12, 1), (1, 20, 20, 0)]
    assert ordered(spark, rows) == {(1, 1): (0, 1, 2), (1, 2): (1, 2, 1)}
    assert tr.preorder(spark.createDataFrame([], ROW).withColumnRenamed("order", "text"), "page").collect() == []


def test_roles(spark):
    roles = ["h2", "NAV", "toc", "Title", "P", "weird", None, "a"]
    kind, level = tr.standard(F.col("role"))
    got = spark.createDataFrame([(r,) for r in roles], "role string").select(kind.alias("k"), level.alias("l")).collect()
    assert [tuple(r) for r in got] == [("heading", 2), ("list", None), ("list", None), ("heading", 1), ("paragraph", None), ("other", None), ("other", None), ("link", None)]
    loop, _ = tr.standard(F.lit("x"), {"X": "Y", "Y": "X"})
    assert spark.range(1).select(loop.alias("k")).first().k == "other"


def test_tags_that_are_not_closed(spark):
    pages = spark.createDataFrame([(1, "<div><p>a<b>b</p><ul><li>x<li>y</ul></div><p>end"), (2, ""), (3, None)], "page_id long, html string")
    got = tr.preorder(tr.tagged(pages), "page_id").orderBy("order").collect()
    assert [(r.role, r.depth, r.text) for r in got] == [("div", 1, ""), ("p", 2, "a"), ("ul", 2, ""), ("li", 3, "x"), ("li", 4, "y"), ("p", 3, "end")]
