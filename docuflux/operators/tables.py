"""Ruled tables: tables in cells of tables, texts that straddle cells, and cells split by row bands.

cells: doc_id, page, table, row, col, x0, y0, x1, y1 (y grows upwards; row 0 is the highest). A
table's box is that around its cells. All joins are by page; everything else is a residual predicate
within it, or a window by a page's object.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.operators.groups import flowed, stepped
from docuflux.operators.layout import PAGE

# Depth of nesting, and limits of tables whose rows were not ruled.
DEPTH = 10
MOST_ROWS, LEAST_COLUMNS, DENSE_LINES, DENSE_COLUMNS, MORE_BANDS, OVERSIZED = 2, 3, 8, 2, 2, 4
BAND_NEAR, BAND_SHARE, ROW_ORDER = 3.0, 0.6, 1.5
#: Points between texts of a table without borders, side by side and one below the other.
ACROSS, DOWN = 30.0, 20.0
# End of fixed values.

BOX = ["x0", "y0", "x1", "y1"]
TABLE = [*PAGE, "table"]


def boxes(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table, box) around the cells of each table."""
    return cells.groupBy(*TABLE).agg(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in BOX])


def forest(cells: DataFrame) -> DataFrame:
    """Which cell each table lies in: doc_id, page, table, box, parent, parent_row, parent_col, depth.

    A table lies in the smallest cell of another table that holds its whole box (of equal cells that
    of the greatest table); of a table and a cell of one size the one with the greater id lies in
    the other. Containing is transitive, so a table's depth is the number of tables that hold it,
    itself included; tables in no cell have depth 1 and no parent.
    """
    inner = boxes(cells)
    area = lambda m: (F.col(f"{m}x1") - F.col(f"{m}x0")) * (F.col(f"{m}y1") - F.col(f"{m}y0"))
    outer = cells.select(*PAGE, *[F.col(c).alias(f"c{c}") for c in ("table", "row", "col", *BOX)])
    holds = (F.col("cx0") <= F.col("x0")) & (F.col("cy0") <= F.col("y0")) & (F.col("cx1") >= F.col("x1")) & (F.col("cy1") >= F.col("y1")) & (F.col("ctable") != F.col("table"))
    larger = (area("c") > area("")) | ((area("c") == area("")) & (F.col("ctable") < F.col("table")))
    held = inner.join(outer, PAGE).filter(holds & larger).groupBy(*TABLE).agg(
        F.min_by(F.struct("ctable", "crow", "ccol"), F.struct(area("c"), -F.col("ctable"))).alias("p"), (F.count_distinct("ctable") + 1).alias("depth")
    )
    return inner.join(held, TABLE, "left").select(*TABLE, *BOX, F.col("p.ctable").alias("parent"), F.col("p.crow").alias("parent_row"), F.col("p.ccol").alias("parent_col"), F.coalesce("depth", F.lit(1)).cast("int").alias("depth"))


def distance(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - value, value - high, F.lit(0.0))


def placed(objects: DataFrame, cells: DataFrame, limit: int = DEPTH) -> DataFrame:
    """Objects in the innermost cells: their columns with part, table, row, col and depth added, a row
    for each part; outside tables these are null.

    A point of a table's box belongs to the cell that holds it, else (between cells, or where a
    column is missing) to the nearest one by height and then by its column's middle; of nested tables
    to the innermost. A text (kind text) is cut where the cells and tables at the height of its
    middle begin or end; neighbouring parts in one cell are one; characters lie evenly along the
    text, each belongs to the part that holds its middle, and parts of white space are left out
    unless they are the whole. Other objects go whole where their middle lies. Tables nested deeper
    than `limit` are no tables: what is in them stays in the innermost cell that counts.
    """
    tree = forest(cells).filter(F.col("depth") <= limit)
    known = cells.join(tree.select(*TABLE, "depth", *[F.col(c).alias(f"t{c}") for c in BOX]), TABLE)
    near = known.select(*[F.col(c).alias(f"c_{c}") for c in PAGE], F.struct("table", "row", "col", "depth", *BOX, *[f"t{c}" for c in BOX]).alias("c"))
    rows = objects.select(*PAGE, F.struct(*objects.columns).alias("o"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), ((F.col("x0") + F.col("x1")) / 2).alias("x"))
    meets = (F.col("y") >= F.col("c.ty0")) & (F.col("y") < F.col("c.ty1")) & (F.col("o.x0") < F.col("c.tx1")) & (F.col("o.x1") > F.col("c.tx0"))
    same = reduce(Column.__and__, [F.col(c) == F.col(f"c_{c}") for c in PAGE])
    met = rows.join(near, same & meets, "left").groupBy(*PAGE, F.col("o.seq").alias("seq")).agg(F.first("o").alias("o"), F.first("x").alias("x"), F.first("y").alias("y"), F.collect_list("c").alias("cells"))
    y, o = F.col("y"), F.col("o")

    def owner(x: Column) -> Column:
        def rank(c: Column) -> Column:
            inside = (x >= c["x0"]) & (x < c["x1"]) & (y >= c["y0"]) & (y < c["y1"])
            return F.struct(c["depth"].alias("depth"), inside.alias("inside"), (-distance(y, c["y0"], c["y1"])).alias("high"), (-F.abs(x - (c["x0"] + c["x1"]) / 2)).alias("wide"), (-c["table"]).alias("table"), (-c["row"]).alias("row"), (-c["col"]).alias("col"))

        return F.array_max(F.transform(F.filter("cells", lambda c: (x >= c["tx0"]) & (x < c["tx1"])), rank))

    at_height = F.filter("cells", lambda c: (y >= c["y0"]) & (y < c["y1"]))
    edges = F.concat(at_height["x0"], at_height["x1"], F.col("cells.tx0"), F.col("cells.tx1"))
    inner = F.filter(edges, lambda e: (e > o["x0"]) & (e < o["x1"]))
    ends = F.when(o["kind"] == "text", F.array_sort(F.array_distinct(F.concat(F.array(o["x0"], o["x1"]), inner)))).otherwise(F.array(o["x0"], o["x1"]))
    cut = met.withColumn("ends", ends)
    middle = lambda a, b: F.when(o["kind"] == "text", (a + b) / 2).otherwise(F.col("x"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("ends") - 2, F.lit(0))),
        lambda i: F.struct(F.get("ends", i).alias("a"), F.coalesce(F.get("ends", i + 1), o["x1"]).alias("b"), owner(middle(F.get("ends", i), F.coalesce(F.get("ends", i + 1), o["x1"]))).alias("cell")),
    )
    flat = cut.select(*PAGE, "seq", "o", F.posexplode(pieces).alias("piece", "p"))
    along = Window.partitionBy(*PAGE, "seq").orderBy("piece")
    id_ = F.struct("p.cell.table", "p.cell.row", "p.cell.col")
    fresh = F.coalesce(~F.lag(id_).over(along).eqNullSafe(id_), F.lit(True)) | (F.col("piece") == 0)
    runs = flat.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(along))
    parts = runs.groupBy(*PAGE, "seq", "run").agg(F.first("o").alias("o"), F.min("p.a").alias("a"), F.max("p.b").alias("b"), F.first("p.cell").alias("cell"))
    wide, long = o["x1"] - o["x0"], F.length(F.coalesce(o["text"], F.lit("")))
    letter = lambda e: F.when(wide > 0, F.ceil((e - o["x0"]) * long / wide - 0.5)).otherwise(F.when(e > o["x0"], long).otherwise(0)).cast("int")
    alone = (F.col("a") == o["x0"]) & (F.col("b") == o["x1"])
    text = F.when(alone, o["text"]).otherwise(F.substring(o["text"], letter(F.col("a")) + 1, F.when(F.col("b") == o["x1"], long).otherwise(letter(F.col("b"))) - letter(F.col("a"))))
    kept = parts.withColumn("text", text).filter(alone | (F.length(F.trim("text")) > 0))
    number = F.row_number().over(Window.partitionBy(*PAGE, "seq").orderBy("run")) - 1
    put = {"text": F.col("text"), "x0": F.col("a"), "x1": F.col("b")}
    own = [put[c].alias(c) if c in put else o[c].alias(c) for c in objects.columns]
    return kept.select(*own, number.cast("int").alias("part"), *[(-F.col(f"cell.{c}")).alias(c) for c in ("table", "row", "col")], F.col("cell.depth").alias("depth"))


# rows that were not ruled -----------------------------------------------------------------------


def row_bands():
    """A step over the lines of a table from the top: the first band whose mean middle is near or that
    overlaps in height takes a line; gives the band's number. Keeps the bands of one table."""
    bands: list[list[float]] = []  # lines, sum of middles, sum of heights, bottom, top

    def step(y0: float, y1: float) -> tuple[int]:
        for i, band in enumerate(bands):
            n, middles, heights, bottom, top = band
            near = max(BAND_NEAR, min(heights / n, y1 - y0) * BAND_SHARE)
            if abs(middles / n - (y0 + y1) / 2) <= near or min(top, y1) > max(bottom, y0):
                bands[i] = [n + 1, middles + (y0 + y1) / 2, heights + y1 - y0, min(bottom, y0), max(top, y1)]
                return (i,)
        bands.append([1, (y0 + y1) / 2, y1 - y0, y0, y1])
        return (len(bands) - 1,)

    return step


def split_rows(contents: DataFrame, cells: DataFrame) -> DataFrame:
    """contents (doc_id, page, seq, part, table, row, col, text, box: a line of text each) of tables with
    `new_row`: where a table has up to two ruled rows and three columns or more, two of them with
    eight lines or more, its rows are bands of lines at one height instead, if there are two more
    of them than rows, more of them than rows hold text, none lies out of order, and its cells
    get shorter. Other tables keep their rows."""
    text = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    lines = contents.filter(F.col("table").isNotNull() & text)
    ruled = cells.groupBy(*TABLE).agg(F.count_distinct("row").alias("n_rows"), F.count_distinct("col").alias("n_columns"))
    dense = lines.groupBy(*TABLE, "col").agg(F.count("*").alias("n")).groupBy(*TABLE).agg(F.count_if(F.col("n") >= DENSE_LINES).alias("dense"))
    poor = ruled.join(dense, TABLE).filter((F.col("n_rows") <= MOST_ROWS) & (F.col("n_columns") >= LEAST_COLUMNS) & (F.col("dense") >= DENSE_COLUMNS)).select(*TABLE, "n_rows")
    middle = (F.col("y0") + F.col("y1")) / 2
    found = stepped(lines.join(poor, TABLE).withColumn("_down", -middle), TABLE, ["_down", "x0", "seq", "part"], ["y0", "y1"], row_bands, "band int").drop("_down")
    band = found.groupBy(*TABLE, "band").agg(F.avg(middle).alias("middle"))
    order = band.withColumn("new_row", (F.row_number().over(Window.partitionBy(*TABLE).orderBy(F.desc("middle"), "band")) - 1).cast("int"))
    numbered = found.join(order, [*TABLE, "band"])
    size = lambda row: F.count("*").over(Window.partitionBy(*TABLE, row, "col"))
    sized = numbered.withColumns({"was": size("row"), "now": size("new_row")})
    facts = sized.groupBy(*TABLE).agg(
        F.max("new_row").alias("last"), F.max("n_rows").alias("n_rows"), F.count_distinct("row").alias("filled"), F.max("was").alias("was"), F.max("now").alias("now"),
        F.count_distinct(F.when(F.col("was") >= OVERSIZED, F.struct("row", "col"))).alias("big_was"), F.count_distinct(F.when(F.col("now") >= OVERSIZED, F.struct("new_row", "col"))).alias("big_now"),
    )
    w = Window.partitionBy(*TABLE).orderBy("new_row")
    falling = order.withColumn("up", F.coalesce(F.col("middle") > F.lag("middle").over(w) + ROW_ORDER, F.lit(False))).groupBy(*TABLE).agg((~F.bool_or("up")).alias("falling"))
    better = [F.col("last") + 1 >= F.col("n_rows") + MORE_BANDS, F.col("last") + 1 > F.col("filled"), F.col("falling"), (F.col("big_now") < F.col("big_was")) | (F.col("now") < F.col("was"))]
    good = facts.join(falling, TABLE).filter(reduce(Column.__and__, better)).select(*TABLE)
    new = numbered.join(good, TABLE, "left_semi").select(*TABLE, "seq", "part", "new_row")
    return contents.join(new, [*TABLE, "seq", "part"], "left").withColumn("new_row", F.coalesce("new_row", "row"))


# values in one dimension ------------------------------------------------------------------------


def clusters(rows: DataFrame, keys: list[str], value: str, near: Column, order: list[str], name: str = "cluster") -> DataFrame:
    """Numbers clusters of a group's values, from the greatest: a value joins the cluster before it while
    it is less than `near` from the mean of that cluster, which moves with it. Null values are left out."""

    def start():
        held = [0, 0.0, -1]  # values, their sum, the cluster's number

        def step(at: float, reach: float) -> tuple[int]:
            n, total, number = held
            held[:] = [n + 1, total + at, number] if n and abs(total / n - at) < reach else [1, at, number + 1]
            return (held[2],)

        return step

    ready = rows.filter(F.col(value).isNotNull()).withColumns({"_near": near, "_down": -F.col(value)})
    return stepped(ready, keys, ["_down", *order], [value, "_near"], start, f"{name} int").drop("_near", "_down")


def aligned_groups(objects: DataFrame, gap: float = 3.0, near: float = 0.1) -> DataFrame:
    """(doc_id, page, groups): how many clusters of baselines (within a tenth of a text's height of
    their mean) have two texts side by side that stand over `gap` mean heights apart."""
    high = F.col("y1") - F.col("y0")
    texts = objects.filter((F.col("kind") == "text") & F.col("baseline").isNotNull())
    found = clusters(texts.select(*PAGE, "seq", "baseline", *BOX), PAGE, "baseline", high * near, ["x0", "seq"])
    w = Window.partitionBy(*PAGE, "cluster").orderBy("x0", "seq")
    far = F.col("x0") - F.lag("x1").over(w) > gap * (high + F.lag(high).over(w)) / 2
    by = found.withColumn("far", F.coalesce(far, F.lit(False))).groupBy(*PAGE, "cluster").agg(F.bool_or("far").alias("far"))
    return by.groupBy(*PAGE).agg(F.count_if("far").alias("groups"))


# tables without borders -------------------------------------------------------------------------


def neighbours(a, b, across: float, down: float) -> bool:
    """Whether two texts stand in one row or one column: side by side, overlapping by half of the lower
    one's height, or one below the other and overlapping from side to side, and close."""
    wide, high = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
    return (high >= 0.5 * min(a.y1 - a.y0, b.y1 - b.y0) and -wide <= across) or (wide > 0 and -high <= down)


def groups_of(across: float, down: float):
    """A page's texts to (doc_id, page, seq, group): texts that neighbours join, named by the least seq.
    Only texts that share a square of the page, widened by the distances, are compared."""

    def work(page: Iterator) -> Iterator[tuple]:
        rows, side = list(page), 4 * max(across, down)
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        squares: dict[tuple[int, int], list[int]] = {}
        for i, r in enumerate(rows):
            for x in range(int((r.x0 - across) // side), int((r.x1 + across) // side) + 1):
                for y in range(int((r.y0 - down) // side), int((r.y1 + down) // side) + 1):
                    others = squares.setdefault((x, y), [])
                    for j in others:
                        a, b = find(i), find(j)
                        if a != b and neighbours(r, rows[j], across, down):
                            root[max(a, b)] = min(a, b)
                    others.append(i)
        for i, r in enumerate(rows):  # rows come by seq, so the least place is the least seq
            yield r.doc_id, r.page, r.seq, rows[find(i)].seq

    return work


def borderless(texts: DataFrame, across: float = ACROSS, down: float = DOWN) -> DataFrame:
    """Texts in grids: doc_id, page, seq, table (the least seq in it), row, col (from 1). Texts of a page that
    neighbours join are a table if they make two rows and two columns at least: bands of
    overlapping heights, and of overlapping widths. Texts without a box are left out."""
    boxed = texts.select(*PAGE, "seq", *BOX).dropna(subset=BOX)
    named = flowed(boxed, PAGE, ["seq"], groups_of(across, down), "doc_id long, page long, seq long, table long")
    rows = boxed.join(named, [*PAGE, "seq"])

    def bands(rows: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
        w = Window.partitionBy(*TABLE).orderBy(low, "seq")
        end = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("_f", F.coalesce(low >= end, F.lit(True)).cast("int")).withColumn(name, F.sum("_f").over(w)).drop("_f")

    rows = bands(bands(rows, -F.col("y1"), -F.col("y0"), "row"), F.col("x0"), F.col("x1"), "col")
    w = Window.partitionBy(*TABLE)
    return rows.withColumns({"_r": F.max("row").over(w), "_c": F.max("col").over(w)}).filter("_r > 1 and _c > 1").select(*PAGE, "seq", "table", "row", "col")
