"""Joining the objects of a page with what another parser or a reader of images found there.

All joins are by document and page first; ranges are residual predicates within a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docuflux.functions import text as t
from docuflux.operators.layout import PAGE

# Points a pixel at 300 dpi, tolerances in points, shares of overlap.
PIXEL, NODE_NEAR, PICTURE_NEAR, WORD_SHARE, TOP_NEAR = 0.24, 5.0, 1.0, 0.5, 5.0
# End of fixed values.

BOX = ["x0", "y0", "x1", "y1"]


def centre(a: str, lo: str, hi: str) -> Column:
    return (F.col(f"{a}{lo}") + F.col(f"{a}{hi}")) / 2


def renamed(rows: DataFrame, mark: str, columns: list[str]) -> DataFrame:
    return rows.select(*PAGE, *[F.col(c).alias(f"{mark}{c}") for c in columns])


def to_points(boxes: DataFrame, heights: DataFrame, pixels: bool = True) -> DataFrame:
    """Boxes (left, top, right, bottom from the page's top) as x0, y0, x1, y1 in points from its bottom.
    heights: doc_id, page, height. With pixels, at 300 dpi; else only `origin` TOPLEFT is turned over."""
    rows = boxes.join(heights, PAGE)
    scale = PIXEL if pixels else 1.0
    flip = F.lit(True) if pixels else F.coalesce(F.col("origin") == "TOPLEFT", F.lit(False))
    at = lambda c: F.when(flip, F.col("height") - F.col(c) * scale).otherwise(F.col(c) * scale)
    return rows.select(*boxes.columns, (F.col("left") * scale).alias("x0"), F.least(at("top"), at("bottom")).alias("y0"), (F.col("right") * scale).alias("x1"), F.greatest(at("top"), at("bottom")).alias("y1"))


def share_inside(a: str, b: str) -> Column:
    """The part of box a that box b covers."""
    wide = F.greatest(F.lit(0.0), F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0"))
    high = F.greatest(F.lit(0.0), F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0"))
    area = (F.col(f"{a}x1") - F.col(f"{a}x0")) * (F.col(f"{a}y1") - F.col(f"{a}y0"))
    return F.when(area > 0, wide * high / area).otherwise(0.0)


def near_centre(a: str, b: str, by: float) -> Column:
    """Whether the centre of a lies in b, widened by `by`."""
    x, y = centre(a, "x0", "x1"), centre(a, "y0", "y1")
    return x.between(F.col(f"{b}x0") - by, F.col(f"{b}x1") + by) & y.between(F.col(f"{b}y0") - by, F.col(f"{b}y1") + by)


def cell_words(words: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, page, cell, text): words of which over half lies in a cell, from the top, then the left."""
    both = renamed(words, "w", ["seq", "text", *BOX]).join(renamed(cells, "c", ["seq", *BOX]), PAGE).filter(share_inside("w", "c") > WORD_SHARE)
    parts = F.array_sort(F.collect_list(F.struct((-F.col("wy1")).alias("a"), F.col("wx0").alias("b"), F.col("wseq").alias("c"), F.col("wtext").alias("t"))))
    return both.groupBy(*PAGE, F.col("cseq").alias("cell")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def overlapping(regions: DataFrame, tables: DataFrame) -> DataFrame:
    """Regions of which over half lies in a table."""
    found = renamed(regions, "r", ["seq", *BOX]).join(renamed(tables, "t", BOX), PAGE).filter(share_inside("r", "t") > WORD_SHARE)
    return regions.join(found.select(*PAGE, F.col("rseq").alias("seq")).distinct(), [*PAGE, "seq"], "left_semi")


def title_levels(titles: DataFrame) -> DataFrame:
    """Adds level by the distinct heights of a document's titles: the highest 2, then down to 6."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.col("y1") - F.col("y0")))
    return titles.withColumn("level", F.least(F.dense_rank().over(w) + 1, F.lit(6)))


def grouped_items(objects: DataFrame) -> DataFrame:
    """Runs of list items as one list: doc_id, page, list, items, box; seq is the first item's."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    item = F.col("kind") == "item"
    rows = objects.withColumn("_item", item).withColumn("list", F.sum((~F.col("_item")).cast("int")).over(w)).filter("_item")
    return rows.groupBy(*PAGE, "list").agg(F.count("*").alias("items"), F.min("seq").alias("seq"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("list")


def split_items(blocks: DataFrame) -> DataFrame:
    """Lines of text blocks that are not blank, as items that share the block's height evenly."""
    lines = F.filter(F.transform(F.split("text", "\n"), t.strip), lambda x: F.length(x) > 0)
    rows = blocks.withColumn("_l", lines).withColumn("_h", (F.col("y1") - F.col("y0")) / F.size("_l")).select("*", F.posexplode("_l").alias("item", "line"))
    return rows.select(*PAGE, "seq", "item", F.col("line").alias("text"), "x0", (F.col("y1") - (F.col("item") + 1) * F.col("_h")).alias("y0"), "x1", (F.col("y1") - F.col("item") * F.col("_h")).alias("y1"))


def rows_sorted(objects: DataFrame) -> DataFrame:
    """Adds place: rows whose tops follow each other within TOP_NEAR are one band, read from the left."""
    down = Window.partitionBy(*PAGE).orderBy(F.desc("y1"), "x0", "seq")
    fresh = F.coalesce(F.lag("y1").over(down) - F.col("y1") > TOP_NEAR, F.lit(True)).cast("int")
    rows = objects.withColumn("_fresh", fresh).withColumn("band", F.sum("_fresh").over(down))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy("band", "x0", "seq"))).drop("_fresh", "band")


def classified(label: Column, text: Column, orig: Column) -> tuple[Column, Column]:
    """(type, text) of an item by its label; page headers and footers have no type."""
    kind = F.when(label.isin("page_header", "page_footer"), None).when(label == "section_header", "heading").when(label == "formula", "formula").otherwise("paragraph")
    return kind, F.coalesce(F.nullif(text, F.lit("")), orig)


def matched_chunks(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, page, seq, node): each chunk whose centre lies in a node, widened by five points, with
    the first such node in order: as if nodes took chunks greedily, each once."""
    both = renamed(chunks, "w", ["seq", *BOX]).join(renamed(nodes, "n", ["seq", *BOX]), PAGE).filter(near_centre("w", "n", NODE_NEAR))
    return both.groupBy(*PAGE, F.col("wseq").alias("seq")).agg(F.min("nseq").alias("node"))


def trusted(nodes: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """nodes (with text) with the stream's text and its source: stream where the texts are alike
    enough, ocr where not, ocr-fallback where no chunk lies in the node; and the similarity."""
    got = matched_chunks(nodes, chunks).join(chunks.select(*PAGE, "seq", F.col("text").alias("_t")), [*PAGE, "seq"])
    parts = F.array_sort(F.collect_list(F.struct("seq", "_t")))
    stream = got.groupBy(*PAGE, F.col("node").alias("seq")).agg(F.array_join(F.transform(parts, lambda p: p["_t"]), " ").alias("stream"))
    rows = nodes.join(stream, [*PAGE, "seq"], "left").withColumn("similarity", F.when(F.col("stream").isNotNull(), t.similarity(F.col("stream"), F.col("text"))))
    source = F.when(F.col("stream").isNull(), "ocr-fallback").when(F.col("similarity") >= least, "stream").otherwise("ocr")
    return rows.withColumn("source", source)


def nearest_images(pictures: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, seq, image): a picture's nearest image whose centre lies in it, within a point; ties to the first."""
    both = renamed(images, "w", ["seq", *BOX]).join(renamed(pictures, "n", ["seq", *BOX]), PAGE).filter(near_centre("w", "n", PICTURE_NEAR))
    far = F.hypot(centre("w", "x0", "x1") - centre("n", "x0", "x1"), centre("w", "y0", "y1") - centre("n", "y0", "y1"))
    return both.groupBy(*PAGE, F.col("nseq").alias("seq")).agg(F.min_by("wseq", F.struct(far, "wseq")).alias("image"))


def words_in_nodes(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, page, seq, words): how many words' centres lie in each node, widened by five points."""
    both = renamed(words, "w", BOX).join(renamed(nodes, "n", ["seq", *BOX]), PAGE).filter(near_centre("w", "n", NODE_NEAR))
    return both.groupBy(*PAGE, F.col("nseq").alias("seq")).agg(F.count("*").alias("words"))


def merged_pages(local: DataFrame, backend: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, page, contents, source) of wanted pages: the local result, else the backend's, else empty."""
    a, b = local.select(*PAGE, F.col("contents").alias("_a")), backend.select(*PAGE, F.col("contents").alias("_b"))
    both = wanted.select(*PAGE).join(a, PAGE, "left").join(b, PAGE, "left")
    source = F.when(F.col("_a").isNotNull(), "local").when(F.col("_b").isNotNull(), "backend").otherwise("empty")
    return both.select(*PAGE, F.coalesce("_a", "_b", F.lit("")).alias("contents"), source.alias("source"))


def rekeyed(metadata: DataFrame, ids: DataFrame) -> DataFrame:
    """Metadata (doc_id, id, ...) under the ids that replaced its own (doc_id, old_id, new_id)."""
    other = ids.select("doc_id", F.col("old_id").alias("id"), "new_id")
    return metadata.join(other, ["doc_id", "id"], "left").withColumn("id", F.coalesce("new_id", "id")).drop("new_id")


def still_present(metadata: DataFrame, ids: DataFrame) -> DataFrame:
    """Metadata of ids that are still there."""
    return metadata.join(ids.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi")


def in_cells(contents: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, page, seq, table, cell): contents with the cell of a table that covers most of them."""
    both = renamed(contents, "w", ["seq", *BOX]).join(renamed(cells, "c", ["table", "cell", *BOX]), PAGE).withColumn("share", share_inside("w", "c")).filter("share > 0")
    best = F.max_by(F.struct(F.col("ctable").alias("table"), F.col("ccell").alias("cell")), F.struct("share", -F.col("ctable"), -F.col("ccell")))
    return both.groupBy(*PAGE, F.col("wseq").alias("seq")).agg(best.alias("b")).select(*PAGE, "seq", "b.table", "b.cell")


def table_quality(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table, rows, columns, filled_rows, filled_columns, lines) of cells (row, col, text)."""
    text = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    return cells.groupBy(*PAGE, "table").agg(
        F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("columns"), F.count_distinct(F.when(text, F.col("row"))).alias("filled_rows"),
        F.count_distinct(F.when(text, F.col("col"))).alias("filled_columns"), F.sum(F.when(text, F.size(F.split("text", "\n"))).otherwise(0)).cast("long").alias("lines"),
    )


def clustered_cells(texts: DataFrame, gap: float = 10.0) -> DataFrame:
    """Texts of a page without ruled lines as a grid: rows are bands of vertical overlap, columns bands
    of horizontal overlap that stand `gap` apart; pages with two of both at least. Adds row and col."""
    def bands(rows: DataFrame, lo: Column, hi: Column, apart: float, name: str) -> DataFrame:
        w = Window.partitionBy(*PAGE).orderBy(lo, "seq")
        end = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.coalesce(lo - end >= apart, F.lit(True)).cast("int")
        return rows.withColumn("_f", fresh).withColumn(name, F.sum("_f").over(w)).drop("_f")

    rows = bands(texts, -F.col("y1"), -F.col("y0"), 0.0, "row")
    rows = bands(rows, F.col("x0"), F.col("x1"), gap, "col")
    w = Window.partitionBy(*PAGE)
    return rows.withColumns({"_r": F.max("row").over(w), "_c": F.max("col").over(w)}).filter("_r > 1 and _c > 1").drop("_r", "_c")


def into_tables(objects: DataFrame, borders: DataFrame) -> DataFrame:
    """Objects with the table (seq of its border) that holds half of them or more, and place: a table
    stands where its first member stood. borders: doc_id, page, seq, box."""
    both = renamed(objects.filter("kind <> 'line'"), "w", ["seq", *BOX]).join(renamed(borders, "c", ["seq", *BOX]), PAGE).filter(share_inside("w", "c") >= 0.5)
    owner = both.groupBy(*PAGE, F.col("wseq").alias("seq")).agg(F.min("cseq").alias("table"))
    rows = objects.join(owner, [*PAGE, "seq"], "left")
    first = F.min("seq").over(Window.partitionBy(*PAGE, "table"))
    return rows.withColumn("place", F.when(F.col("table").isNotNull(), first).otherwise(F.col("seq")))


DOCLING = T.StructType(
    [
        T.StructField("texts", T.ArrayType(T.StructType([
            T.StructField("label", T.StringType()), T.StructField("text", T.StringType()), T.StructField("orig", T.StringType()),
            T.StructField("prov", T.ArrayType(T.StructType([T.StructField("page_no", T.IntegerType()), T.StructField("bbox", T.StructType([
                T.StructField("l", T.DoubleType()), T.StructField("t", T.DoubleType()), T.StructField("r", T.DoubleType()), T.StructField("b", T.DoubleType()), T.StructField("coord_origin", T.StringType())]))]))),
        ]))),
    ]
)


def docling_objects(responses: DataFrame, heights: DataFrame) -> DataFrame:
    """Page objects of a backend's JSON texts: doc_id, page, seq, type, text, x0, y0, x1, y1 from the
    page's bottom. responses: doc_id, json. Headers, footers and items without a place are left out."""
    items = responses.select("doc_id", F.posexplode(F.from_json("json", DOCLING)["texts"]).alias("seq", "i"))
    at = F.get("i.prov", F.lit(0))
    kind, text = classified(F.col("i.label"), F.col("i.text"), F.col("i.orig"))
    flat = items.select(
        "doc_id", at["page_no"].alias("page"), "seq", kind.alias("type"), text.alias("text"),
        at["bbox"]["l"].alias("left"), at["bbox"]["t"].alias("top"), at["bbox"]["r"].alias("right"), at["bbox"]["b"].alias("bottom"), at["bbox"]["coord_origin"].alias("origin"),
    ).filter("type is not null and page is not null")
    return to_points(flat, heights, pixels=False).select(*PAGE, "seq", "type", "text", *BOX)


ELEMENTS = (
    "elements array<struct<category: struct<type: string>, pageIndex: int, bbox: struct<left: double, top: double, width: double, height: double>, content: struct<text: string>>>"
)
#: Types of elements that are named by category; others are paragraphs if they have a text.
CATEGORIES = {"PARAGRAPH": "paragraph", "LIST_ITEM": "paragraph", "HEADING": "heading", "TABLE": "table", "FIGURE": "picture", "FORMULA": "formula"}
DEFAULT_HEIGHT = 842.0


def category_objects(responses: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """Page objects of a backend's JSON texts that name elements by category, with boxes from the page's
    top: doc_id, page (from 1), seq, type, text, heading_level (1 on headings), picture (number in
    the document), x0, y0, x1, y1 from the page's bottom, place (reading order).

    responses: doc_id, json; heights: doc_id, page, height, 842 where they lack a page. Page headers and
    footers, elements without a category or box, and empty ones of an unknown type are left out.
    JSON that can't be read gives no objects.
    """
    items = responses.select("doc_id", F.posexplode(F.from_json("json", ELEMENTS)["elements"]).alias("seq", "e"))
    said, text = F.col("e.category.type"), F.coalesce("e.content.text", F.lit(""))
    known = F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))])[said]
    rows = items.withColumns({"type": F.coalesce(known, F.when(text != "", "paragraph")), "page": F.coalesce("e.pageIndex", F.lit(0)).cast("long") + 1, "text": text})
    rows = rows.filter(said.isNotNull() & ~said.isin("PAGE_HEADER", "PAGE_FOOTER") & F.col("type").isNotNull() & F.col("e.bbox").isNotNull())
    if heights is not None:
        rows = rows.join(heights.select(*PAGE, "height"), PAGE, "left")
    height = F.coalesce(F.col("height"), F.lit(DEFAULT_HEIGHT)) if heights is not None else F.lit(DEFAULT_HEIGHT)
    part = lambda c: F.coalesce(f"e.bbox.{c}", F.lit(0.0))
    is_picture = F.col("type") == "picture"
    number = F.when(is_picture, F.count(F.when(is_picture, 1)).over(Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    flat = rows.select(
        *PAGE, F.col("seq").cast("long").alias("seq"), "type", F.when(F.col("type").isin("table", "picture"), F.lit(None)).otherwise(F.col("text")).alias("text"), F.when(F.col("type") == "heading", 1).alias("heading_level"), number.alias("picture"),
        part("left").alias("x0"), (height - part("top") - part("height")).alias("y0"), (part("left") + part("width")).alias("x1"), (height - part("top")).alias("y1"),
    )
    return rows_sorted(flat)
