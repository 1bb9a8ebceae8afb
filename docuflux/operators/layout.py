"""Layout operators over page objects: doc_id, page, seq, kind, x0, y0, x1, y1, text, font_size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.operators.groups import by_group

# Fixed values of the filters and of the routing rules.
TINY, GAP = 1.0, 5.0
RATIO_LIMIT, LINE_RATIO, IMAGE_AREA, IMAGE_ASPECT = 0.3, 0.3, 0.11, 1.75
BASELINE_NEAR, TEXT_GAP, COLUMN_SHIFT, RULE_NEAR = 0.1, 1.5, 2.0, 0.05
BETA, NARROW, SAME_SIZE = 2.0, 0.1, 0.01
# End of fixed values.

PAGE = ["doc_id", "page"]


def tiny(c=F.col) -> Column:
    return (c("kind") == "text") & (c("y1") - c("y0") <= TINY)


def off_page(width: Column, height: Column) -> Column:
    return (F.col("x1") < 0) | (F.col("x0") > width) | (F.col("y1") < 0) | (F.col("y0") > height)


def background(width: Column, height: Column) -> Column:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return (F.col("kind") == "art") & (((w > 0.5 * width) & (h > 0.1 * height)) | ((w > 0.1 * width) & (h > 0.5 * height)))


def filtered(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """objects without tiny text, what lies off its page, and background art. pages: doc_id, page, width, height."""
    both = objects.join(pages, PAGE)
    drop = tiny() | off_page(F.col("width"), F.col("height")) | background(F.col("width"), F.col("height"))
    return both.filter(~drop).select(*objects.columns)


def placed(objects: DataFrame) -> DataFrame:
    """Adds place: order by top (high first), left, bottom, right; null boxes last."""
    w = Window.partitionBy(*PAGE).orderBy(F.desc_nulls_last("y1"), F.asc_nulls_last("x0"), F.asc_nulls_last("y0"), F.asc_nulls_last("x1"), "seq")
    return objects.withColumn("place", F.row_number().over(w))


def deduped(objects: DataFrame) -> DataFrame:
    """Drops a text whose successor of the same text on the page is as large and overlaps it by more than half."""
    w = Window.partitionBy(*PAGE, "text").orderBy("seq")
    n = {c: F.lead(c).over(w) for c in ("x0", "y0", "x1", "y1")}
    wide = F.least("x1", n["x1"]) - F.greatest("x0", n["x0"])
    high = F.least("y1", n["y1"]) - F.greatest("y0", n["y0"])
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    close = (F.abs((F.col("x1") - F.col("x0")) - (n["x1"] - n["x0"])) <= SAME_SIZE) & (F.abs((F.col("y1") - F.col("y0")) - (n["y1"] - n["y0"])) <= SAME_SIZE)
    same = (F.col("kind") == "text") & n["x0"].isNotNull() & close & (wide > 0) & (high > 0) & (wide * high > 0.5 * area)
    return objects.withColumn("_d", F.coalesce(same, F.lit(False))).filter("not _d").drop("_d")


def signals(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts, patterns and ratios of each page that routing looks at. objects need baseline; pages:
    doc_id, page, width, height. Texts of white space only are counted, but no neighbours."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    text = (F.col("kind") == "text") & (F.length(F.trim("text")) > 0)
    flat = (F.col("kind") == "line") & (wide > 3 * high)
    upright = (F.col("kind") == "line") & ~(wide > 3 * high) & (high > 3 * wide)
    rows = objects.withColumns({"_text": text, "_flat": flat, "_up": upright})
    last = F.last(F.when(F.col("_text"), F.struct("x0", "y0", "x1", "y1", "baseline")), ignorenulls=True).over(before)
    # of text and flat lines, whether the latest one was a line
    ruled = F.last(F.when(F.col("_flat"), True).when(F.col("_text"), False), ignorenulls=True).over(before)
    rows = rows.withColumns({"_p": last, "_separator": F.col("_flat") & ~F.coalesce(ruled, F.lit(False))})
    p = lambda c: F.col(f"_p.{c}")
    climbs = (p("y1") < F.col("y0")) & ~((p("x1") > p("x0")) & (p("x0") - F.col("x0") > COLUMN_SHIFT * (p("x1") - p("x0"))))
    beside = ~(p("y1") < F.col("y0")) & (F.abs(p("baseline") - F.col("baseline")) < BASELINE_NEAR * ((p("y1") - p("y0")) + high) / 2) & (F.col("x0") - p("x1") > TEXT_GAP * high)
    odd = F.col("_text") & F.coalesce(climbs | beside, F.lit(False))
    rows = rows.withColumn("_odd", odd).withColumn("_run", F.sum((F.col("_text") & ~F.col("_odd")).cast("int")).over(w))
    area = wide * high
    image = F.when(F.col("kind") == "image", F.struct(area.alias("area"), (-F.col("seq")).alias("order"), F.when(high > 0, wide / high).otherwise(0.0).alias("aspect")))
    parts = rows.groupBy(*PAGE, "_run").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("line", "art", "text", "table")], F.count_if("_text").alias("words"), F.count_if("_flat").alias("flat"),
        F.count_if("_up").alias("upright"), F.count_if("_separator").alias("separators"), F.count_if("_odd").alias("odd"), F.max(image).alias("image"),
        F.collect_list(F.when(F.col("_flat"), F.struct(F.col("x0").alias("x"), wide.alias("w")))).alias("rules"),
        F.sum(F.length("text")).alias("chars"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("�")))).alias("lost"),
    )
    out = parts.groupBy(*PAGE).agg(
        *[F.sum(c).alias(c) for c in ("n", "lines", "arts", "texts", "tables", "words", "flat", "upright", "separators", "odd", "chars", "lost")],
        F.max("odd").alias("streak"), F.max("image").alias("image"), F.flatten(F.collect_list("rules")).alias("rules"),
    ).join(pages, PAGE)
    near = lambda x, y: (F.greatest(x["w"], y["w"]) > 0) & (F.abs(x["x"] - y["x"]) <= RULE_NEAR * F.greatest(x["w"], y["w"])) & (F.abs(x["w"] - y["w"]) <= RULE_NEAR * F.greatest(x["w"], y["w"]))
    aligned = F.exists("rules", lambda x: F.size(F.filter("rules", lambda y: near(x, y))) >= 2)
    return out.select(
        *PAGE, "n", "lines", "arts", "texts", "tables", "flat", "upright", "separators", "odd", "streak", aligned.alias("aligned"), (F.col("lines") / F.col("n")).alias("line_ratio"),
        F.when(F.col("words") > 0, F.col("odd") / F.col("words")).otherwise(0.0).alias("density"),
        F.coalesce(F.col("image.area") / (F.col("width") * F.col("height")), F.lit(0.0)).alias("image_area"), F.coalesce("image.aspect", F.lit(0.0)).alias("image_aspect"),
        F.when(F.col("chars") > 0, F.col("lost") / F.col("chars")).otherwise(0.0).alias("lost_ratio"),
    )


def routed(found: DataFrame) -> DataFrame:
    """decision and confidence of each page; the first rule that holds."""
    ruled = ((F.col("flat") >= 3) & (F.col("upright") >= 3)) | (F.col("flat") + F.col("upright") >= 8) | (F.col("arts") >= 8) | (F.col("separators") >= 5) | F.col("aligned")
    patterned = ((F.col("streak") >= 2) | (F.col("odd") >= 30)) & ((F.col("odd") >= 3) | ((F.col("density") >= 0.1) & (F.col("odd") >= 2)))
    rules = [
        (F.col("lost_ratio") >= RATIO_LIMIT, "BACKEND", 1.0),
        (F.col("tables") > 0, "BACKEND", 1.0),
        (ruled, "BACKEND", 0.95),
        (patterned, "BACKEND", 0.9),
        ((F.col("image_area") >= IMAGE_AREA) & (F.col("image_aspect") >= IMAGE_ASPECT), "BACKEND", 0.85),
        (F.col("line_ratio") > LINE_RATIO, "BACKEND", 0.8),
    ]
    decision, confidence = F.lit("LOCAL"), F.lit(0.9)
    for test, name, sure in reversed(rules):
        decision, confidence = F.when(test, name).otherwise(decision), F.when(test, sure).otherwise(confidence)
    return found.withColumns({"decision": decision, "confidence": confidence})


def baseline_groups(objects: DataFrame) -> DataFrame:
    """(doc_id, page, groups): how many baselines (to a tenth) carry two texts or more with a gap of over three heights."""
    w = Window.partitionBy(*PAGE, "at").orderBy("x0", "seq")
    rows = objects.filter("kind = 'text'").withColumn("at", F.round("baseline", 1))
    gap = F.coalesce(F.col("x0") - F.lag("x1").over(w) > 3 * (F.col("y1") - F.col("y0")), F.lit(False))
    by = rows.withColumn("gap", gap).groupBy(*PAGE, "at").agg(F.bool_or("gap").alias("gap"))
    return by.groupBy(*PAGE).agg(F.count_if("gap").alias("groups"))


def font_modes(objects: DataFrame, value: str = "font_size") -> DataFrame:
    """(doc_id, value, n): the commonest size (or weight) of a document's texts, the least of equals."""
    counts = objects.filter(F.col("kind") == "text").groupBy("doc_id", value).agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("m")).select("doc_id", "m.*")


def regions(objects: DataFrame) -> DataFrame:
    """(doc_id, page, box around all objects, density): how much of the box the objects' areas come to, 1 at most."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    out = objects.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum(area).alias("_a"))
    whole = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return out.withColumn("density", F.when(whole > 0, F.least(F.lit(1.0), F.col("_a") / whole)).otherwise(1.0)).drop("_a")


def heading_levels(objects: DataFrame) -> DataFrame:
    """Adds level to headings: dense rank of their font size in the document, largest first."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("font_size"))
    return objects.filter("kind = 'heading'").withColumn("level", F.dense_rank().over(w))


def widest_gap(spans: list[tuple[float, float]]) -> tuple[float, float]:
    """(width, middle) of the widest gap between intervals, the first of equals."""
    best, cut, end = 0.0, 0.0, None
    for lo, hi in sorted(spans):
        if end is not None and lo - end > best:
            best, cut = lo - end, (end + lo) / 2
        end = hi if end is None else max(end, hi)
    return best, cut


def reading(boxes: list[tuple[float, float, float, float]], beta: float = BETA) -> list[int]:
    """Places of boxes (x0, y0, x1, y1; y goes up) in reading order.

    Boxes beta times as wide as the widest that overlap two others are set aside. The rest is cut at
    its widest gap, across or down, for as long as one of GAP points is left; a gap between columns
    is also looked for without narrow boxes. What can't be cut is read from the top, then the left. Boxes
    set aside come back before the first box below their top.
    """
    top_left = lambda i: (-boxes[i][3], boxes[i][0])
    width = lambda i: boxes[i][2] - boxes[i][0]
    whole = list(range(len(boxes)))
    aside: set[int] = set()
    if len(boxes) > 2:
        limit = beta * max(map(width, whole))
        for i in whole:
            if width(i) >= limit:
                met = 0
                for j in whole:
                    least = min(width(i), width(j))
                    both = min(boxes[i][2], boxes[j][2]) - max(boxes[i][0], boxes[j][0])
                    met += j != i and both > 0 and least > 0 and both / least >= 0.1
                if met >= 2:
                    aside.add(i)
    rest = [i for i in whole if i not in aside]
    if not rest:
        return sorted(whole, key=top_left)

    def columns(part: list[int]) -> tuple[float, float]:
        gap, cut = widest_gap([(boxes[i][0], boxes[i][2]) for i in part])
        if gap < GAP and len(part) > 2:
            least = NARROW * (max(boxes[i][2] for i in part) - min(boxes[i][0] for i in part))
            solid = [i for i in part if width(i) >= least]
            if 2 <= len(solid) < len(part):
                other = widest_gap([(boxes[i][0], boxes[i][2]) for i in solid])
                if other[0] > gap and other[0] >= GAP:
                    return other
        return gap, cut

    done, stack = [], [rest]
    while stack:
        part = stack.pop()
        if len(part) > 1:
            gap_x, cut_x = columns(part)
            gap_y, cut_y = widest_gap([(-boxes[i][3], -boxes[i][1]) for i in part])
            down = gap_y >= GAP and (gap_x < GAP or gap_y > gap_x)
            if down or gap_x >= GAP:
                middle = (lambda i: -(boxes[i][1] + boxes[i][3]) / 2) if down else (lambda i: (boxes[i][0] + boxes[i][2]) / 2)
                cut = cut_y if down else cut_x
                first, second = [i for i in part if middle(i) < cut], [i for i in part if middle(i) >= cut]
                if first and second:
                    stack += [second, first]
                    continue
            part = sorted(part, key=top_left)
        done += part
    out, wide = [], sorted(aside, key=top_left)
    for i in done:
        while wide and boxes[wide[0]][3] >= boxes[i][3]:
            out.append(wide.pop(0))
        out.append(i)
    return out + wide


def reading_order(objects: DataFrame) -> DataFrame:
    """(doc_id, page, seq, place) of objects with a box. One page is worked on at a time, many a batch."""

    def order(rows: list[dict]) -> list[dict]:
        got = reading([(r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows])
        return [{"doc_id": rows[i]["doc_id"], "page": rows[i]["page"], "seq": rows[i]["seq"], "place": n + 1} for n, i in enumerate(got)]

    whole = objects.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null").select(*PAGE, "seq", "x0", "y0", "x1", "y1")
    return by_group(whole, PAGE, ["seq"], order, "doc_id long, page long, seq long, place int")


def nearest(captions: DataFrame, floats: DataFrame) -> DataFrame:
    """Each caption with the float on its page of least vertical centre distance, ties by seq."""
    mid = lambda c: (F.col(f"{c}.y0") + F.col(f"{c}.y1")) / 2
    pairs = captions.alias("c").join(floats.alias("f"), PAGE).select(*PAGE, F.col("c.seq").alias("seq"), F.col("f.seq").alias("float_seq"), F.abs(mid("c") - mid("f")).alias("far"))
    w = Window.partitionBy(*PAGE, "seq").orderBy("far", "float_seq")
    return pairs.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
