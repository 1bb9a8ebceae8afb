"""Text lines, paragraphs, headings, lists and levels of page objects: doc_id, page, seq, kind, x0,
y0, x1, y1, text, font_size, font_weight, color, baseline.

Whatever looks at a neighbour is a window over the page, and what joins neighbours is a run that a
break ends; steps that keep a stack or a used set go through ordered groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.operators.groups import by_group, stepped
from docuflux.operators.layout import PAGE

# Fixed values of the detectors.
CONTRAST, CLOSE = 1.2, 0.1
TOP_NEAR, BOTTOM_NEAR, LEFT_NEAR, RIGHT_NEAR = 0.3, 0.1, 0.1, 1.5
STROKE, MIDDLE, COVERED, LONGER = 1.3, 0.2, 0.8, 1.5
SIZE_MODE, SIZE_RANGE, SIZE_BOOST = (10.0, 13.0), (10.0, 32.0), 0.5
WEIGHT_MODE, WEIGHT_RANGE, WEIGHT_BOOST = (395.0, 405.0), (400.0, 900.0), 0.3
HEADING, BULLETED = 0.75, 0.1
EDGE_GAP, TABLE_NEAR, LOOK_BACK = 30.0, 0.2, 500
LABEL = r"^\s*(?:([•◦▪‣·*+-])|\(?(\d{1,3})[.)]|\(?([A-Za-z])[.)])\s+"
ADDRESS_LINE = r"^\(?(수신|경유|제목)\)?.*"
# End of fixed values.


def height(c: str = "") -> Column:
    return F.col(f"{c}y1") - F.col(f"{c}y0")


def along() -> Window:
    return Window.partitionBy(*PAGE).orderBy("seq")


def so_far() -> Window:
    return along().rowsBetween(Window.unboundedPreceding, 0)


def is_text() -> Column:
    return F.col("kind") == "text"


def runs(rows: DataFrame, fresh: Column, name: str) -> DataFrame:
    """rows with the number of their run: a row that is `fresh` begins one."""
    return rows.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn(name, F.sum("_fresh").over(so_far())).drop("_fresh")


# filters --------------------------------------------------------------------------------------


def visible(objects: DataFrame, limit: float = CONTRAST, layers: bool = True) -> DataFrame:
    """objects without text of a contrast below the limit and, with layers, without hidden layers."""
    hidden = F.coalesce(is_text() & (F.col("contrast") < limit), F.lit(False))
    off = F.coalesce(F.col("hidden"), F.lit(False)) if layers else F.lit(False)
    return objects.filter(~hidden & ~off)


def undecorated(objects: DataFrame) -> DataFrame:
    """objects without images that lie within the latest text before them, up to shares of its height."""
    box = F.struct("x0", "y0", "x1", "y1")
    last = F.last(F.when(is_text(), box), ignorenulls=True).over(so_far())
    rows = objects.withColumn("_t", last)
    h = F.col("_t.y1") - F.col("_t.y0")
    near = lambda c, share: F.abs(F.col(c) - F.col(f"_t.{c}")) <= share * h
    inside = near("y1", TOP_NEAR) & near("y0", BOTTOM_NEAR) & (near("x0", LEFT_NEAR) | (F.col("x0") > F.col("_t.x0"))) & (near("x1", RIGHT_NEAR) | (F.col("x1") < F.col("_t.x1")))
    return rows.filter(~F.coalesce((F.col("kind") == "image") & inside, F.lit(False))).drop("_t")


def in_zone(top: bool, page_height: Column) -> Column:
    """Whether an object lies in the upper (or lower) third of its page."""
    return F.col("y0") >= page_height * 2 / 3 if top else F.col("y1") <= page_height / 3


def struck(objects: DataFrame) -> DataFrame:
    """(doc_id, page, seq) of text that a line strikes through; a line through several strikes none."""
    t = objects.filter(is_text() & (F.length(F.trim("text")) > 0) & (height() > 0) & (F.col("x1") > F.col("x0"))).select(*PAGE, "seq", "x0", "y0", "x1", "y1")
    lines = objects.filter("kind = 'line'").select(*PAGE, F.col("seq").alias("line"), *[F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")])
    wide, both = F.col("x1") - F.col("x0"), F.least("x1", "lx1") - F.greatest("x0", "lx0")
    hit = (
        (F.col("ly1") - F.col("ly0") <= STROKE * height()) & (F.abs((F.col("ly0") + F.col("ly1")) / 2 - (F.col("y0") + F.col("y1")) / 2) <= MIDDLE * height())
        & (both > 0) & (both / wide >= COVERED) & ((F.col("lx1") - F.col("lx0")) / wide <= LONGER)
    )
    met = t.join(lines, PAGE).filter(hit)
    alone = F.count("*").over(Window.partitionBy(*PAGE, "line")) == 1
    return met.withColumn("alone", alone).filter("alone").select(*PAGE, "seq").distinct()


# lines and paragraphs ---------------------------------------------------------------------------


def merged_chunks(objects: DataFrame) -> DataFrame:
    """Neighbouring texts of one style and baseline whose ends meet, as one: doc_id, page, seq (of the last), text, box."""
    p = lambda c: F.lag(c).over(along())
    same = (p("kind") == "text") & is_text() & (p("font_size") == F.col("font_size")) & (p("font_weight") == F.col("font_weight")) & p("color").eqNullSafe(F.col("color"))
    meets = (F.abs(p("baseline") - F.col("baseline")) <= CLOSE * (p("y1") - p("y0"))) & (F.abs(p("x1") - F.col("x0")) <= CLOSE * (p("y1") - p("y0")))
    cut = runs(objects, ~F.coalesce(same & meets, F.lit(False)), "run")
    return joined(cut, "run", "")


def joined(rows: DataFrame, run: str, between: str) -> DataFrame:
    """One row for each run: its last seq, the texts in order and the box around them."""
    parts = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy(*PAGE, run).agg(
        F.max("seq").alias("seq"), F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["text"]), between).alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    ).drop(run)


def text_lines(objects: DataFrame) -> DataFrame:
    """Text in lines: a text stays on the line of the one before it while they overlap by half of the
    lower one's height and it does not go back to the left. Adds line; other kinds are left out."""
    rows = objects.filter(is_text())
    p = lambda c: F.lag(c).over(along())
    overlap = F.least(p("y1"), F.col("y1")) - F.greatest(p("y0"), F.col("y0"))
    stays = (overlap >= 0.5 * F.least(p("y1") - p("y0"), height())) & (F.col("x0") >= p("x0"))
    return runs(rows, ~F.coalesce(stays, F.lit(False)), "line")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines in paragraphs. lines: doc_id, page, seq, x0, y0, x1, y1, font_size, text, a row for each line.

    A line joins the one above it if their font sizes are close, the gap between them is at most a
    line's height, and they are aligned: both sides, left, centre or right, within a tenth of the height; or if
    the upper one is a first line set in by up to three heights. Adds paragraph and alignment
    (of the line to the one above; null on first lines).
    """
    p = lambda c: F.lag(c).over(along())
    h = F.least(height(), p("y1") - p("y0"))
    near = lambda a, b, share: F.abs(a - b) <= share * h
    left, right = near(p("x0"), F.col("x0"), 0.1), near(p("x1"), F.col("x1"), 0.1)
    centre = near(p("x0") + p("x1"), F.col("x0") + F.col("x1"), 0.2)
    indent = (p("x0") > F.col("x0")) & (p("x0") - F.col("x0") <= 3 * h)
    alignment = F.when(left & right, "justify").when(left, "left").when(centre, "centre").when(right, "right").when(indent, "first line")
    follows = near(p("font_size"), F.col("font_size"), 0.1) & (p("y0") - F.col("y1") <= h) & (p("y0") >= F.col("y0"))
    rows = lines.withColumn("alignment", F.when(follows, alignment))
    return runs(rows, F.col("alignment").isNull(), "paragraph")


# headings ---------------------------------------------------------------------------------------


def rarity(rows: DataFrame, value: str, mode: tuple[float, float], span: tuple[float, float], keys: list[str], name: str) -> DataFrame:
    """Adds how rare a value is among those above the keys' commonest one: its rank from below among
    the distinct values in span that exceed it, over their number; 0 for others. Of equally common
    values within `mode` the least is the commonest; without one, 0 is."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    common = F.min(F.when(F.col(value).between(*mode), F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))).over(w)["v"]
    above = counts.withColumn("_m", F.coalesce(common, F.lit(0.0))).filter((F.col(value) > F.col("_m")) & F.col(value).between(*span))
    ranked = above.select(*keys, value, (F.row_number().over(w.orderBy(value)) / F.count("*").over(w)).alias(name))
    return rows.join(ranked, [*keys, value], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def bulleted(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(LABEL)), F.lit(False))


def headings(nodes: DataFrame, base: Column) -> DataFrame:
    """Text nodes with their heading score and whether they are headings. base: the chance that a
    node is one by a model of its own (0 without). A page's nodes are compared."""
    rows = rarity(nodes, "font_size", SIZE_MODE, SIZE_RANGE, PAGE, "_size")
    rows = rarity(rows, "font_weight", WEIGHT_MODE, WEIGHT_RANGE, PAGE, "_weight")
    score = base + SIZE_BOOST * F.col("_size") + WEIGHT_BOOST * F.col("_weight") + F.when(bulleted(F.col("text")), BULLETED).otherwise(0.0)
    return rows.withColumn("score", score).withColumn("heading", F.col("score") > HEADING).drop("_size", "_weight")


def styled_levels(headings_: DataFrame) -> DataFrame:
    """Adds level: the place of a heading's style (size, weight, colour) among its document's, largest
    first; headings without a colour take the level of the style nearest in size, the upper one of equals."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("font_size"), F.desc("font_weight"), "color")
    with_color = headings_.filter("color is not null").withColumn("level", F.dense_rank().over(w))
    styles = with_color.select("doc_id", F.col("font_size").alias("_size"), F.col("level").alias("_level")).distinct()
    without = headings_.filter("color is null")
    near = without.join(styles, "doc_id", "left").groupBy(*without.columns).agg(F.min_by("_level", F.struct(F.abs(F.col("font_size") - F.col("_size")), "_level")).alias("level"))
    return with_color.unionByName(near.withColumn("level", F.coalesce("level", F.lit(1))))


def normal_levels(headings_: DataFrame) -> DataFrame:
    """Adds shown: levels without gaps from 1, and no deeper than one below the heading before it."""

    def start():
        before = [0]

        def step(level: int) -> tuple[int]:
            before[0] = min(level, before[0] + 1)
            return (before[0],)

        return step

    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("level"))
    rows = headings_.select("doc_id", "seq", "level", rank.alias("_step"))
    return stepped(rows, ["doc_id"], ["seq"], ["_step"], start, "shown int").drop("_step")


# repeated edges of pages --------------------------------------------------------------------------


def page_edges(objects: DataFrame, page_height: Column, top: bool = True, rounds: int = 4) -> DataFrame:
    """(doc_id, page, seq) of what repeats at the top (or bottom) of pages: the k-th object from the
    edge that is alike on the next page or the one after it, for as long as the edge grows without a gap
    of over EDGE_GAP, and that lies in the outer third. Alike: texts that overlap in place, of one
    size, and equal but for a number that goes up with the page; other kinds in the same place."""
    order = Window.partitionBy(*PAGE).orderBy("seq" if top else F.desc("seq"))
    masked, number = F.regexp_replace("text", r"\d+", "0"), F.regexp_extract("text", r"(\d+)", 1).try_cast("long")
    cut = objects.withColumns({"k": F.row_number().over(order), "masked": masked, "number": number}).filter(F.col("k") <= rounds)

    def alike(a: dict, b: dict, step: int) -> bool:
        if a["kind"] != b["kind"]:
            return False
        if a["kind"] != "text":
            return all(a[c] == b[c] for c in ("x0", "y0", "x1", "y1"))
        over = min(a["x1"], b["x1"]) > max(a["x0"], b["x0"]) and min(a["y1"], b["y1"]) > max(a["y0"], b["y0"])
        counted = a["masked"] == b["masked"] and None not in (a["number"], b["number"]) and b["number"] - a["number"] == step
        return over and a["font_size"] == b["font_size"] and (a["text"] == b["text"] or counted)

    def grow(rows: list[dict]) -> list[dict]:
        at = {(r["page"], r["k"]): r for r in rows}
        edge, found = sorted({r["page"] for r in rows}), []
        for k in range(1, rounds + 1):
            here = {}
            for page in edge:
                r, outer = at.get((page, k)), at.get((page, k - 1))
                if r and (k == 1 or (outer["y0"] - r["y1"] if top else r["y0"] - outer["y1"]) <= EDGE_GAP):
                    here[page] = r
            edge = [p for p, r in here.items() if any(p + n in here and alike(r, here[p + n], n) for n in (1, -1, 2, -2))]
            found += [here[p] for p in edge]
        return found

    fields = ["seq", "kind", "x0", "y0", "x1", "y1", "text", "font_size", "k", "masked", "number"]
    rows = by_group(cut.select(*PAGE, *fields), ["doc_id"], ["page", "k"], grow, "doc_id long, page long, seq long, y0 double, y1 double")
    return rows.filter(in_zone(top, page_height)).select(*PAGE, "seq")


# lists, levels, ids -----------------------------------------------------------------------------


def labelled_lists(nodes: DataFrame) -> DataFrame:
    """(doc_id, page, seq, list, item) of text nodes whose labels make lists: equal bullets, or
    numbers or letters that go on by one, each within LOOK_BACK nodes of the item before it. A list has
    two items at least. nodes: doc_id, page, seq, text."""

    def label(text: str | None):
        import re

        m = re.match(LABEL, text or "")
        if not m:
            return None
        return ("bullet", m[1], 0) if m[1] else ("number", "", int(m[2])) if m[2] else ("letter", "A" if m[3].isupper() else "a", ord(m[3].lower()) - 96)

    def find(rows: list[dict]) -> list[dict]:
        open_, lists = {}, []
        for at, row in enumerate(rows):
            kind = label(row["text"])
            if kind is None:
                continue
            key = kind[:2]
            last = open_.get(key)
            if last is not None and at - last["at"] <= LOOK_BACK and (kind[0] == "bullet" or kind[2] == last["value"] + 1):
                last["items"].append(row)
                last.update(at=at, value=kind[2])
            elif kind[0] == "bullet" or kind[2] == 1:
                open_[key] = {"at": at, "value": kind[2], "items": [row]}
                lists.append(open_[key])
        out, n = [], 0
        for found in lists:
            if len(found["items"]) > 1:
                n += 1
                out += [{"doc_id": r["doc_id"], "page": r["page"], "seq": r["seq"], "list": n, "item": i + 1} for i, r in enumerate(found["items"])]
        return out

    return by_group(nodes.select(*PAGE, "seq", "text"), ["doc_id"], ["page", "seq"], find, "doc_id long, page long, seq long, list int, item int")


def level_walk(part: list[dict]) -> list[dict]:
    """Levels of a document's headings, lists and tables; see `levels`."""
    stack, titled, known, out = [], False, {}, []
    for r in part:
        if r["type"] == "heading":
            first = r["heading_level"] == 1 and not titled
            titled = titled or first
            level = "Doctitle" if first else "Subtitle"
        elif r["type"] in ("list", "table"):
            at = known.get(r["linked"])
            if at is None:
                at = stack.index(r["style"]) if r["style"] in stack else None
            if at is None:
                stack.append(r["style"])
                at = len(stack) - 1
            else:
                del stack[at + 1 :]
            known[r["seq"]] = at
            level = str(at + 1)
        else:
            continue
        out.append({"doc_id": r["doc_id"], "seq": r["seq"], "level": level})
    return out


def levels(rows: DataFrame) -> DataFrame:
    """Level of every heading, list and table in document order. rows: doc_id, seq, type, heading_level,
    style (what lists of one level share), linked (seq of the table or list that this one goes on).

    The first heading of level 1 is Doctitle, others Subtitle. A list or table takes the level of its
    style on the stack, which is cut behind it, or goes on top; one that goes on takes its part's level."""
    cut = rows.select("doc_id", "seq", "type", "heading_level", "style", "linked")
    return by_group(cut, ["doc_id"], ["seq"], level_walk, "doc_id long, seq long, level string")


def numbered(objects: DataFrame) -> DataFrame:
    """Adds id: the place of an object in its document, by page and seq, from 1."""
    return objects.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq")))


def linked_tables(objects: DataFrame) -> DataFrame:
    """(doc_id, seq, next_seq) of tables that go on in the next one: as many columns, close widths, and
    nothing between but headers, footers and lines. objects: doc_id, seq, kind, columns, widths (array)."""
    solid = objects.filter(~F.col("kind").isin("header", "footer", "line", "art"))
    n = lambda c: F.lead(c).over(Window.partitionBy("doc_id").orderBy("seq"))
    rows = solid.withColumns({"next_seq": n("seq"), "_kind": n("kind"), "_columns": n("columns"), "_widths": n("widths")})
    apart = F.exists(F.zip_with("widths", "_widths", lambda a, b: F.coalesce(F.abs(a - b) > TABLE_NEAR, F.lit(True))), lambda x: x)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    same = (F.col("kind") == "table") & (F.col("_kind") == "table") & (F.col("columns") == F.col("_columns")) & (F.abs(total("widths") - total("_widths")) <= TABLE_NEAR) & ~apart
    return rows.filter(same).select("doc_id", "seq", "next_seq")


def captions(objects: DataFrame, chance: Column) -> DataFrame:
    """(doc_id, page, seq, float_seq) of images and tables with the text before or after them that is the
    likelier caption, if its chance reaches 0.75. chance: of a text node. The text before wins only if likelier."""
    text = F.when(is_text() & (F.length(F.trim("text")) > 0), F.struct(F.col("seq").alias("seq"), chance.alias("p")))
    before = F.last(text, ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(text, ignorenulls=True).over(along().rowsBetween(1, Window.unboundedFollowing))
    rows = objects.withColumns({"_b": before, "_a": after}).filter(F.col("kind").isin("image", "table"))
    b, a = F.coalesce(F.col("_b.p"), F.lit(0.0)), F.coalesce(F.col("_a.p"), F.lit(0.0))
    best = F.when(b > a, F.col("_b")).otherwise(F.col("_a"))
    return rows.withColumn("_c", best).filter(F.greatest(a, b) >= 0.75).select(*PAGE, F.col("_c.seq").alias("seq"), F.col("seq").alias("float_seq"))


def address_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, page, table, row, first, second) of runs of address lines, cut at their first colon;
    a line without one is a single cell. lines: doc_id, page, seq, text."""
    hit = F.rlike("text", F.lit(ADDRESS_LINE))
    rows = lines.withColumn("_hit", hit)
    cut = runs(rows, ~(F.col("_hit") & F.lag("_hit").over(along())), "table").filter("_hit")
    at = F.instr("text", ":")
    row = F.row_number().over(Window.partitionBy(*PAGE, "table").orderBy("seq"))
    number = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("table"))
    first = F.when(at > 0, F.trim(F.expr("substring(text, 1, instr(text, ':') - 1)"))).otherwise(F.col("text"))
    return cut.select(*PAGE, number.alias("table"), row.alias("row"), first.alias("first"), F.when(at > 0, F.trim(F.expr("substring(text, instr(text, ':') + 1)"))).alias("second"))
