"""Structure trees given as (node, parent, place) rows: reading order by pointer doubling, and roles.

A walk around a tree enters and leaves every node once; what comes after each such step is known
from the node's children and siblings alone. Doubling joins each step with the one it points to,
so that after k rounds it knows what lies up to 2^k steps ahead: rounds grow with the logarithm of
the largest tree, whatever its depth, and no tree is gathered in one place. Nodes without children,
most of a tree, take no steps: those of the nodes before them count them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docuflux.session import shared_folder

# Standard types by role, and roles that stand for others.
ROLES = {"H1": "heading", "H2": "heading", "H3": "heading", "H4": "heading", "H5": "heading", "H6": "heading", "P": "paragraph", "L": "list", "LI": "list item", "TABLE": "table", "TR": "row", "TD": "cell", "TH": "cell", "LINK": "link", "SECT": "section", "DOCUMENT": "document"}
MAPPED = {"HTML": "DOCUMENT", "ARTICLE": "SECT", "SECTION": "SECT", "MAIN": "SECT", "NAV": "TOC", "TOC": "L", "UL": "L", "OL": "L", "A": "LINK", "TITLE": "H1"}
# End of fixed values.


def written(rows: DataFrame, folder: str, step: int | str) -> DataFrame:
    rows.write.parquet(f"{folder}/{step}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{step}")


def preorder(nodes: DataFrame, key: str) -> DataFrame:
    """nodes with `order` (from 0 in reading order), `depth` (from 1) and `size` (nodes of the subtree).

    nodes: key, node (distinct within key), parent, place (order of siblings; ties by node), further
    columns. Nodes whose parent is null or not there are roots, in order of place. Nodes in a cycle
    and below one are under no root and left out.
    """
    ids = nodes.select(key, F.col("node").alias("_id"))
    links = nodes.select(key, "node", "parent", "place").join(ids.withColumnRenamed("_id", "parent").withColumn("_there", F.lit(True)), [key, "parent"], "left")
    links = links.select(key, "node", F.when(F.col("_there"), F.col("parent")).alias("parent"), "place")
    folder = shared_folder(nodes.sparkSession, "trees")
    # nodes without children are passed on the way: only the others take steps, which count the leaves that follow
    parents = links.filter("parent is not null").select(key, F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    links = written(links.join(parents, [key, "node"], "left"), folder, "links")
    siblings, inner = Window.partitionBy(key, "parent").orderBy("place", "node"), F.col("inner").isNotNull()
    numbered = links.withColumn("number", F.row_number().over(siblings))
    of = F.when(inner, F.struct("number", "node"))
    behind = F.last(of, ignorenulls=True).over(siblings.rowsBetween(Window.unboundedPreceding, -1))
    leaves = numbered.withColumn("behind", behind).filter(~inner).select(
        key, "node", F.coalesce("behind.node", "parent").alias("_from"), F.col("behind").isNotNull().alias("_out"), (F.col("number") - F.coalesce("behind.number", F.lit(0))).cast("long").alias("_nth")
    )
    # the next inner sibling, and the leaves up to it or to the last
    ahead = numbered.withColumn("last", F.count("*").over(Window.partitionBy(key, "parent"))).filter(inner).withColumn("fellow", F.lead(F.struct("number", "node")).over(siblings))
    ahead = ahead.select(key, "node", "parent", F.col("fellow.node").alias("sibling"), (F.coalesce(F.col("fellow.number") - 1, F.col("last")) - F.col("number")).cast("long").alias("passed"))
    child = numbered.filter("parent is not null").groupBy(key, F.col("parent").alias("_up")).agg(F.min(of).alias("first"), F.count("*").alias("n"))
    child = child.select(key, F.col("_up").alias("node"), F.col("first.node").alias("child"), F.coalesce(F.col("first.number") - 1, F.col("n")).cast("long").alias("led"))
    both = ahead.join(child, [key, "node"])
    point = lambda node, out: F.struct(node.alias("node"), out.alias("out"))
    own, off = F.lit(False), F.lit(True)
    enter = point(F.coalesce("child", "node"), F.col("child").isNull())
    leave = F.when(F.col("sibling").isNotNull(), point(F.col("sibling"), own)).when(F.col("parent").isNotNull(), point(F.col("parent"), off))
    # entering counts a node and goes a level down, leaving goes up; counts are of what lies from a step to the end
    steps = both.select(key, F.explode(F.array(
        F.struct(point(F.col("node"), own).alias("at"), enter.alias("next"), (F.col("led") + 1).alias("entered"), F.lit(1).cast("long").alias("down")),
        F.struct(point(F.col("node"), off).alias("at"), leave.alias("next"), F.col("passed").alias("entered"), F.lit(-1).cast("long").alias("down")),
    )).alias("s")).select(key, "s.*")
    step, before = 0, -1
    steps = written(steps, folder, 0)
    while (left := steps.filter("next is not null").count()) not in (0, before):
        before, step = left, step + 1
        far = steps.select(key, F.col("at").alias("next"), F.col("next").alias("_next"), F.col("entered").alias("_entered"), F.col("down").alias("_down"))
        more = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        steps = written(steps.join(far, [key, "next"], "left").select(key, "at", F.col("_next").alias("next"), more("entered"), more("down")), folder, step)
    ended = steps.filter("next is null").select(key, "at.node", "at.out", "entered", "down")
    came, went = (ended.filter(F.col("out") == x).drop("out") for x in (False, True))
    sizes = came.join(went.select(key, "node", F.col("entered").alias("_later")), [key, "node"])
    total = came.groupBy(key).agg(F.max("entered").alias("_total"))
    # leaves that come before any step are counted by none
    lead = leaves.filter("_from is null").groupBy(key).agg(F.count("*").alias("_lead"))
    total = total.join(lead, key, "left").select(key, (F.col("_total") + F.coalesce("_lead", F.lit(0))).alias("_total"))
    known = sizes.join(total, key).select(key, "node", (F.col("_total") - F.col("entered")).alias("order"), (1 - F.col("down")).alias("depth"), (F.col("entered") - F.col("_later")).alias("size"))
    one, out = F.lit(1).cast("long"), F.col("_out")
    met = leaves.join(ended.select(key, F.col("node").alias("_from"), F.col("out").alias("_out"), "entered", "down"), [key, "_from", "_out"]).join(total, key)
    met = met.select(key, "node", (F.col("_total") - F.col("entered") + F.col("_nth") - out.cast("long")).alias("order"), (F.when(out, 0).otherwise(2) - F.col("down")).alias("depth"), one.alias("size"))
    first = leaves.filter("_from is null").select(key, "node", (F.col("_nth") - 1).alias("order"), one.alias("depth"), one.alias("size"))
    known = known.unionByName(met).unionByName(first)
    return nodes.join(known, [key, "node"])


def standard(role: Column, mapped: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(type, heading level) of a role, through the roles that stand for it; unknown ones are "other"."""
    mapped = MAPPED if mapped is None else mapped

    def end(name: str) -> str:
        seen = set()
        while name in mapped and name not in ROLES and name not in seen:
            seen.add(name)
            name = mapped[name]
        return name

    names = {name: end(name) for name in {*ROLES, *mapped}}
    upper = F.upper(role)
    last = F.create_map(*[x for k, v in sorted(names.items()) for x in (F.lit(k), F.lit(v))])[upper]
    kind = F.create_map(*[x for k, v in sorted(ROLES.items()) for x in (F.lit(k), F.lit(v))])[last]
    return F.coalesce(kind, F.lit("other")), F.when(last.rlike("^H[1-6]$"), F.substring(last, 2, 1).cast("int"))


#: Tags that hold others, and tags whose text ends at the next one.
HOLDING, PLAIN = "html|head|body|nav|ul|ol|li|article|section|div|main|header|footer|table|tr|td|th", "h[1-6]|p|a|title"
TOKEN = rf"<(/?)({HOLDING}|{PLAIN})(?:\s[^>]*)?>([^<]*)"


def tagged(pages: DataFrame) -> DataFrame:
    """The tags of pages as tree rows: page_id, node, parent, place, role, text. A node's id is made of the
    page's and its place in the text, so that it says nothing about the order."""
    tokens = F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))
    part = lambda i: F.regexp_extract("token", TOKEN, i)
    rows = pages.select("page_id", F.posexplode(tokens).alias("pos", "token")).select("page_id", "pos", (part(1) == "/").alias("closing"), part(2).alias("role"), F.trim(part(3)).alias("text"))
    holding = F.rlike("role", F.lit(f"^(?:{HOLDING})$"))
    rows = rows.withColumn("holding", holding).filter("holding or not closing")
    delta = F.when(~F.col("holding"), 0).when(F.col("closing"), -1).otherwise(1)
    before = F.coalesce(F.sum(delta).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = rows.withColumn("level", before + 1).filter("not closing")
    # what a level holds is below the last tag opened on the level above
    roles = F.array(F.struct((F.col("level") - 1).alias("key"), F.lit(False).alias("holds")), F.struct(F.col("level").alias("key"), F.lit(True).alias("holds")))
    met = opened.select("*", F.explode(roles).alias("r")).select("page_id", "pos", "role", "text", "holding", "r.*").filter("holding or not holds")
    w = Window.partitionBy("page_id", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    below = met.withColumn("up", F.last(F.when(F.col("holds"), F.col("pos")), ignorenulls=True).over(w)).filter("not holds")
    node = lambda pos: F.conv(F.substring(F.md5(F.concat_ws(":", "page_id", pos)), 1, 12), 16, 10).cast("long")
    place = F.row_number().over(Window.partitionBy("page_id", "up").orderBy("pos"))
    return below.select("page_id", node("pos").alias("node"), F.when(F.col("up").isNotNull(), node("up")).alias("parent"), place.alias("place"), "role", "text")
