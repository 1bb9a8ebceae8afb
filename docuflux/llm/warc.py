"""WARC Merkle fixity audit: records are laid out in volumes at ordered offsets and digested;
each volume's leaves stand at the places of their record ids, nodes are digests over FAN
children with the length and the number of records of each child's range of offsets, and two
replicas are compared from the roots down, through mismatching nodes only. Ranges are bound by
length and order, not by where they begin, so that a lost record changes its own leaf and those
above it and no other; how far the records behind it have moved is told apart from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

FAN = 16
#: Record ids that share a volume; bounds what one task lays out.
VOLUME = 4096


def records(pages: DataFrame) -> DataFrame:
    """WARC response records of pages: volume, id, bytes (binary).

    pages: page_id (integer), url, html; further columns are ignored. A null url or html is
    empty; a null page_id takes a hash of the page in its place.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    url = F.coalesce("url", F.lit(""))
    id_ = F.coalesce(F.col("page_id").cast("long"), F.xxhash64("url", "html"))
    rows = pages.select(id_.alias("id"), url.alias("url"), html.alias("body"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.col("id").cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length("body").cast("string"), F.lit("\r\n\r\n"),
    )
    tail = F.lit("\r\n\r\n")
    return rows.select(F.floor(F.col("id") / VOLUME).cast("long").alias("volume"), "id", F.concat(F.encode(head, "UTF-8"), F.col("body"), F.encode(tail, "UTF-8")).alias("bytes"))


def leaves(recs: DataFrame) -> DataFrame:
    """volume, seq, id, offset, length, record_sha256, node (digest of the record and its id).

    Records of a volume are ordered by id, then digest, and follow one another from offset 0.
    """
    cut = recs.select("volume", "id", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("record_sha256"))
    order = Window.partitionBy("volume").orderBy("id", "record_sha256")
    placed = cut.select(
        "*", (F.row_number().over(order) - 1).cast("long").alias("seq"),
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).cast("long").alias("offset"),
    )
    node = F.sha2(F.concat_ws(":", "id", "length", "record_sha256"), 256)
    return placed.select("volume", "seq", "id", "offset", "length", "record_sha256", node.alias("node"), F.lit(1).cast("long").alias("n"))


def place_of(id_: Column) -> Column:
    """A record's place in its volume, whatever other records the volume holds."""
    return F.pmod(id_, F.lit(VOLUME)).cast("long")


def over(nodes: DataFrame, place: Column, *order: str) -> DataFrame:
    """(volume, place, node, length, n): digests over the nodes that share a place, in the given order, and
    over the length and the number of records of each one's range, and the whole range's."""
    listed = F.array_sort(F.collect_list(F.struct(*order, "node", "length", "n")))
    bound = F.transform(listed, lambda c: F.concat_ws(":", c["node"], c["length"], c["n"]))
    return nodes.groupBy("volume", place.alias("place")).agg(F.sha2(F.array_join(bound, ","), 256).alias("node"), F.sum("length").alias("length"), F.sum("n").alias("n"))


def tree(leaf: DataFrame, depth: int, ws: Workspace, name: str) -> list[DataFrame]:
    """(volume, place, node, length, n) of levels 0 (places of records) to depth (a root for each volume).
    Each level is written, so that a descent reads it instead of digesting the leaves again."""
    levels = [ws.save(over(leaf, place_of(F.col("id"))), f"{name}0")]  # one record each, or those that share an id
    for i in range(depth):
        levels.append(ws.save(over(levels[-1], F.floor(F.col("place") / FAN).cast("long"), "place"), f"{name}{i + 1}"))  # FAN children at most
    return levels


def depth_of() -> int:
    """Levels above the leaves, so that each volume has one root."""
    depth = 1
    while FAN**depth < VOLUME:
        depth += 1
    return depth


def paired(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Leaves of both replicas aligned by id: the leaf columns, there (the replica's seq, offset,
    length and digest) and status. Equal records meet first; what is left of an id is paired in order."""
    def counted(leaf: DataFrame, *by: str) -> DataFrame:
        return leaf.withColumn("k", F.row_number().over(Window.partitionBy("volume", *by).orderBy("seq")))

    def met(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
        here = counted(a, *by).select("volume", *by, "k", F.struct("seq", "offset", "length", "record_sha256").alias("here"))
        there = counted(b, *by).select("volume", *by, "k", F.struct("seq", "offset", "length", "record_sha256").alias("there"))
        return here.join(there, ["volume", *by, "k"], "full").select("volume", "id", "here", "there")

    same = met(mine, theirs, "id", "record_sha256")
    left = lambda side, other: same.filter(F.col(other).isNull()).select("volume", "id", f"{side}.*")
    rest = met(left("here", "there"), left("there", "here"), "id")
    status = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").otherwise("corrupt")
    both = same.filter(F.col("here").isNotNull() & F.col("there").isNotNull()).withColumn("status", F.lit("ok"))
    return both.unionByName(rest.withColumn("status", status))


def differing(mine: DataFrame, theirs: DataFrame, wrong: DataFrame) -> DataFrame:
    """The ranges to copy again: volume, start, end, n (offsets in the primary's volume and its records
    there), replica_start, replica_end, replica_n. Mismatching places (volume, place) that follow
    each other are one range; a side without records there has no offsets and n 0."""
    along = Window.partitionBy("volume").orderBy("place")
    runs = wrong.withColumn("range", F.col("place") - F.row_number().over(along))

    def side(leaf: DataFrame, mark: str) -> DataFrame:
        held = leaf.withColumn("place", place_of(F.col("id"))).join(runs, ["volume", "place"])
        return held.groupBy("volume", "range").agg(F.min("offset").alias(f"{mark}start"), F.max(F.col("offset") + F.col("length")).alias(f"{mark}end"), F.count("*").alias(f"{mark}n"))

    both = side(mine, "").join(side(theirs, "replica_"), ["volume", "range"], "full").drop("range")
    return both.fillna(0, ["n", "replica_n"])


def audit(primary: DataFrame, replica: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compares two replicas' records (see records()): all leaves of either with their status, the
    volumes' roots (volume, root, replica_root) and the differing ranges (see differing()).

    Returned leaves: volume, seq, id, offset, length, record_sha256 (of the primary; of the replica
    where only that has the record), status: ok, corrupt (another digest under the id), missing
    (not in the replica), extra (only there), and shift: bytes by which the replica's record lies
    behind the primary's (null where one of them has none). A shift alone is no damage. Records
    that repeat count one by one. Empty replicas give all missing or all extra.
    """
    ws = Workspace(primary.sparkSession, "warc")
    a, b = ws.save(leaves(primary), "primary"), ws.save(leaves(replica), "replica")
    depth = depth_of()
    up, other = tree(a, depth, ws, "up"), tree(b, depth, ws, "other")
    roots = ws.save(
        up[depth].select("volume", F.col("node").alias("root")).join(other[depth].select("volume", F.col("node").alias("replica_root")), "volume", "full"), "roots"
    )
    wrong = roots.filter(~F.col("root").eqNullSafe(F.col("replica_root"))).select("volume", F.lit(0).cast("long").alias("place"))
    for level in range(depth - 1, -1, -1):
        under = wrong.select(F.col("volume").alias("v"), F.col("place").alias("p"))

        def within(nodes: DataFrame, name: str, under: DataFrame = under) -> DataFrame:
            hit = nodes.join(under, (nodes.volume == F.col("v")) & (F.floor(nodes.place / FAN) == F.col("p")), "left_semi")
            return hit.select("volume", "place", F.col("node").alias(name))

        wrong = within(up[level], "mine").join(within(other[level], "theirs"), ["volume", "place"], "full")
        wrong = wrong.filter(~F.col("mine").eqNullSafe(F.col("theirs"))).select("volume", "place")
        wrong = ws.save(wrong, f"wrong{level}")
    at = lambda leaf, how: leaf.withColumn("place", place_of(F.col("id"))).join(wrong, ["volume", "place"], how).drop("place", "node", "n")
    found = ws.save(paired(at(a, "left_semi"), at(b, "left_semi")), "found")
    own = F.coalesce("here", "there")
    columns = ["volume", "id", *[own[c].alias(c) for c in ("seq", "offset", "length", "record_sha256")], "status"]
    grown = F.coalesce(F.col("there.length"), F.lit(0)) - F.coalesce(F.col("here.length"), F.lit(0))
    located = found.select(*columns, grown.cast("long").alias("grown"), (F.col("there.offset") - F.col("here.offset")).alias("moved"))
    intact = at(a, "left_anti").select(*located.columns[:6], F.lit("ok").alias("status"), F.lit(0).cast("long").alias("grown"), F.lit(None).cast("long").alias("moved"))
    # between mismatching places all records are equal, so they move by what the ids before them have grown
    before = F.coalesce(F.sum("grown").over(Window.partitionBy("volume").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.when(F.col("status").isin("ok", "corrupt"), F.coalesce("moved", before)).cast("long")
    shown = located.unionByName(intact).withColumn("shift", shift)
    return shown.select("volume", "seq", "id", "offset", "length", "record_sha256", "status", "shift"), roots, differing(a, b, wrong)
