"""Sharding by weighted rendezvous hashing: a record goes to the shard of least -ln(u) / weight,
where u in (0, 1) is a hash of its key and the shard. One more shard takes records only into
itself; a shard's share is its part of the weights.

DataFrame functions only. Slots within a shard are gapless: rows are counted by hash block,
the counts' running sums are the blocks' first slots, and rows are numbered within their block,
so no task holds a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import maybe_broadcast

#: Hash blocks of a shard; a block is numbered by one task.
BLOCK_DIGITS = 3


def unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key; shards of weight 0 take none."""
    scores = [F.struct((-F.ln(unit(key, f":{i}")) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*scores))["shard"]


def sharded(docs: DataFrame, weights: list[float], key: str = "doc_id", added_weight: float | None = 1.0) -> DataFrame:
    """docs' key with size, text_crc32, law, shard, slot and grown_shard, a row for each row.

    docs needs `key` and text; further columns are ignored. size: UTF-8 bytes of the text (null:
    none) plus 1. grown_shard: the shard with one more of added_weight (null without one). A null
    key stands for the text's digest, so that null keys spread. Rows that repeat go to one shard
    and take slots of their own. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), name.alias("_name"))
    grown = shard_of(F.col("_name"), [*weights, added_weight]) if added_weight else F.lit(None).cast("int")
    rows = rows.select("*", shard_of(F.col("_name"), weights).alias("shard"), grown.alias("grown_shard"), F.md5("_name").alias("_order"))
    rows = rows.withColumn("_block", F.substring("_order", 1, BLOCK_DIGITS))
    counts = rows.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    if len(weights) * 16**BLOCK_DIGITS <= 1_000_000:  # so many rows at most
        firsts = F.broadcast(firsts)
    else:
        firsts = maybe_broadcast(firsts)
    place = Window.partitionBy("shard", "_block").orderBy("_order", "doc_id", "size", "text_crc32")
    return (
        rows.withColumn("_at", F.row_number().over(place) - 1)
        .join(firsts, ["shard", "_block"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_at")).cast("long").alias("slot"), "grown_shard")
    )
