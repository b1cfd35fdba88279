"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocalith.llm.common import cut, table


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) whose ``-ln(u) / weight`` is least, u a hash of the key and the shard's number.

    A shard's cost for a key depends on that key and shard alone: a further shard takes rows only into itself, and a
    raised weight only draws rows in. A null key counts as the text ``null``.
    """
    k = F.coalesce(key.cast("string"), F.lit("null"))
    cost = [
        F.struct(
            (-F.ln((F.conv(F.substring(F.md5(F.concat(k, F.lit(f"#{i}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)) / float(w)).alias("cost"),
            F.lit(i).alias("shard"),
        )
        for i, w in enumerate(weights)
    ]
    return F.array_min(F.array(*cost))["shard"]


#: Rows of blocks' starts that are broadcast: with many shards each has fewer blocks.
BROADCAST_STARTS = 400_000


def gapless(df: DataFrame, group: str, order: Sequence[str], name: str, blocks: int = 4096) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in (hash block, ``order``) order.

    A group is dealt into ``blocks`` blocks by a hash of ``order``; each block is numbered by itself and shifted by the
    sizes of the blocks before it, so no task holds a group. Rows equal in ``order`` are interchangeable and dealt over
    the blocks by ``_salt``, a column of any numbers that stay with their rows. Blocks' counts are at most groups x ``blocks``
    rows, which bounds what is broadcast. ``df`` should be cheap to read twice.
    """
    df = df.withColumn("_block", F.pmod(F.xxhash64(*order, "_salt"), F.lit(blocks)))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    start = df.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n")).select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order))
    return df.withColumn("_row", row).join(F.broadcast(start), [group, "_block"]).withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_block", "_start", "_row", "_salt")


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard, its slot in the shard, and its shard once one of weight ``grown`` is added.

    Law ``key``: key and shard count decide, so equal texts with other keys may part and repeated rows stay together.
    Null text: no bytes, size 1, CRC 0. Null keys share a shard. Whole texts are measured, however long. An empty table gives
    no rows. Other columns are left out, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_salt"),
    )
    blocks = max(16, min(4096, BROADCAST_STARTS // len(weights)))
    out = gapless(cut(rows, "shard"), "shard", ["doc_id", "text_crc32", "size"], "slot", blocks)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
