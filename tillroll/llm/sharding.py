"""Sharding by longest processing time: groups that stay together go to the least loaded shard.

Documents of equal text are a group; its load is the sum of its documents' sizes (UTF-8
bytes plus one). Groups in order of falling load go, through a heap, to the shard that has
least. The law that holds is ``bytes``: shards of near equal size, up to the largest group.

The heap sees a bounded list. With BUNDLES = 65,536, at most that many groups can have a
load of a BUNDLES-th part of the total or more; each of these is an item of its own. All
smaller groups are gathered by the hash of their text into at most BUNDLES bundles, which
are the other items. So there are at most 131,072 items however many documents there are,
and with fewer than some thousands of groups almost every bundle is one group.

Loads are summed before the shuffle, so a text with a third of all rows costs a row per
task. Slots number the rows of a shard without gaps: rows are dealt into parts by a hash of
the id and the text, the sizes of the parts give each part its first slot, and rows are numbered within.

Cases: a NULL text has size 1 and is equal to the empty text; NULL doc_ids and repeated rows
take slots as any other row; a table without rows gives none; ties go to the lowest shard,
and items of equal load are taken by name; further columns are not looked at.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stored

SHARDS = 8
BUNDLES = 1 << 16
PART_ROWS = 20_000


def schedule(loads: list[tuple], shards: int) -> list[tuple]:
    """(name, shard) of each (load, name), the largest first, each to the least loaded shard."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for load, name in sorted(loads, key=lambda x: (-x[0], x[1])):
        have, shard = heapq.heappop(heap)
        out.append((name, shard))
        heapq.heappush(heap, (have + load, shard))
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row of ``docs``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit(7), text).alias("h2"),
        ),
        "sizes",
    )
    groups = stored(
        rows.groupBy("h1", "h2").agg(F.sum("size").alias("load"), F.count("*").alias("n")), "groups"
    )
    whole, count = groups.agg(F.sum("load"), F.sum("n")).first()
    large = F.col("load") >= F.lit(-(-(whole or 0) // bundles))
    bundle = F.pmod("h1", F.lit(bundles))
    name = F.struct(
        F.when(large, F.col("h1")).otherwise(bundle).alias("a"), F.when(large, F.col("h2")).alias("b")
    )
    # At most 2 * bundles items, by the bound above.
    items = groups.groupBy(name.alias("name")).agg(F.sum("load").alias("load")).collect()
    loads = [(i.load, (i.name.b is not None, i.name.a, i.name.b or 0)) for i in items]
    spark = docs.sparkSession
    placed = spark.createDataFrame(
        [(n[1], n[2] if n[0] else None, s) for n, s in schedule(loads, shards)],
        "a bigint, b bigint, shard int",
    )
    alone = placed.where("b IS NOT NULL").select(F.col("a").alias("h1"), F.col("b").alias("h2"), F.col("shard").alias("own"))
    bundled = placed.where("b IS NULL").select(F.col("a").alias("bundle"), "shard")
    parts = max(1, (count or 0) // PART_ROWS)
    located = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(alone), ["h1", "h2"], "left")
        .join(F.broadcast(bundled), "bundle", "left")
        .withColumn("shard", F.coalesce("own", "shard"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "h1", "h2"), F.lit(parts)))
        .drop("own", "bundle")
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        located.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "h1", "h2")
    return (
        located.withColumn("place", F.row_number().over(within) - 1)
        .join(first, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("place")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
