"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together. Groups are taken in
falling order of their bytes and each goes to the shard with the least bytes so
far. Groups of one size are interchangeable, so the driver schedules the
histogram of group sizes (size, count) instead of the groups: the shards' loads
sit in a heap; a class of many equal groups is first filled level by level
(which is what the heap would do) and only the rest is popped one by one. The
schedule is therefore exactly that of the plain algorithm over all groups.

The histogram is the only thing that reaches the driver. With distinct sizes
``s1 < s2 < ...`` the total of bytes is at least their sum, so a corpus of B bytes
has at most sqrt(2 B) classes: 14 million for 100 TB, and far fewer in practice.

Data movement: one shuffle of digests (pre-aggregated, so a text that a third of
the rows share is one row per map task), one to rank groups within their class
(salted when a class is large), one join of digests to groups (both sides are
plain exchanges, so AQE splits a hot digest), and one window for the slots,
dealt by (shard, hash bucket of the id) so that 24 shards do not mean 24 tasks.
Texts themselves are never shuffled.

Cases: null texts are one group of their own, with 0 bytes of text and a null
crc; empty texts are another. Repeated rows each get a slot. An empty table gives
an empty result. Null ids are allowed. Further columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.scratch import materialize

#: Groups of one size above which their ranks are computed in salted parts, and rows of one shard per slot bucket.
RANK_PART = 1_000_000
SLOT_PART = 200_000
#: Largest schedule (in classes) that is broadcast; beyond it the join is a shuffle join.
BROADCAST_CLASSES = 100_000


def schedule(classes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """LPT over (size, count) classes: for each size, how many of its groups go to each shard.

    Ties between loads go to the lower shard number.
    """
    heap = [(0, k) for k in range(shards)]
    out: dict[int, list[tuple[int, int]]] = {}
    for size, count in sorted(classes, reverse=True):
        got = [0] * shards
        if count > 4 * shards:
            # Level filling: below `level` the heap would hand out groups in any case.
            loads = [0] * shards
            for load, k in heap:
                loads[k] = load
            lo, hi = min(loads), max(loads) + size * count
            while lo < hi:  # the highest level that needs at most `count` groups
                mid = (lo + hi + 1) // 2
                if sum(max(0, -(-(mid - load) // size)) for load in loads) <= count:
                    lo = mid
                else:
                    hi = mid - 1
            for k, load in enumerate(loads):
                got[k] = max(0, -(-(lo - load) // size))
            count -= sum(got)
            heap = [(load + got[k] * size, k) for k, load in enumerate(loads)]
            heapq.heapify(heap)
        for _ in range(count):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            got[k] += 1
        out[size] = [(k, n) for k, n in enumerate(got) if n]
    return out


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"null")).alias("digest"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    classes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).toLocalIterator()]
    parts = max((n for _, n in classes), default=0) // RANK_PART + 1
    plan = pd.DataFrame(
        [(size, [k for k, _ in runs], pd.Series([n for _, n in runs], dtype="int64").cumsum().tolist()) for size, runs in schedule(classes, shards).items()],
        columns=["bytes", "shards", "ends"],
    )
    plan = spark.createDataFrame(plan, "bytes long, shards array<int>, ends array<long>")
    if len(classes) <= BROADCAST_CLASSES:
        plan = F.broadcast(plan)

    salted = groups.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("bytes", "part").orderBy("digest")).cast("long") - 1)
    if parts > 1:
        before = Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = salted.groupBy("bytes", "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        ranked = ranked.join(offsets.drop("n"), ["bytes", "part"]).withColumn("rank", F.col("rank") + F.col("offset"))
    placed = ranked.join(plan, "bytes").select(
        "digest",
        F.get(F.col("shards"), F.size(F.filter("ends", lambda end: end <= F.col("rank")))).alias("shard"),
    )

    total = sum(n for _, n in classes)
    buckets = max(8, total // (SLOT_PART * shards) + 1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 4)
    dealt = materialize(
        rows.join(placed, "digest").select("id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(buckets)).alias("bucket")),
        "shard-dealt",
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = dealt.withColumn("slot", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32")))
    return numbered.join(offsets.select("shard", "bucket", "offset"), ["shard", "bucket"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot") - 1 + F.col("offset")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
