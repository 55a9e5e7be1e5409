"""Sharding by longest-processing-time scheduling.

Documents with equal texts form a group that stays together.  A group larger
than ``1 / fine`` of a shard's fair share is an item of its own: there can be
at most ``n_shards * fine`` of them.  All smaller groups are packed by a hash
of their text into ``n_shards * fine`` bundles, each again an item that stays
together.  So the driver schedules at most ``2 * n_shards * fine`` items
whatever the input size: sorted by size, each goes to the least-loaded shard,
taken from a heap.  The item-to-shard table has the same bound and is
broadcast.  Texts never move; only ids, sizes and digests are shuffled.

Slots are numbered without collecting a shard in one task: each shard is cut
into chunks by a hash of the row, rows are numbered per chunk, and chunk
counts are prefix-summed.

Defined cases: a null text is the empty text (size 16); null ids order last;
repeated rows are rows of their own in the same group; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_order, staged, text_or_empty

OVERHEAD = 16
FINE = 1024
CHUNK_ROWS = 100_000


def lpt(sizes: list[int], n_shards: int) -> list[int]:
    """Shard of each item; ``sizes`` must be sorted from largest to smallest."""
    heap = [(0, s) for s in range(n_shards)]
    out = []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append(shard)
    return out


def assign_shards(docs: DataFrame, n_shards: int = 40, fine: int = FINE) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = text_or_empty()
    rows = staged(docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    cells = n_shards * fine
    # a group above this size is an item of its own: fewer than `cells` exist
    alone = total / cells
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    groups = groups.select(
        F.when(F.col("size") > alone, F.col("digest")).alias("head"),
        F.when(F.col("size") <= alone, F.pmod(F.xxhash64("digest"), F.lit(cells))).alias("bundle"),
        "size", "n")
    items = (groups.groupBy("head", "bundle").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
             .toPandas())
    items["name"] = [bytes(h).hex() if h is not None else f"b{int(b):012d}"
                     for h, b in zip(items["head"], items["bundle"])]
    items = items.sort_values(["size", "name"], ascending=[False, True])
    items["shard"] = lpt([int(s) for s in items["size"]], n_shards)

    per_shard = items.groupby("shard")["n"].sum()
    is_head = items["head"].notna()
    # each shard's slots are numbered in chunks of bounded size
    goal = max(256, min(CHUNK_ROWS, int(items["n"].sum()) // 4096))
    chunks = {int(s): int(-(-n // goal)) for s, n in per_shard.items()}
    heads = spark.createDataFrame(
        [(bytes(h), int(s), chunks[int(s)]) for h, s in zip(items["head"][is_head], items["shard"][is_head])],
        "digest binary, head_shard int, head_chunks int")
    bundles = spark.createDataFrame(
        [(int(b), int(s), chunks[int(s)]) for b, s in zip(items["bundle"][~is_head], items["shard"][~is_head])],
        "bundle long, tail_shard int, tail_chunks int")
    placed = (rows.join(F.broadcast(heads), "digest", "left")
              .withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(cells)))
              .join(F.broadcast(bundles), "bundle", "left")
              .withColumn("shard", F.coalesce("head_shard", "tail_shard"))
              .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "digest"),
                                          F.coalesce("head_chunks", "tail_chunks")).cast("int")))
    within = Window.partitionBy("shard", "chunk").orderBy(*id_order(), "digest")
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
               .drop("n"))
    return (placed.withColumn("rank", F.row_number().over(within))
            .join(offsets, ["shard", "chunk"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("offset") + F.col("rank") - 1).alias("slot")))
