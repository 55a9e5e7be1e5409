"""Mixing sources to target weights by systematic sampling.

Each source has a target of words.  Every document of a source is expected
``target / source_size`` times; the expected copies are prefix-summed over the
source's documents ordered by size, one random offset per source is added,
and a document is emitted once per integer boundary its interval crosses.
Ordering by size keeps the words taken within one document's size of the
target.

A source may hold most rows, so ranks are not computed per source: documents
of one (source, size) are one run, and a run above the chunk size is cut into
ranges of a uniform hash.  Rows are ranked per chunk, chunk counts are
prefix-summed, so no task holds more than a chunk.

Targets: the sources share the total by weight; no target exceeds ``cap``
times its source's size, and the excess is reshared by weight.  This
water-filling has a closed form over the sources sorted by cap / weight.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0 and takes nothing; null
ids are allowed; repeated rows are separate documents; an empty table gives
an empty result; other columns are carried through untouched, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WS, staged, text_or_empty

CAP = 3
SEED = "mix-1"
CHUNK_ROWS = 200_000
HASH_RANGE = 1 << 32


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_or_empty(name), F.lit(NOT_WS)).cast("long")


def _source_key(name: str = "source") -> Column:
    """Orders by code point, the null source last."""
    return F.when(F.col(name).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(name)))


def _hash32(col: Column) -> Column:
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """``sizes``: src, source_size.  Adds target (double).  One row per source."""
    order = Window.orderBy("src")
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
         .withColumn("limit", F.lit(cap).cast("long") * F.col("source_size"))
         .withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0)))
         .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("total", F.sum("source_size").over(everything))
         .withColumn("weights", F.sum("weight").over(everything))
         .withColumn("level", (F.col("total") - F.col("used")).cast("double")
                     / (F.col("weights") - F.col("gone")).cast("double")))
    # the first source in cap / weight order that stays below its cap sets the level
    free = F.col("limit").cast("double") / F.col("weight").cast("double") >= F.col("level")
    level = F.min(F.when(free, F.struct("gone", "level"))).over(everything)["level"]
    return t.withColumn("level", level).select(
        "src", "source_size",
        F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight").cast("double")).alias("target"))


def mix(docs: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Columns ``doc`` (struct of the input row), size, source_size, target, copies."""
    table = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        _source_key().alias("src"), word_count().alias("size"),
        _hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"),
        F.col("doc_id").alias("id"), F.xxhash64(text_or_empty()).alias("tie"))
    runs = staged(table.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-runs")
    n_rows = runs.agg(F.sum("n")).first()[0] or 0
    # run sizes above the chunk: at most n_rows / chunk of them, so broadcast
    chunk = max(256, min(CHUNK_ROWS, n_rows // 1024))
    long_runs = runs.where(F.col("n") > chunk).select(
        "src", "size", F.ceil(F.col("n") / chunk).cast("long").alias("cuts"))
    table = (table.join(F.broadcast(long_runs), ["src", "size"], "left")
             .withColumn("part", F.coalesce(F.floor(F.col("h") * F.col("cuts") / HASH_RANGE), F.lit(0))
                         .cast("int")))
    targets = source_targets(runs.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), cap)
    before = Window.partitionBy("src").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (table.groupBy("src", "size", "part").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
               .select("src", "size", "part", "offset")
               .join(targets, "src"))
    rank = F.row_number().over(Window.partitionBy("src", "size", "part")
                               .orderBy("h", F.col("id").isNull(), "id", "tie"))
    # 16-bit offset: sums with the rank stay exact
    shift = (_hash32(F.concat(F.lit(seed + ":"), F.col("src"))) % 65536) / F.lit(65536.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    position = (F.col("offset") + F.col("rank")).cast("double")
    copies = F.floor(position * rate + shift) - F.floor((position - 1) * rate + shift)
    return (table.withColumn("rank", rank).join(offsets, ["src", "size", "part"])
            .select("doc", "size", "source_size", "target",
                    F.least(copies, F.lit(cap)).cast("long").alias("copies")))


def sample_mix(docs: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as it is taken."""
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mix(docs, cap, seed).select("doc", F.explode(copies)).select("doc.*")
