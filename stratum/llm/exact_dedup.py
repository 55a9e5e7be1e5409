"""Exact dedup with a heavy-hitter split.

1. One pass over the texts writes a narrow digest table (id, SHA-256, row).
2. Misra-Gries summaries, one per task and merged by addition, name every
   digest that may hold more than ``2 n / counters`` of the n rows.
3. The named digests (at most ``counters``) are verified: exact row count and
   exact winner by a map-side combined aggregation.
4. The verified winners, at most ``counters`` rows, are broadcast and resolve
   their rows map-side.  All other digests are ordinary shuffled groups, none
   of which can be hot any more.

Defined cases: a null text is the empty text; null ids order last, and
``keep_id`` of a group whose ids are all null is null; of rows repeated in id
and text exactly one stays; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, staged, text_or_empty

COUNTERS = 1024


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(name), WS, " ")


def mg_merge(counts: dict, more: dict, k: int) -> dict:
    """Merge two Misra-Gries summaries; at most ``k`` counters stay."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        counts = {key: n - cut for key, n in counts.items() if n > cut}
    return counts


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            vc = pc.value_counts(batch.column(0))
            counts = mg_merge(counts, dict(zip(vc.field("values").to_pylist(),
                                               vc.field("counts").to_pylist())), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            ["digest", "n"])
    return run


def frequent_digests(table: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them each above ``2 n / counters`` rows."""
    parts = table.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
    return (parts.groupBy("digest").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "digest").limit(counters).select("digest"))


def resolve_groups(table: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``table``: doc_id, digest, _row (unique), from files.  Adds keep_id, keep_row, group_size, kept."""
    per_group = [F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("win"),
                 F.count(F.lit(1)).alias("group_size")]
    hot = staged(table.join(F.broadcast(frequent_digests(table, counters)), "digest")
                 .groupBy("digest").agg(*per_group), "hot-winners")
    done = table.join(F.broadcast(hot), "digest")
    rest = table.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    rest = rest.join(rest.groupBy("digest").agg(*per_group), "digest")
    return done.unionByName(rest).select(
        "doc_id", "_row", "digest", F.col("win.doc_id").alias("keep_id"), F.col("win._row").alias("keep_row"),
        "group_size",
        (F.col("_row") == F.col("win._row")).alias("kept"))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    table = staged(docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"))
                   .withColumn("_row", F.monotonically_increasing_id()), "digests")
    return resolve_groups(table, counters).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))
