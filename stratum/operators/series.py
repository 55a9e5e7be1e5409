"""Skew-safe building blocks for per-series ordered computations.

A window ``partitionBy(series)`` sends a whole series to one task; if one
series holds a third of all samples that task holds a third of the data.
These helpers partition by ``(series, bucket)`` instead, where a bucket is a
time slice of the series, and stitch the buckets together with small
per-bucket tables:

* ``assign_buckets`` - coarse time buckets; a bucket holding more than
  ``target_rows`` rows (a burst) is split into finer time slices, so a hot
  bucket is spread too;
* ``lag_across_buckets``  - previous row's values, carrying the last row of
  the previous non-empty bucket into a bucket's first row;
* ``running_sum_across_buckets`` - prefix sums with per-bucket offsets;
* ``range_window_with_halo`` - aggregates over a trailing time range, in one
  shuffle: slices are at least as wide as the range, and the rows near a
  slice's end are copied into the next one.

The per-bucket tables hold one row per (series, bucket): their size grows
with the time span and the number of bursts, not with the number of samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..session import scratch_path

BUCKET = "__bucket"
SUB_BITS = 20                      # a coarse bucket splits into at most 2^20 slices
DEFAULT_TARGET_ROWS = 1 << 20      # rows per bucket before it is split
BROADCAST_TARGET_ROWS = 1 << 18    # a plan has a row per so many samples at most: broadcast


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP or zone-less TIMESTAMP_NTZ."""
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


def drop_bucket(df: DataFrame) -> DataFrame:
    return df.drop(BUCKET, "__bstart", "__bwidth", "__bnext")


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """The samples, computed once and kept in the shared folder: the ordered
    steps read them several times.  A caller that drops them names the ``path``."""
    path = path or scratch_path(df.sparkSession, "samples")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_plan(df: DataFrame, by: Sequence[str], t_us: str, coarse_us: int,
                target_rows: int = DEFAULT_TARGET_ROWS) -> DataFrame:
    """Hot coarse buckets: those above ``target_rows`` rows, to be cut into
    ``2^k`` time slices: (series..., __cb, __k).

    One counting pass (partial aggregation over the series and time columns).
    There are at most rows / target_rows hot buckets; the plan stays a
    DataFrame, which the join broadcasts where that bound is small, and else
    Spark by its measured size.
    """
    by = list(by)
    cb = F.floor(F.col(t_us) / F.lit(coarse_us)).cast("long")
    counts = df.groupBy(*by, cb.alias("__cb")).agg(F.count(F.lit(1)).alias("__n"))
    k = F.least(F.lit(SUB_BITS),
                F.ceil(F.log2(F.col("__n") / F.lit(float(target_rows))))).cast("int")
    return counts.where(F.col("__n") > target_rows).select(*by, "__cb", k.alias("__k"))


def assign_buckets(df: DataFrame, by: Sequence[str], t_us: str, coarse_us: int,
                   target_rows: int = DEFAULT_TARGET_ROWS, plan: DataFrame | None = None,
                   min_width_us: int = 1) -> DataFrame:
    """Add :data:`BUCKET` = ``coarse * 2^20 + slice`` (ordered like time) and
    the slice bounds ``__bstart``/``__bwidth``.

    Buckets listed in ``plan`` (see :func:`bucket_plan`; computed from ``df``
    when not given) are cut into ``2^k`` equal time slices, never narrower
    than ``min_width_us`` (``coarse_us`` must be at least that), so a burst
    that holds a third of all rows is spread over many tasks too.
    """
    if coarse_us < min_width_us:
        raise ValueError(f"coarse buckets of {coarse_us} us are narrower than {min_width_us} us")
    by = list(by)
    if plan is None:
        plan = bucket_plan(df, by, t_us, coarse_us, target_rows)
    cb = F.floor(F.col(t_us) / F.lit(coarse_us)).cast("long")
    if target_rows >= BROADCAST_TARGET_ROWS:
        plan = F.broadcast(plan)     # else the join deals all samples before the plan's size is known
    d = df.withColumn("__cb", cb).join(plan, [*by, "__cb"], "left")
    width = F.expr(f"greatest({max(1, int(min_width_us))}, "
                   f"shiftright(CAST({int(coarse_us)} AS BIGINT), coalesce(__k, 0)))")
    d = d.withColumn("__bwidth", width)
    # the last slice of a coarse bucket takes what is left over, so none is narrower than asked
    last = F.least(F.greatest(F.floor(F.lit(int(coarse_us)) / F.col("__bwidth")).cast("long"), F.lit(1)),
                   F.lit(1 << SUB_BITS)) - 1
    sub = F.floor((F.col(t_us) - F.col("__cb") * F.lit(coarse_us)) / F.col("__bwidth")).cast("long")
    d = d.withColumn("__last", last).withColumn("__sub", F.least(sub, F.col("__last")))
    ends = F.col("__sub") == F.col("__last")
    return (d.withColumn(BUCKET, F.col("__cb") * F.lit(1 << SUB_BITS) + F.col("__sub"))
             .withColumn("__bstart", F.col("__cb") * F.lit(coarse_us) + F.col("__sub") * F.col("__bwidth"))
             .withColumn("__bnext", F.when(ends, (F.col("__cb") + 1) * F.lit(1 << SUB_BITS))
                                     .otherwise(F.col(BUCKET) + 1))
             .withColumn("__bwidth", F.when(ends, F.lit(int(coarse_us)) - F.col("__sub") * F.col("__bwidth"))
                                      .otherwise(F.col("__bwidth")))
             .drop("__cb", "__k", "__last", "__sub"))


class RangeFrames(NamedTuple):
    """Frames around a trailing range ``[t - range, t]``.  Each only grows from row to
    row, so an aggregate over it costs a time linear in the rows, whatever the range."""
    upto: WindowSpec    #: everything up to t
    before: WindowSpec  #: everything before the range; upto - before is the range
    since: WindowSpec   #: everything from the range's start on: its minimum in time is the range's first row


def range_window_with_halo(df: DataFrame, by: Sequence[str], t_us: str, range_us: int,
                           aggregates: dict[str, Callable[[RangeFrames], Column]],
                           sums: dict[str, str] | None = None) -> DataFrame:
    """Trailing-range aggregates ``{out: fn(frames)}`` over ``[t - range, t]`` in one
    shuffle.  ``df`` carries buckets from :func:`assign_buckets` with slices at least
    ``range_us`` wide: a row within ``range_us`` of its slice's end is also copied, as
    a non-output halo row, into the next slice - the only one that can need it.

    ``sums`` (``{out: column}``) are range sums without a subtraction, for values that
    cannot be taken back (DOUBLE: rounding, infinities).  Time is cut into blocks as
    long as the range, so a range is the end of one block and the start of the next:
    a suffix sum of the first plus a prefix sum of the second.  Both are running sums
    inside a block, so the cost stays linear, and only values of the range enter.
    Blocks lie on the time axis, not on slices, so slicing cannot show in the rounding."""
    by, sums = list(by), sums or {}
    near_end = F.col(t_us) >= F.col("__bstart") + F.col("__bwidth") - F.lit(range_us)
    own = F.array(F.struct(F.col(BUCKET).alias("hb"), F.lit(False).alias("halo")))
    both = F.array(F.struct(F.col(BUCKET).alias("hb"), F.lit(False).alias("halo")),
                   F.struct(F.col("__bnext").alias("hb"), F.lit(True).alias("halo")))
    u = df.withColumn("__h", F.explode(F.when(near_end, both).otherwise(own)))
    u = u.withColumns({"__hb": F.col("__h.hb"), "__halo": F.col("__h.halo")}).drop("__h")
    slices = Window.partitionBy(*by, "__hb")
    up, down = slices.orderBy(F.col(t_us)), slices.orderBy(F.col(t_us).desc())
    frames = RangeFrames(up.rangeBetween(Window.unboundedPreceding, 0),
                         up.rangeBetween(Window.unboundedPreceding, -range_us - 1),
                         down.rangeBetween(Window.unboundedPreceding, range_us))
    if sums:
        # dealt by slice here, as blocks (finer) would be dealt once more for the slices
        u = u.repartition(*by, "__hb").withColumn("__block", F.floor(F.col(t_us) / F.lit(range_us + 1)).cast("long"))
        blocks = Window.partitionBy(*by, "__hb", "__block")
        prefix = blocks.orderBy(F.col(t_us)).rangeBetween(Window.unboundedPreceding, 0)
        suffix = blocks.orderBy(F.col(t_us).desc()).rangeBetween(Window.unboundedPreceding, 0)
        u = u.withColumns({f"__prefix_{o}": F.sum(c).over(prefix) for o, c in sums.items()})
        u = u.withColumns({f"__suffix_{o}": F.sum(c).over(suffix) for o, c in sums.items()})
        start = F.struct("__block", *[F.col(f"__suffix_{o}") for o in sums])
        u = u.withColumn("__start", F.min_by(start, t_us).over(frames.since))
    u = u.withColumns({o: fn(frames) for o, fn in aggregates.items()})
    for o in sums:
        older = F.when(F.col("__start.__block") < F.col("__block"), F.col(f"__start.__suffix_{o}"))
        newer = F.col(f"__prefix_{o}")
        u = u.withColumn(o, F.coalesce(older + newer, older, newer))
    return (u.where(~F.col("__halo"))
             .drop("__hb", "__halo", "__block", "__start",
                   *[f"__{side}_{o}" for side in ("prefix", "suffix") for o in sums]))


def lag_across_buckets(df: DataFrame, by: Sequence[str], order: Sequence[str],
                       cols: Sequence[str], prefix: str = "prev_",
                       bucket: str = BUCKET) -> DataFrame:
    """Add ``prev_<c>`` = value of ``c`` on the previous row of the same series.

    ``df`` must carry ``bucket`` (ordered like ``order``); ``order`` must be a
    total order.
    """
    by, order, cols = list(by), list(order), list(cols)
    keys = by + [bucket]
    w = Window.partitionBy(*keys).orderBy(*order)
    local = df.withColumns({
        **{f"__lag_{c}": F.lag(c).over(w) for c in cols},
        "__first": F.row_number().over(w) == 1,
    })
    last = (df.groupBy(*keys)
              .agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in cols]),
                            F.struct(*order)).alias("__last")))
    wb = Window.partitionBy(*by).orderBy(bucket)
    carry = last.select(*keys, F.lag("__last").over(wb).alias("__carry"))
    j = local.join(carry, keys, "left")
    return j.withColumns({
        f"{prefix}{c}": F.when(F.col("__first"), F.col(f"__carry.{c}"))
                         .otherwise(F.col(f"__lag_{c}"))
        for c in cols
    }).drop("__carry", "__first", *[f"__lag_{c}" for c in cols])


def running_sums_across_buckets(df: DataFrame, by: Sequence[str], order: Sequence[str],
                                sums: dict[str, str], bucket: str = BUCKET) -> DataFrame:
    """Add running sums ``{out: col}`` over the series in ``order`` (one
    window, one per-bucket aggregation and one join for all of them)."""
    by, order = list(by), list(order)
    keys = by + [bucket]
    w = (Window.partitionBy(*keys).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = df.withColumns({f"__local_{o}": F.sum(c).over(w) for o, c in sums.items()})
    tot = df.groupBy(*keys).agg(*[F.sum(c).alias(f"__tot_{o}") for o, c in sums.items()])
    wb = (Window.partitionBy(*by).orderBy(bucket)
          .rowsBetween(Window.unboundedPreceding, -1))
    off = tot.select(*keys, *[F.coalesce(F.sum(f"__tot_{o}").over(wb), F.lit(0))
                              .alias(f"__off_{o}") for o in sums])
    j = local.join(off, keys, "left")
    return (j.withColumns({o: F.col(f"__local_{o}") + F.col(f"__off_{o}") for o in sums})
             .drop(*[f"__local_{o}" for o in sums], *[f"__off_{o}" for o in sums]))


def running_sum_across_buckets(df: DataFrame, by: Sequence[str], order: Sequence[str],
                               col: str, out: str, bucket: str = BUCKET) -> DataFrame:
    """Add ``out`` = running sum of ``col`` over the series in ``order``."""
    return running_sums_across_buckets(df, by, order, {out: col}, bucket)
