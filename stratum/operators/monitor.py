"""Metric-series operators: rates, held conditions, evaluation grid, panels.

Samples are rows ``(ts, <series columns>, value)``.  Ordered per-series work
uses the bucketed helpers of :mod:`stratum.operators.series`, so one busy
series is spread over many tasks.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .series import (DEFAULT_TARGET_ROWS, assign_buckets, bucket_plan, drop_bucket,
                     epoch_micros, lag_across_buckets, range_window_with_halo,
                     running_sum_across_buckets, staged)

US = 1_000_000


def _bucket_us(range_s: float, bucket_s: float | None) -> int:
    return int((bucket_s or max(range_s * 8, 3600)) * US)


def counter_deltas(samples: DataFrame, by: Sequence[str], ts: str = "ts",
                   value: str = "value", tiebreak: Sequence[str] = (),
                   bucket_s: float | None = None,
                   target_rows: int = DEFAULT_TARGET_ROWS, plan: DataFrame | None = None
                   ) -> DataFrame:
    """Per-sample counter increase: ``v - prev``; a drop means a reset, so
    the increase is ``v`` itself.  The first sample of a series has 0."""
    df = samples if "__t" in samples.columns else samples.withColumn("__t", epoch_micros(samples, ts))
    df = assign_buckets(df, by, "__t", _bucket_us(0, bucket_s), target_rows, plan)
    df = lag_across_buckets(df, by, ["__t", *tiebreak], [value], prefix="__prev_")
    prev = F.col(f"__prev_{value}")
    # stays in the value's type: DECIMAL counters give exact increases
    delta = (F.when(prev.isNull(), F.lit(0))
              .when(F.col(value) < prev, F.col(value))
              .otherwise(F.col(value) - prev))
    return drop_bucket(df.withColumn("delta", delta).drop(f"__prev_{value}"))


def counter_rate(samples: DataFrame, by: Sequence[str], window_s: float, ts: str = "ts",
                 value: str = "value", tiebreak: Sequence[str] = (),
                 bucket_s: float | None = None, extrapolate: bool = False,
                 target_rows: int = DEFAULT_TARGET_ROWS) -> DataFrame:
    """Per-second rate evaluated at each sample over the trailing window.

    Default: reset-aware increase over ``[t - window, t]`` (including the step
    from the sample before the window) divided by the window length.

    ``extrapolate=True`` follows the metrics-server rule: only samples inside
    the window count (at least two), the increase between the first and the
    last of them is extrapolated towards the window start when the gap is
    below 1.1 x the average sample spacing (else by half a spacing), and never
    below the point where a counter would have been zero.

    One algorithm at every size: the samples are staged once, deltas come from
    a bucketed lag, and range sums from one window per (series, slice), a slice
    being at least a window wide, with halo rows from the slice before.
    Integer and DECIMAL increases are differences of two growing frames (exact,
    so slicing cannot show); DOUBLE ones are a block's suffix sum plus the next
    block's prefix sum, so a value outside the range (an infinity, say) has no
    effect.  Either way the time is linear in the samples, whatever the window.
    """
    by = list(by)
    w_us = int(window_s * US)
    coarse = max(_bucket_us(window_s, bucket_s), w_us)
    samples = staged(samples.withColumn("__t", epoch_micros(samples, ts)))
    # one counting pass plans the bucket splits of both ordered stages
    plan = staged(bucket_plan(samples, by, "__t", coarse, target_rows))
    d = counter_deltas(samples, by, ts, value, tiebreak, coarse / US, target_rows, plan)
    exact = not isinstance(d.schema["delta"].dataType, (DoubleType, FloatType))

    aggs = {"__rsum": lambda f: F.sum("delta").over(f.upto) - F.coalesce(F.sum("delta").over(f.before), F.lit(0))} if exact else {}
    if extrapolate:
        aggs |= {"__rcount": lambda f: F.count(F.lit(1)).over(f.upto) - F.count(F.lit(1)).over(f.before),
                 "__rf": lambda f: F.min_by(
                     F.struct(F.col("__t").alias("t"), F.col("delta").alias("delta"),
                              F.col(value).alias("v")),
                     F.struct("__t", *tiebreak)).over(f.since)}
    b = assign_buckets(d, by, "__t", coarse, target_rows, plan, min_width_us=w_us)
    r = drop_bucket(range_window_with_halo(b, by, "__t", w_us, aggs, {} if exact else {"__rsum": "delta"}))
    if extrapolate:
        r = r.withColumns({"__rfirst_t": F.col("__rf.t"), "__rfirst_delta": F.col("__rf.delta"),
                           f"__rfirst_{value}": F.col("__rf.v")}).drop("__rf")
    if not extrapolate:
        return (r.withColumn("increase", F.col("__rsum"))
                 .withColumn("rate", F.col("increase").cast("double") / F.lit(float(window_s)))
                 .drop("__rsum", "__t"))
    n = F.col("__rcount")
    inc = (F.col("__rsum") - F.col("__rfirst_delta")).cast("double")  # between in-window samples
    sampled = (F.col("__t") - F.col("__rfirst_t")).cast("double") / F.lit(float(US))
    avg = sampled / (n - 1).cast("double")
    to_start = (F.col("__rfirst_t") - (F.col("__t") - F.lit(w_us))).cast("double") / F.lit(float(US))
    v_first = F.col(f"__rfirst_{value}")
    to_zero = sampled * (v_first.cast("double") / inc)
    to_start = F.when((inc > 0) & (v_first >= 0) & (to_zero < to_start), to_zero) \
                .otherwise(to_start)
    thr = avg * F.lit(1.1)
    ext = sampled + F.when(to_start < thr, to_start).otherwise(avg / F.lit(2.0))
    increase = F.when((n >= 2) & (sampled > 0), inc * (ext / sampled))
    return (r.withColumn("increase", increase)
             .withColumn("rate", F.col("increase") / F.lit(float(window_s)))
             .drop("__rsum", "__rcount", "__rfirst_t", "__rfirst_delta", f"__rfirst_{value}",
                   "__t"))


def alert_intervals(samples: DataFrame, by: Sequence[str], condition: Column, hold_s: float,
                    ts: str = "ts", tiebreak: Sequence[str] = (),
                    bucket_s: float | None = None,
                    target_rows: int = DEFAULT_TARGET_ROWS,
                    max_gap_s: float | None = None) -> DataFrame:
    """Spans where ``condition`` held on consecutive samples for ``hold_s``.

    Islands of consecutive true samples (gaps-and-islands); an island lasts
    from its first to its last true sample (an island still open at the end
    of the data counts up to its last sample).  Returns one row per island
    with ``duration_s >= hold_s`` and the firing time ``start + hold``.
    With ``max_gap_s`` a silence longer than that between consecutive
    samples also ends an island (the series went stale), matching the
    streaming alert's ``idle_timeout_s``.
    """
    by = list(by)
    order = ["__t", *tiebreak]
    # staged once, with the columns that the steps need
    df = staged(samples.withColumn("__t", epoch_micros(samples, ts))
                .withColumn("__on", F.coalesce(condition, F.lit(False)))
                .select(*dict.fromkeys([*by, ts, *order, "__on"])))
    coarse = _bucket_us(hold_s, bucket_s)
    df = assign_buckets(df, by, "__t", coarse, target_rows,
                        bucket_plan(df, by, "__t", coarse, target_rows))
    # staged again: the lag reads its input twice, and so does the running sum
    df = staged(lag_across_buckets(df, by, order, ["__on", "__t"], prefix="__prev"))
    brk = F.col("__prev__on").isNull() | (F.col("__prev__on") != F.col("__on"))
    if max_gap_s is not None:
        brk = brk | (F.col("__t") - F.col("__prev__t") > F.lit(int(max_gap_s * US)))
    change = brk.cast("long")
    df = drop_bucket(running_sum_across_buckets(df.withColumn("__chg", change), by, order,
                                                "__chg", "__island"))
    islands = (df.where("__on")
                 .groupBy(*by, "__island")
                 .agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"),
                      F.min("__t").alias("__t0"), F.max("__t").alias("__t1"),
                      F.count(F.lit(1)).alias("n_samples")))
    dur = (F.col("__t1") - F.col("__t0")) / F.lit(float(US))
    return (islands.withColumn("duration_s", dur)
                   .where(F.col("duration_s") >= F.lit(float(hold_s)))
                   .withColumn("fired_at", F.col("start_ts") +
                               F.make_dt_interval(secs=F.lit(float(hold_s)).cast("decimal(18,6)")))
                   .drop("__island", "__t0", "__t1"))


def resample(samples: DataFrame, by: Sequence[str], step_s: int = 15, lookback_s: int = 300,
             ts: str = "ts", value: str = "value", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Evaluation grid: at every ``step`` boundary ``g`` the latest sample with
    ``g - lookback < ts <= g``.

    Only the last sample of a series in each step can serve a grid point, so
    samples are reduced to one per (series, step) first, with map-side combine.
    Each of those serves the points up to the next one's step, or to the end
    of its lookback: every grid point is made once.  The next step is looked
    up per (series, run of steps), where a run also sees the first steps of
    the next one, so a series is never in one task.
    """
    by = list(by)
    t = epoch_micros(samples, ts)
    step_us, look_us = step_s * US, lookback_s * US
    reach = look_us // step_us + 1                              # steps a sample can serve
    run = max(4096, 4 * reach)
    order = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    cells = (samples.withColumns({"__t": t, "__g": F.ceil(t / F.lit(step_us)).cast("long")})
             .groupBy(*by, "__g")
             .agg(F.max_by(F.struct(F.col(value).alias("value"), F.col(ts).alias("sample_ts"), F.col("__t").alias("t")),
                           order).alias("__s")))
    own = F.floor(F.col("__g") / F.lit(run))
    copies = F.array(F.struct(own.alias("run"), F.lit(False).alias("halo")),
                     F.struct((own - 1).alias("run"), F.lit(True).alias("halo")))
    cells = cells.withColumn("__h", F.explode(F.when(F.pmod(F.col("__g"), F.lit(run)) <= reach, copies)
                                              .otherwise(F.slice(copies, 1, 1))))
    following = F.lead("__g").over(Window.partitionBy(*by, "__h.run").orderBy("__g"))
    last = F.floor((F.col("__s.t") + F.lit(look_us) - F.lit(1)) / F.lit(step_us)).cast("long")
    grid = (cells.withColumn("__next", following).where(~F.col("__h.halo"))
            .withColumn("__last", F.least(last, F.coalesce(F.col("__next") - 1, last)))
            .where(F.col("__g") <= F.col("__last"))
            .withColumn("__p", F.explode(F.sequence("__g", "__last"))))
    g_ts = F.expr("timestampadd(MICROSECOND, __p * %d, TIMESTAMP_NTZ'1970-01-01 00:00:00')"
                  % step_us)
    return grid.select(*by, g_ts.alias("eval_ts"), "__s.value", "__s.sample_ts")


def last_not_null(df: DataFrame, by: Sequence[str], ts: str = "ts", value: str = "value",
                  tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest non-NULL value per series (a panel's ``lastNotNull`` reduction)."""
    order = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    return (df.where(F.col(value).isNotNull()).groupBy(*by)
              .agg(F.max_by(F.col(value), order).alias("last_value"),
                   F.max(ts).alias("last_ts")))


def threshold_step(c, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Map a value to the colour of the highest step it reaches.

    ``steps`` is ``[(None, base), (t1, colour1), ...]`` ascending; NULL values
    get the base colour.
    """
    col = F.col(c) if isinstance(c, str) else c
    base = steps[0][1]
    expr = None
    for limit, colour in sorted(steps[1:], key=lambda s: s[0], reverse=True):
        cond = col >= F.lit(limit)
        expr = F.when(cond, colour) if expr is None else expr.when(cond, colour)
    return F.lit(base) if expr is None else expr.otherwise(F.lit(base))


def match_labels(df: DataFrame, matchers: dict[str, tuple[str, str]],
                 labels: str = "labels") -> DataFrame:
    """Label matchers ``{name: (op, value)}`` with op ``=``, ``!=``, ``=~``, ``!~``.
    A missing label matches as the empty string."""
    cond = F.lit(True)
    for name, (op, v) in matchers.items():
        lv = F.coalesce(F.element_at(F.col(labels), F.lit(name)), F.lit(""))
        if op == "=":
            c = lv == F.lit(v)
        elif op == "!=":
            c = lv != F.lit(v)
        elif op == "=~":
            c = lv.rlike(f"^(?:{v})$")
        elif op == "!~":
            c = ~lv.rlike(f"^(?:{v})$")
        else:
            raise ValueError(f"unknown matcher {op!r}")
        cond = cond & c
    return df.where(cond)


def time_range(df: DataFrame, ts: str, last_s: float, now: _dt.datetime | None = None) -> DataFrame:
    """Rows in ``[now - last, now]``; ``now`` injectable for reproducible runs."""
    ts_type = df.schema[ts].dataType
    now_c = (F.lit(now.isoformat(sep=" ")) if now is not None
             else F.current_timestamp()).cast(ts_type)
    lo = now_c - F.make_dt_interval(secs=F.lit(float(last_s)).cast("decimal(18,6)"))
    return df.where((F.col(ts) >= lo) & (F.col(ts) <= now_c))


def replication_lag(df: DataFrame, by: Sequence[str], synced: str = "_synced_at",
                    now: _dt.datetime | None = None) -> DataFrame:
    """Freshness per table/stream: ``now - max(synced)`` in seconds."""
    now_c = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz") if now is not None else \
        F.current_timestamp().cast("timestamp_ntz")
    agg = df.groupBy(*by).agg(F.max(synced).alias("last_synced_at"))
    lag = F.expr("timestampdiff(MICROSECOND, last_synced_at, __now)") / F.lit(float(US))
    return (agg.withColumn("__now", now_c)
               .withColumn("lag_seconds", lag).drop("__now"))


def rate_limit_violations(events: DataFrame, key: Sequence[str], limit: int = 200,
                          window: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Fixed (tumbling) windows in which a key made more than ``limit`` requests."""
    w = F.window(ts, window)
    agg = (events.groupBy(*key, w.alias("w")).agg(F.count(F.lit(1)).alias("requests")))
    return (agg.where(F.col("requests") > limit)
               .select(*key, F.col("w.start").alias("window_start"),
                       F.col("w.end").alias("window_end"), "requests"))


def lag_series(df: DataFrame, by: Sequence[str], synced: str = "_synced_at",
               window: str = "1 minute") -> DataFrame:
    """Freshness as a series: per tumbling window, the newest sync time and
    ``window_end - newest`` in seconds (works on streams with a watermark)."""
    w = F.window(synced, window)
    agg = df.groupBy(*by, w.alias("w")).agg(F.max(synced).alias("last_synced_at"),
                                            F.count(F.lit(1)).alias("rows"))
    lag = (F.unix_micros(F.col("w.end").cast("timestamp")) -
           F.unix_micros(F.col("last_synced_at").cast("timestamp"))) / F.lit(float(US))
    return agg.select(*by, F.col("w.start").alias("window_start"),
                      F.col("w.end").alias("window_end"), "last_synced_at", "rows",
                      lag.alias("lag_seconds"))


def complete_lag_series(series: DataFrame, by: Sequence[str], window_s: float,
                        until: _dt.datetime | None = None) -> DataFrame:
    """The lag series with the windows in which nothing was synced.

    Every series gets all windows from its first one to ``until`` (the last
    window of any series by default); a silent window has 0 rows and its lag
    counts from the last sync known, so a stalled table shows a growing lag.
    The input has one row per series and window, whatever the data behind it.
    """
    by = list(by)
    kind = series.schema["window_start"].dataType.simpleString()
    series = staged(series)
    end = until or series.agg(F.max("window_start")).first()[0]
    if end is None:
        return series
    step = F.expr(f"INTERVAL '{window_s}' SECOND")
    following = F.lead("window_start").over(Window.partitionBy(*by).orderBy("window_start"))
    upto = F.coalesce(following - step, F.greatest(F.lit(end).cast(kind), F.col("window_start")))
    filled = series.withColumn("__upto", upto).withColumn(
        "__at", F.explode(F.sequence(F.col("window_start"), F.col("__upto"), step)))
    lag = (F.unix_micros((F.col("__at") + step).cast("timestamp"))
           - F.unix_micros(F.col("last_synced_at").cast("timestamp"))) / F.lit(float(US))
    return filled.select(*by, F.col("__at").alias("window_start"), (F.col("__at") + step).alias("window_end"),
                         "last_synced_at", F.when(F.col("__at") == F.col("window_start"), F.col("rows"))
                         .otherwise(F.lit(0)).cast("long").alias("rows"), lag.alias("lag_seconds"))
