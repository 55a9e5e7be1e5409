"""Streaming "condition held for a duration" alert on runs of samples.

1. Within a micro-batch the samples of each (series, time slice) are reduced to
   runs: stretches in which the condition holds or does not hold.  A series that
   holds all rows is spread over its slices, and only runs go on, so what one
   task handles for a series grows with the changes of the condition, not with
   the samples.
2. ``transformWithState`` merges a series' runs in time order into a value
   state: whether the last run holds the condition, when it started, whether it
   already fired, and the time of the last sample.  An alert row is emitted once
   per streak, at the first sample where ``t - streak_start >= hold``.  If the
   streak began before a slice, that sample is among the slice's first samples
   within ``hold``; the first run of a slice carries those times.
3. Event-time timers fire a streak whose series fell silent, and drop the state
   of idle series.

A heartbeat (a second stream of event times) moves the watermark when every
series is silent: the watermark then follows the stream that is ahead
(``multipleWatermarkPolicy`` max).

That is the streaming counterpart of
:func:`stratum.operators.monitor.alert_intervals`: the same streaks qualify.
Input must arrive in event-time order per series across micro-batches (a broker
partition keyed by series gives that): runs that end before the series' last
sample are dropped, and a run that began before it counts from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.series import epoch_micros
from .latest_stream import use_rocksdb_state

STATE_SCHEMA = "on boolean, since long, fired boolean, last_t long, timer long"
#: a slice is so many times as long as the hold, so few samples of it can matter to an older streak
SLICE_HOLDS = 60
RUNS_PER_BATCH = 10_000
NOT_FIRED = np.iinfo(np.int64).min


def run_columns(t: np.ndarray, on: np.ndarray, groups: np.ndarray, hold_us: int, idle_us: int | None) -> dict[str, np.ndarray]:
    """The runs of many series' samples at once.

    ``groups``: where a group of samples begins, each in time order.  Columns of a run:
    its place (``start``), on, first_t, last_t, n, fired_t (``NOT_FIRED``: not yet), and heads, how
    many of its first samples are times at which an older streak could fire (the first
    run of a group only)."""
    cut = on[1:] != on[:-1]
    if idle_us is not None:
        cut |= np.diff(t) > idle_us
    starts = np.union1d(groups, np.flatnonzero(cut) + 1)
    ends = np.append(starts[1:], len(t))
    held, first, last = on[starts], t[starts], t[ends - 1]
    due, fired = ends - 1, np.full(len(starts), NOT_FIRED, np.int64)
    for i in np.flatnonzero(held & (last - first >= hold_us)).tolist():
        a, b = starts[i], ends[i]
        due[i] = a + np.searchsorted(t[a:b], first[i] + hold_us, side="left")
        fired[i] = t[due[i]]
    heads = np.where(held & np.isin(starts, groups), due + 1 - starts, 0)
    return {"start": starts, "on": held, "first_t": first, "last_t": last, "n": ends - starts, "fired_t": fired,
            "heads": heads}


def runs_of(t: np.ndarray, on: np.ndarray, hold_us: int, idle_us: int | None) -> list[dict]:
    """The runs of one series' samples in time order: on, first_t, last_t, n, fired_t
    (None: not yet), and heads, the times at which an older streak could fire in the first run."""
    if not len(t):
        return []
    c = {k: v.tolist() for k, v in run_columns(t, on, np.array([0]), hold_us, idle_us).items()}
    return [{"on": on, "first_t": first, "last_t": last, "n": n, "fired_t": None if fired == NOT_FIRED else fired,
             "heads": t[a:a + heads].tolist()}
            for a, on, first, last, n, fired, heads in zip(*c.values())]


def run_rows(samples: DataFrame, threshold: float, hold_us: int, idle_us: int | None) -> DataFrame:
    """Runs of ``samples`` (series, t, tb, v), made per (series, time slice) of a micro-batch.

    Rows without a time (heartbeats among them) are left out."""
    slice_us = max(SLICE_HOLDS * hold_us, 1_000_000)
    kind = samples.schema["series"].dataType
    schema = (f"series {kind.simpleString()}, on boolean, first_t long, last_t long, n long, fired_t long, "
              "heads array<long>")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        held = held.filter(pc.is_valid(held["t"]))
        if not held.num_rows:
            return
        names = held["series"].combine_chunks().dictionary_encode(null_encoding="encode")
        code = names.indices.to_numpy(zero_copy_only=False)
        t, tb = (held[c].to_numpy() for c in ("t", "tb"))
        v = held["v"].to_numpy(zero_copy_only=False).astype(np.float64)
        piece = t // slice_us
        order = np.lexsort((tb, t, piece, code))
        code, t, piece = code[order], t[order], piece[order]
        on = np.nan_to_num(v[order], nan=-np.inf) > threshold
        groups = np.append(0, np.flatnonzero((np.diff(code) != 0) | (np.diff(piece) != 0)) + 1)
        runs = run_columns(t, on, groups, hold_us, idle_us)
        for at in range(0, len(runs["start"]), RUNS_PER_BATCH):
            r = {k: c[at:at + RUNS_PER_BATCH] for k, c in runs.items()}
            offsets = np.append(0, np.cumsum(r["heads"]))
            heads = t[np.arange(offsets[-1]) + np.repeat(r["start"] - offsets[:-1], r["heads"])]
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(code[r["start"]], pa.int32())), pa.array(r["on"]),
                 *[pa.array(r[c], pa.int64()) for c in ("first_t", "last_t", "n")],
                 pa.array(r["fired_t"], pa.int64(), mask=r["fired_t"] == NOT_FIRED),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(heads, pa.int64()))],
                ["series", "on", "first_t", "last_t", "n", "fired_t", "heads"])

    dealt = samples.repartition("series", F.floor(F.col("t") / slice_us))
    return dealt.select("series", "t", "tb", "v").mapInArrow(make, schema)


def advance(state: tuple, run: dict, hold_us: int, idle_us: int | None) -> tuple[tuple, tuple[int, int] | None]:
    """The state after ``run``, and the streak that fires (its start and the time), if one does."""
    on, since, fired, last = state
    if last is not None and run["last_t"] < last:
        return state, None
    first = run["first_t"]
    if last is not None and first < last:  # began before what the series has seen already
        first = next((h for h in run["heads"] if h >= last), last)
    if not run["on"]:
        return (False, -1, False, run["last_t"]), None
    if on and not (idle_us is not None and first - last > idle_us):
        at = next((h for h in run["heads"] if h >= since + hold_us), None) if not fired else None
        if at is None and not fired and run["last_t"] >= since + hold_us:
            at = run["fired_t"] if run["fired_t"] is not None else run["last_t"]
    else:
        since, fired, at = first, False, run["fired_t"]
    return (True, since, fired or at is not None, run["last_t"]), (since, at) if at is not None else None


class HeldCondition(StatefulProcessor):
    """One value state and at most one timer per series."""

    def __init__(self, hold_us: int, idle_us: int | None, silent: bool):
        self.hold_us, self.idle_us, self.silent = hold_us, idle_us, silent
        self.timed = silent or idle_us is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", STATE_SCHEMA)

    def _keep(self, state: tuple, timer: int, watermark_ms: int) -> None:
        """Keeps the state, and comes back when a streak is due to fire, or else when the series is idle.

        ``timer``: the one that is set, 0 for none."""
        on, since, fired, last = state
        times = [-(-(last + self.idle_us) // 1000)] if self.idle_us is not None else []
        if self.silent and on and not fired:
            times.append(-(-(since + self.hold_us) // 1000))
        due = max(min(times), watermark_ms + 1) if times else 0
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.state.update((on, since, fired, last, due))

    @staticmethod
    def _rows(key: tuple, fires: list[tuple[int, int]]) -> list[Row]:
        return [Row(series=key[0], start_t=start, fired_t=at) for start, at in fires]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        *state, timer = self.state.get() or (False, -1, False, None, 0)
        state, fires = tuple(state), []
        for run in sorted((r.asDict() for r in rows), key=lambda r: (r["first_t"], r["last_t"])):
            state, fire = advance(state, run, self.hold_us, self.idle_us)
            fires += [fire] if fire else []
        self._keep(state, timer, timerValues.getCurrentWatermarkInMs() if self.timed else 0)
        yield from self._rows(key, fires)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.state.get()
        if kept is None:
            return
        on, since, fired, last, timer = kept
        if expiredTimerInfo.getExpiryTimeInMs() == timer:
            timer = 0
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.silent and on and not fired and watermark * 1000 >= since + self.hold_us:
            # still on as far as anyone knows, and held long enough
            fired = True
            yield from self._rows(key, [(since, since + self.hold_us)])
        if self.idle_us is not None and watermark * 1000 - last >= self.idle_us:
            self.state.clear()  # the series sent nothing for so long in event time: forget it
            return
        self._keep((on, since, fired, last), timer, watermark)

    def close(self) -> None:
        pass


def alert_stream(samples: DataFrame, series: str, ts: str, value: str, threshold: float,
                 hold_s: float, tiebreak: str | None = None,
                 idle_timeout_s: float | None = 6 * 3600, watermark: str = "10 minutes",
                 fire_when_silent: bool = False, heartbeat: DataFrame | None = None) -> DataFrame:
    """``series, start_ts, fired_ts`` once per streak of ``value > threshold``
    lasting ``hold_s``, on a stream.

    ``idle_timeout_s``: a silence longer than this between consecutive
    samples of a series breaks its streak, and the state of a series that
    stays silent is dropped once the watermark (``ts`` delayed by
    ``watermark``) passes its last sample plus the idle time, so state does
    not grow with every series ever seen.  None keeps the state of every
    series and lets a streak span any gap, as the batch form does by default.

    ``fire_when_silent``: a streak whose series then sends nothing fires at
    ``start + hold`` once the watermark passes that time, instead of with the
    series' next sample.  Other series move the watermark, and so does
    ``heartbeat``, a stream with a column ``ts``, when all of them are silent.
    """
    spark = samples.sparkSession
    use_rocksdb_state(spark)
    timed = idle_timeout_s is not None or fire_when_silent or heartbeat is not None
    if timed:
        samples = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    prepared = samples.select(
        F.col(ts).alias("at"), F.col(series).alias("series"), epoch_micros(samples, ts).alias("t"),
        F.col(value).cast("double").alias("v"),
        (F.col(tiebreak) if tiebreak else F.lit(0)).cast("long").alias("tb"))
    if heartbeat is not None:
        spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
        kinds = {f.name: f.dataType for f in prepared.schema.fields}
        beats = heartbeat.select(F.col("ts").cast("timestamp").alias("at")).withWatermark("at", watermark)
        prepared = prepared.unionByName(beats.select(
            "at", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("series", "t", "v", "tb")]))
    hold_us = int(hold_s * 1_000_000)
    idle_us = None if idle_timeout_s is None else int(idle_timeout_s * 1_000_000)
    runs = run_rows(prepared, float(threshold), hold_us, idle_us)
    kind = samples.schema[series].dataType.simpleString()
    # rows, not frames: a series has few runs in a batch, and a frame for each costs more than they do
    res = runs.groupBy("series").transformWithState(
        HeldCondition(hold_us, idle_us, fire_when_silent), f"series {kind}, start_t long, fired_t long",
        "append", "EventTime" if timed else "None")
    to_ts = "timestampadd(MICROSECOND, {}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return res.select(F.col("series").alias(series),
                      F.expr(to_ts.format("start_t")).alias("start_ts"),
                      F.expr(to_ts.format("fired_t")).alias("fired_ts"))
