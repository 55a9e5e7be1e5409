"""Pre-aggregated rollups: build, match, answer, refresh.

A rollup stores the *additive parts* of its measures (counts and sums; an
average is sum + count, a ratio is two sums) grouped by its dimensions and a
time dimension at one granularity.  A query can be answered from it when its
dimensions (and filter members) are a subset, its granularity is the same or
coarser and nests (week does not nest in month), and all measures are
covered.  The answer re-aggregates the parts - a much smaller input than the
fact table, so dashboards read kilobytes instead of the whole fact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import GRANULARITY_PARENTS, truncate_to
from ..session import child_names, drop_path, path_exists, shared_dir
from .semantic import (Cube, _agg_parts, _dim_expr, _finalise, filter_condition, time_column)


@dataclass(frozen=True)
class Rollup:
    name: str
    measures: tuple[str, ...]
    dimensions: tuple[str, ...]
    time_dimension: str | None = None
    granularity: str | None = None


# the predictions by model version and period, refreshed by the forecast flow
FORECAST_ROLLUP = Rollup("by_model", ("count", "totalPrediccion", "promedioPrediccion"),
                         ("modeloVersion", "mesSimulado"))


@dataclass
class RollupTable:
    cube: str
    spec: Rollup
    df: DataFrame
    path: str
    source_version: object = None   # max source version at build time
    rows: int | None = None         # rows stored, once looked up

    def row_count(self) -> int:
        """Stored rows, from the files' footers (no column is read)."""
        if self.rows is None:
            self.rows = self.df.count()
        return self.rows

    def can_answer(self, cube: Cube, measures, dimensions, time_dimension, dim_filters) -> bool:
        s = self.spec
        if cube.name != self.cube or not set(measures) <= set(s.measures):
            return False
        members = set(dimensions) | {f[0] for f in dim_filters}
        if time_dimension is not None:
            td, g = time_dimension
            if s.time_dimension != td or g not in GRANULARITY_PARENTS.get(s.granularity, set()):
                return False
        time_filters = {f[0] for f in dim_filters if f[0] == s.time_dimension}
        if time_filters and s.granularity != "day":
            return False
        return (members - time_filters) <= set(s.dimensions)

    def answer(self, cube: Cube, measures, dimensions, time_dimension, dim_filters,
               extra_measures=()) -> DataFrame:
        s = self.spec
        base = self.df
        for member, op, values in dim_filters:
            col = (F.col(time_column(s.time_dimension, s.granularity))
                   if member == s.time_dimension else F.col(member))
            base = base.where(filter_condition(col, op, values))
        groups = [F.col(d) for d in dimensions]
        if time_dimension:
            td, g = time_dimension
            src = F.col(time_column(s.time_dimension, s.granularity))
            groups.append(truncate_to(src, g).alias(time_column(td, g)))
        needed = list(dict.fromkeys(list(measures) + list(extra_measures)))
        parts = [_combined(cube, m, n).alias(n) for m in needed for n, _ in _agg_parts(cube, m)]
        agg = base.groupBy(*groups).agg(*parts) if groups else base.agg(*parts)
        keys = list(dimensions) + ([time_column(*time_dimension)] if time_dimension else [])
        return agg.select(*keys, *[_finalise(cube, m) for m in needed])


def _combined(cube: Cube, measure: str, part: str) -> Column:
    """How a stored part combines: sums add up, counts too and are 0 without rows."""
    total = F.sum(F.col(part))
    is_count = cube.measures[measure].type in ("count", "count_if") or part.endswith("__c")
    return F.coalesce(total, F.lit(0)) if is_count else total


def match_rollup(rollups: Sequence[RollupTable], cube: Cube, measures, dimensions,
                 time_dimension, dim_filters) -> RollupTable | None:
    """The smallest rollup able to answer the query (of equal ones the first given)."""
    able = [r for r in rollups or ()
            if r.can_answer(cube, measures, dimensions, time_dimension, dim_filters)]
    return able[0] if len(able) == 1 else min(able, key=RollupTable.row_count, default=None)


VERSION = "__source_version"


def rollup_frame(df: DataFrame, cube: Cube, spec: Rollup, version_col: str | None = None) -> DataFrame:
    """The rollup's rows: dimensions x truncated time -> additive parts."""
    groups = [_dim_expr(cube, d).alias(d) for d in spec.dimensions]
    if spec.time_dimension:
        groups.append(truncate_to(_dim_expr(cube, spec.time_dimension), spec.granularity)
                      .alias(time_column(spec.time_dimension, spec.granularity)))
    parts = [p.alias(n) for m in spec.measures for n, p in _agg_parts(cube, m)]
    if version_col:
        parts.append(F.max(version_col).alias(VERSION))
    return df.groupBy(*groups).agg(*parts)


def rollup_home(df: DataFrame, cube: Cube, spec: Rollup) -> str:
    """The rollup's place in the shared folder, the same for every refresh."""
    return f"{shared_dir(df.sparkSession).rstrip('/')}/stratum/rollups/{cube.name}/{spec.name}"


def build_rollup(df: DataFrame, cube: Cube, spec: Rollup, path: str | None = None,
                 version_col: str | None = None) -> RollupTable:
    """Aggregate and persist a rollup: one pass, which also finds the source version.

    Refreshes alternate between numbered folders below ``path``, so readers of
    the last one are not disturbed; the one before it goes.
    """
    spark = df.sparkSession
    home = path or rollup_home(df, cube, spec)
    done = child_names(spark, home)
    n = max([int(c[2:]) for c in done if c.startswith("v=")], default=-1) + 1
    out = f"{home}/v={n}"
    rollup_frame(df, cube, spec, version_col).write.mode("overwrite").parquet(out)
    rows, version = spark.read.parquet(out), None
    if version_col:
        version = rows.agg(F.max(VERSION)).first()[0]
        rows = rows.drop(VERSION)
    return RollupTable(cube.name, spec, rows, out, version)


def refresh_rollups(df: DataFrame, cube: Cube, tables: Sequence[RollupTable],
                    force: bool = False, version_col: str | None = None,
                    current: object = None) -> list[RollupTable]:
    """Rebuild rollups in place; without ``force`` skip those whose source is unchanged.

    ``current`` is the source's version where the caller knows it (a batch or
    table version); else the newest ``version_col`` of the source is looked up.
    """
    if not force and version_col and current is None:
        current = df.agg(F.max(version_col)).first()[0]
    out = []
    for t in tables:
        if not force and version_col and t.source_version == current:
            out.append(t)
            continue
        home, _, last = t.path.rpartition("/v=")
        out.append(build_rollup(df, cube, t.spec, path=home, version_col=version_col))
        before = f"{home}/v={int(last) - 1}"
        if int(last) and path_exists(df.sparkSession, before):
            drop_path(df.sparkSession, before)
    return out
