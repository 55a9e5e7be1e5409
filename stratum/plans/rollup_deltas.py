"""Rollups kept up by signed changes.

A rollup's parts are counts and sums, so a change of facts is a sum too: the old
version of a fact counts -1, the new one +1.  The summed deltas of a batch are
merged into the partitions of the rollup that they touch; the facts are not read
again, and other partitions keep their files.

Beside each sum the table keeps how many values went into it, and how many facts
are in each group: a sum of no values is null again, and a group without facts
disappears.

Not retractable, and refused by name: sums of DOUBLE or FLOAT columns (taking a
value out of a rounded sum leaves a rest), and any measure that is no sum or
count (a minimum or maximum cannot be taken back without the other facts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.scalar import truncate_to, yyyymm
from ..session import scratch_path
from .materialize import materialize_table
from .rollup import Rollup, RollupTable
from .semantic import Cube, _dim_expr, time_column
from .versioned import VersionedTable

SIGN, FACTS, PART = "__sign", "__facts", "rollup_part"
#: partitions of a rollup without a time dimension
HASH_PARTS = 64


class NotRetractable(ValueError):
    """A measure whose stored parts cannot take a fact back."""


def part_inputs(cube: Cube, measure: str) -> dict[str, tuple[str, str | None]]:
    """Stored part -> what it counts or sums: ("facts" | "if" | "values" | "sum", expression)."""
    m = cube.measures[measure]
    if m.type == "count":
        return {f"{measure}__n": ("facts", None)}
    if m.type == "count_if":
        return {f"{measure}__n": ("if", m.sql)}
    if m.type == "sum":
        return {f"{measure}__s": ("sum", m.sql)}
    if m.type == "avg":
        return {f"{measure}__s": ("sum", m.sql), f"{measure}__c": ("values", m.sql)}
    if m.type == "number":
        return {f"{measure}__num": ("sum", m.numerator), f"{measure}__den": ("sum", m.denominator)}
    raise NotRetractable(f"{cube.name}.{measure}: {m.type}")


def _values(part: str) -> str:
    return f"{part}__values"


class MaintainedRollup:
    """A rollup in ``path`` that follows its facts by deltas."""

    def __init__(self, spark: SparkSession, cube: Cube, spec: Rollup, path: str | None = None):
        self.spark, self.cube, self.spec = spark, cube, spec
        self.inputs = {p: x for m in spec.measures for p, x in part_inputs(cube, m).items()}
        self.table = VersionedTable(spark, path or scratch_path(spark, f"rollup-{cube.name}-{spec.name}"), PART)
        self.keys = list(spec.dimensions)
        if spec.time_dimension:
            self.keys.append(time_column(spec.time_dimension, spec.granularity))

    def _check(self, facts: DataFrame) -> None:
        for part, (kind, sql) in self.inputs.items():
            if kind == "sum":
                found = facts.select(F.expr(sql).alias("x")).schema["x"].dataType
                if isinstance(found, (DoubleType, FloatType)):
                    raise NotRetractable(f"{self.cube.name}, {part}: a sum of {found.simpleString()}")

    def _part(self) -> Column:
        """The partition of a row: the month of its time, or a hash of its dimensions."""
        if self.spec.time_dimension:
            return F.coalesce(yyyymm(self.keys[-1]), F.lit(0))
        return F.pmod(F.xxhash64(*self.keys) if self.keys else F.lit(0), F.lit(HASH_PARTS)).cast("int")

    def deltas(self, added: DataFrame | None, retracted: DataFrame | None) -> DataFrame:
        """The summed change per group, in one aggregation over both sides."""
        sides = [df.withColumn(SIGN, F.lit(sign)) for df, sign in ((added, 1), (retracted, -1)) if df is not None]
        self._check(sides[0])
        rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
        groups = [_dim_expr(self.cube, d).alias(d) for d in self.spec.dimensions]
        if self.spec.time_dimension:
            groups.append(truncate_to(_dim_expr(self.cube, self.spec.time_dimension), self.spec.granularity)
                          .alias(self.keys[-1]))
        sign, parts = F.col(SIGN), [F.sum(SIGN).alias(FACTS)]
        for part, (kind, sql) in self.inputs.items():
            x = F.expr(sql) if sql else None
            if kind == "facts":
                parts.append(F.sum(sign).alias(part))
            elif kind == "if":
                parts.append(F.coalesce(F.sum(F.when(x, sign)), F.lit(0)).alias(part))
            else:
                n = F.coalesce(F.sum(F.when(x.isNotNull(), sign)), F.lit(0))
                parts.append(n.alias(part if kind == "values" else _values(part)))
                if kind == "sum":
                    parts.append(F.coalesce(F.sum(F.when(sign > 0, x).otherwise(-x)), F.lit(0)).alias(part))
        return rows.groupBy(*groups).agg(*parts)

    def build(self, facts: DataFrame) -> RollupTable:
        """The rollup of all facts."""
        self.table.replace(self.deltas(facts, None).withColumn(PART, self._part()), self.keys)
        return self.rollup()

    def apply(self, added: DataFrame | None, retracted: DataFrame | None) -> list[int]:
        """Merges a change of facts; the partitions that were written.

        Only the changed facts and the touched partitions are read."""
        change = materialize_table(self.deltas(added, retracted).withColumn(PART, self._part()),
                                   scratch_path(self.spark, "rollup-deltas"))
        sums = [c for c in change.columns if c not in (*self.keys, PART)]
        moved = change.where(" OR ".join(f"`{c}` <> 0" for c in sums))
        touched = sorted(r[0] for r in moved.select(PART).distinct().collect())  # months or hash parts: few
        if touched:
            old = self.table.read().where(F.col(PART).isin(touched))
            merged = (old.unionByName(moved).groupBy(*self.keys, PART)
                      .agg(*[F.sum(c).cast(old.schema[c].dataType).alias(c) for c in sums]).where(F.col(FACTS) != 0))
            self.table.replace_partitions(merged, touched, self.keys)
        return touched

    def rollup(self) -> RollupTable:
        """The rollup as queries answer from it."""
        rows = self.table.read()
        parts = [F.when(F.col(_values(p)) != 0, F.col(p)).alias(p) if kind == "sum" else F.col(p)
                 for p, (kind, _) in self.inputs.items()]
        return RollupTable(self.cube.name, self.spec, rows.select(*self.keys, *parts), self.table.path)
