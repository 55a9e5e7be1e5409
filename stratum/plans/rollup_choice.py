"""Which rollups to build for a log of questions.

Every question needs a set of dimensions and a time granularity.  The candidates
are those needs and the unions of two of them (a wider rollup that serves both).
One pass over the facts, a GROUPING SETS aggregation, gives the exact row count of
each candidate; the greedy rule then takes, again and again, the candidate that
saves most rows read over the whole log, given those already taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import GRANULARITY_PARENTS, truncate_to
from .rollup import Rollup, RollupTable
from .semantic import Cube, _dim_expr, time_column


@dataclass(frozen=True)
class Question:
    measures: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    time_dimension: tuple[str, str] | None = None
    asked: int = 1      # times in the log


@dataclass(frozen=True)
class Choice:
    rollup: Rollup
    rows: int
    saved: int          # rows that the log reads less, given the choices before this one


def _together(a: tuple | None, b: tuple | None) -> tuple[bool, tuple | None]:
    """Whether one rollup can hold both times, and the time it stores."""
    if a is None or b is None:
        return True, a or b
    if a[0] != b[0]:
        return False, None
    for finer, other in ((a, b), (b, a)):
        if other[1] in GRANULARITY_PARENTS[finer[1]]:
            return True, finer
    return True, (a[0], "day")


def candidates(questions: Sequence[Question]) -> list[tuple[tuple[str, ...], tuple[str, str] | None]]:
    needs = list(dict.fromkeys((tuple(sorted(set(q.dimensions))), q.time_dimension) for q in questions))
    out = dict.fromkeys(needs)
    for (d1, t1), (d2, t2) in combinations(needs, 2):
        fits, time = _together(t1, t2)
        if fits:
            out[tuple(sorted({*d1, *d2})), time] = None
    return list(out)


def candidate_rows(df: DataFrame, cube: Cube, sets: Sequence[tuple]) -> tuple[list[int], int]:
    """Rows of each candidate rollup, and of the facts: one scan, counted with partial aggregation."""
    dims = sorted({d for ds, _ in sets for d in ds})
    times = sorted({t for _, t in sets if t})
    names = [*dims, *[time_column(*t) for t in times]]
    cols = [_dim_expr(cube, d).alias(d) for d in dims]
    cols += [truncate_to(_dim_expr(cube, td), g).alias(time_column(td, g)) for td, g in times]
    # no bit for a column that a set groups by; the facts themselves are counted by the set without columns
    members = [{*ds, *([time_column(*t)] if t else [])} for ds, t in sets]
    bits = [sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in m) for m in members]
    if not names:
        return [1] * len(sets), df.count()
    every = (1 << len(names)) - 1
    grouping = [[F.col(n) for n in names if n in m] for m in members]
    if every not in bits:
        grouping.append([])
    counts = (df.select(*cols).groupingSets(grouping, *[F.col(n) for n in names])
              .agg(F.grouping_id().alias("set__"), F.count(F.lit(1)).alias("n__"))
              .groupBy("set__").agg(F.count(F.lit(1)).alias("rows__"), F.sum("n__").alias("n__")).collect())
    found = {r["set__"]: r for r in counts}
    return [found[b]["rows__"] if b in found else 0 for b in bits], found[every]["n__"] if every in found else 0


def choose_rollups(df: DataFrame, cube: Cube, questions: Sequence[Question], most: int) -> list[Choice]:
    """At most ``most`` rollups, in the order taken; none that saves nothing.

    A rollup holds the measures of all questions that it can answer.  Ties go to
    the smaller one, then to the earlier candidate.  The work on the driver is
    that of the questions: their number squared."""
    sets = candidates(questions)
    sizes, facts = candidate_rows(df, cube, sets)
    specs, serves = [], []
    for dims, time in sets:
        bare = Rollup("", tuple(dict.fromkeys(m for q in questions for m in q.measures)), dims, *(time or (None, None)))
        table = RollupTable(cube.name, bare, df, "")
        able = [i for i, q in enumerate(questions) if table.can_answer(cube, q.measures, q.dimensions, q.time_dimension, [])]
        measures = tuple(dict.fromkeys(m for i in able for m in questions[i].measures))
        name = "_".join([*dims, *(time or ())]) or "all"
        specs.append(Rollup(name, measures, dims, *(time or (None, None))))
        serves.append(able)
    cost, out = [facts] * len(questions), []

    def saving(c: int) -> int:
        return sum(questions[i].asked * max(cost[i] - sizes[c], 0) for i in serves[c])

    while len(out) < most and sets:
        best = max(range(len(sets)), key=lambda c: (saving(c), -sizes[c], -c))
        if not saving(best):
            break
        out.append(Choice(specs[best], sizes[best], saving(best)))
        for i in serves[best]:
            cost[i] = min(cost[i], sizes[best])
    return out
