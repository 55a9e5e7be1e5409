"""The smallest rollup answers; the greedy choice of rollups for a log, against plain Python."""

import datetime as dt
import random

from stratum.plans.rollup import Rollup, build_rollup, match_rollup
from stratum.plans.rollup_choice import Question, candidate_rows, candidates, choose_rollups
from stratum.plans.semantic import Cube, Dimension, Measure, query

CUBE = Cube("Facts", "facts", measures={"count": Measure("count"), "total": Measure("sum", "amount")},
            dimensions={"a": Dimension("a"), "b": Dimension("b"), "day": Dimension("day", "time")})
LOG = [Question(("count",), ("a",), ("day", "month"), 9), Question(("total",), ("b",), ("day", "day"), 4),
       Question(("count",), ("a", "b"), None, 2), Question(("total",), (), ("day", "week"), 1), Question(("count",), (), None, 3)]


def facts(spark, n=400):
    rnd = random.Random(1)
    rows = [(rnd.choice(["x", "y", None]), rnd.randrange(4), rnd.choice([None, dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(90))]), i)
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "a string, b int, day date, amount long")


def cells(rows, dims, time):
    def at(d):
        g = time and time[1]
        return (None if d is None or not g else d if g == "day" else d.replace(day=1) if g == "month"
                else d - dt.timedelta(days=d.weekday()))
    return len({(*[r["ab".index(d)] for d in dims], at(r[2])) for r in rows})


def test_counts_and_greedy_choice(spark):
    rows, df = facts(spark)
    sets = candidates(LOG)
    assert (("a", "b"), ("day", "day")) in sets and (("b",), ("day", "day")) in sets
    sizes, n = candidate_rows(df, CUBE, sets)
    assert n == len(rows) and sizes == [cells(rows, *s) for s in sets]

    chosen, cost = choose_rollups(df, CUBE, LOG, 3), [n] * len(LOG)
    assert len(chosen) == 3
    finer = {"day": "day week month", "week": "week", "month": "month"}

    def able(q, dims, time):
        return set(q.dimensions) <= set(dims) and (q.time_dimension is None or
                                                   (time is not None and q.time_dimension[1] in finer[time[1]].split()))

    for c in chosen:
        saved = {s: sum(q.asked * max(cost[i] - size, 0) for i, q in enumerate(LOG) if able(q, *s)) for s, size in zip(sets, sizes)}
        spec = c.rollup
        this = spec.dimensions, (spec.time_dimension, spec.granularity) if spec.granularity else None
        assert c.saved == saved[this] == max(saved.values()) and c.rows == sizes[sets.index(this)]
        cost = [min(x, c.rows) if able(q, *this) else x for x, q in zip(cost, LOG)]
    assert choose_rollups(df.limit(0), CUBE, LOG, 3) == []
    assert choose_rollups(df, CUBE, [], 3) == []


def test_smallest_rollup_answers(spark):
    _, df = facts(spark)
    wide, narrow = (build_rollup(df, CUBE, Rollup(n, ("count",), d, "day", "day")) for n, d in (("wide_c", ("a", "b")), ("narrow_c", ("a",))))
    for order in ([wide, narrow], [narrow, wide]):
        assert match_rollup(order, CUBE, ["count"], ["a"], ("day", "month"), []) is narrow
        assert match_rollup(order, CUBE, ["count"], ["b"], None, []) is wide
        got, want = (query(df, CUBE, ["count"], ["a"], ("day", "month"), rollups=x).collect() for x in (order, []))
        assert sorted(got, key=str) == sorted(want, key=str)
    assert match_rollup([], CUBE, ["count"], [], None, []) is None
