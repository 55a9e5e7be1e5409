"""Rollups kept up by signed changes, and dimension changes found by their digests."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from stratum.plans import medallion as MD
from stratum.plans.rollup import Rollup, build_rollup
from stratum.plans.rollup_deltas import MaintainedRollup, NotRetractable
from stratum.plans.semantic import Cube, Dimension, Measure, query

FACT = "id long, cat string, day date, amount decimal(18,2), ratio double"
CUBE = Cube("Facts", "facts",
            measures={"count": Measure("count"), "total": Measure("sum", "amount"), "mean": Measure("avg", "amount"),
                      "large": Measure("count_if", "amount > 5"), "loose": Measure("sum", "ratio"),
                      "share": Measure("number", numerator="amount", denominator="amount"), "least": Measure("min", "amount")},
            dimensions={"id": Dimension("id", primary_key=True), "cat": Dimension("cat"), "day": Dimension("day", "time")})
DAILY = Rollup("daily", ("count", "total", "mean", "large", "share"), ("cat",), "day", "day")


def facts(rng, ids):
    return {i: (i, rng.choice(["a", "b", None]), rng.choice([None, dt.date(2024, rng.randint(1, 4), rng.randint(1, 28))]),
                rng.choice([None, Decimal(rng.randint(-900, 900)) / 100]), 0.1) for i in ids}


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("spec", [DAILY, Rollup("flat", DAILY.measures, ("cat",)), Rollup("all", DAILY.measures, ())],
                         ids=lambda s: s.name)
def test_two_batches_equal_a_rebuild(spark, spec):
    rng = random.Random(1)
    now = facts(rng, range(200))
    kept = MaintainedRollup(spark, CUBE, spec)
    kept.build(spark.createDataFrame(list(now.values()), FACT))
    for batch in (facts(rng, range(150, 260)), {i: None for i in range(100)} | facts(rng, range(300, 310))):
        gone = [now.pop(i) for i in batch if i in now]
        came = [r for r in batch.values() if r]
        now |= {r[0]: r for r in came}
        kept.apply(spark.createDataFrame(came, FACT), spark.createDataFrame(gone, FACT))
        whole = spark.createDataFrame(list(now.values()), FACT)
        fresh = build_rollup(whole, CUBE, spec)
        assert rows(kept.rollup().df.select(fresh.df.columns)) == rows(fresh.df)
        ask = {"measures": ["count", "mean", "large"], "dimensions": ["cat"] if spec.dimensions else []}
        assert rows(query(whole, CUBE, rollups=[kept.rollup()], **ask)) == rows(query(whole, CUBE, **ask))


def test_only_touched_months_are_written(spark):
    kept = MaintainedRollup(spark, CUBE, DAILY)
    base = [(i, "a", dt.date(2024, 1 + i % 3, 5), Decimal(1), 0.1) for i in range(30)]
    kept.build(spark.createDataFrame(base, FACT))
    gone, came = spark.createDataFrame(base[:1], FACT), spark.createDataFrame([(0, "a", dt.date(2024, 3, 5), Decimal(1), 0.1)], FACT)
    assert kept.apply(came, gone) == [202401, 202403]
    assert kept.table.manifest() == {202401: 1, 202402: 0, 202403: 1}
    assert kept.apply(gone, gone) == []  # what goes and comes again changes nothing
    month = [r for r in base if r[2].month == 2]
    assert kept.apply(None, spark.createDataFrame(month, FACT)) == [202402]
    assert 202402 not in kept.table.manifest()


def test_what_cannot_be_taken_back_is_named(spark):
    with pytest.raises(NotRetractable, match="least"):
        MaintainedRollup(spark, CUBE, Rollup("r", ("least",), ("cat",)))
    kept = MaintainedRollup(spark, CUBE, Rollup("r", ("loose",), ("cat",)))
    with pytest.raises(NotRetractable, match="loose"):
        kept.build(spark.createDataFrame([(1, "a", None, None, 0.1)], FACT))


def test_changed_ids_of_two_snapshots(spark):
    schema = "product_id long, product_name string, category string, price_usd decimal(18,2), replicated_at long"
    before = spark.createDataFrame([(1, "x", "a", Decimal(1), 1), (2, "y", None, Decimal(2), 1), (3, "z", "c", None, 1)], schema)
    now = spark.createDataFrame([(1, "x", "a", Decimal(1), 9), (2, "y", "", Decimal(2), 1), (4, "z", "c", None, 1)], schema)
    digests = [MD.row_digests(df, "product_id") for df in (before, now)]
    # 1 was only replicated again; 2 went from null to empty, 3 is gone, 4 is new
    assert sorted(r[0] for r in MD.changed_ids(*digests, "product_id").collect()) == [2, 3, 4]


def test_snapshots_count_from_the_last_whole_one(spark, tmp_path):
    one, two = (spark.createDataFrame(r, "product_id long, digest string") for r in ([(1, "a")], [(1, "b")]))
    kept = MD.Snapshots(spark, str(tmp_path))
    assert kept.changed({"product_id": one}) == {}
    kept.keep({"product_id": one})
    two.write.parquet(f"{tmp_path}/dimensions/r=1/product_id")  # a run that stopped before it was done
    assert [r[0] for r in kept.changed({"product_id": two})["product_id"].collect()] == [1]
    assert kept.changed({"product_id": one})["product_id"].count() == 0
