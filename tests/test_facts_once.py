"""Queries that use the facts several times compute them once."""
import pytest

from stratum import registry as R
from stratum.plans import materialize as MZ
from stratum_test_data import SF_SMALL


@pytest.mark.parametrize("name, reads", [("rollup_choice", "build_rollup"), ("refresh_rollups", "build_rollup")])
def test_rollups_read_staged_facts(spark, monkeypatch, name, reads):
    plans, real = [], getattr(R, reads)

    def kept(df, *args, **kw):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *args, **kw)

    monkeypatch.setattr(R, reads, kept)
    assert R.REGISTRY[name](spark, SF_SMALL).count() > 0
    assert plans and not any("Join" in p or "Window" in p for p in plans)


def test_replacing_write_reads_the_table(spark, monkeypatch):
    plans, real = [], MZ.materialize_table

    def kept(df, *args, **kw):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *args, **kw)

    monkeypatch.setattr(MZ, "materialize_table", kept)
    out = R.REGISTRY["replace_write_partitioned"](spark, SF_SMALL)
    assert min(r["order_ym"] for r in out.select("order_ym").collect()) >= 199901
    assert ["Join" in p for p in plans] == [True, False, False]
