import datetime as dt
import json

from stratum.operators import audit as AU
from stratum.sources.tables import read_golden_sets


def test_authorize_and_report(spark):
    req = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 0, 0, 1), "u1", "admin", "list_datasets", "{}"),
         (2, dt.datetime(2024, 1, 1, 0, 0, 2), "u2", "analyst", "list_datasets", "{}"),
         (3, dt.datetime(2024, 1, 1, 0, 0, 3), "u3", "guest", "list_dashboards", "{}"),
         (4, dt.datetime(2024, 1, 1, 0, 0, 4), "u2", "analyst", "get_dashboard_info", "{}")],
        "request_id long, timestamp timestamp, user_name string, role string, "
        "tool_name string, arguments string")
    grants = AU.grants_frame(spark)
    grants = grants.unionByName(grants)               # duplicated grants: no fan-out
    dec = {r.request_id: r.status for r in AU.authorize(req, grants).collect()}
    assert dec == {1: "GRANTED", 2: "DENIED - RBAC", 3: "DENIED - RBAC", 4: "GRANTED"}
    log = AU.audit_rows(AU.authorize(req, grants))
    assert [r.user_name for r in AU.audit_recent(log, 2).collect()] == ["u2", "u3"]
    assert AU.audit_total(log).first().total == 4
    assert {r.status: r["count"] for r in AU.audit_by_status(log).collect()} == {
        "GRANTED": 2, "DENIED - RBAC": 2}


def test_golden_sets_json_array(spark, tmp_path):
    rows = [{"query": "q1", "expected_sql": "select 1"}, {"query": "q2"},
            {"expected_sql": "select 3"}, {"query": "q4", "expected_sql": "select 4"}]
    (tmp_path / "set1.json").write_text(json.dumps(rows, indent=2))
    got = read_golden_sets(spark, str(tmp_path), multi_line=True).collect()
    assert sorted(r.query for r in got) == ["q1", "q4"]
