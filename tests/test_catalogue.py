import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "nation customer events embeddings".split()
SAMPLE = [
    "unified_timeline", "daily_features", "scored_user_days", "alert_decisions", "user_risk_report", "scored_telemetry",
    "rolling_event_counts", "behavioural_signature", "cost_threshold", "pseudonymised_activity", "stream_scored_events",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r.total_risk_score, r.user))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(cols).collect())))
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == cols
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in res.fetchall())
