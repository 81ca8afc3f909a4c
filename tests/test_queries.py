"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from wayline.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["trip_summary", "motion_segments", "quality_summary", "gated_events", "event_top10", "rollup_60", "rollup_600", "nearest_asof", "frame_decode", "reject_summary", "fulfilment", "scan_resolve", "retention_plan", "stream_rollup", "stream_episodes", "bucket_state", "context_rows", "backfill", "rebuilt_episodes", "evidence", "unbound", "table_digest", "admitted_rows", "stream_rule_change", "context_install", "context_reassess", "context_close", "device_update", "device_audit", "event_review", "review_audit", "digest_differences", "rollup_segments", "rollup_track", "file_counters"]


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.sql(registry.oracle_sql()[name]).df())
