"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from logloom.plans.queries import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("events", "documents", "pages")


def canonical(frame):
    text = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(map(str, ((tuple(round(x, 6) if isinstance(x, float) else x for x in row)) for row in text.itertuples(index=False))))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["raw_ids", "fingerprint_counts", "shapes", "parse_json", "parse_syslog", "stats_by_status", "merkle_batches", "samples_split", "drift_rows"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in got.columns:
        if str(got[c].dtype) != str(want[c].dtype):
            want[c] = want[c].astype(got[c].dtype, errors="ignore")
    assert canonical(got) == canonical(want)
