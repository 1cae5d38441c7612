"""The registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from checks.registry import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
CHOSEN = (
    "bundle_verdict receipts preflight_status folder_rollup_two_roots window_counts expand_selection manifest_signature "
    "replay_split audit_chain_build audit_chain_tamper audit_seal retention_delete selective_restore outages stream_metrics quarantine_write"
).split()


def plain(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in found)


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(QUERIES) == set(ORACLES)
    assert set(CHOSEN) <= set(oracles)


@pytest.fixture(scope="module")
def sql():
    if not DATA.is_dir():
        pytest.skip("no test data")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, str(DATA))
    result = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(map(tuple, df.collect()), df.columns) == plain(result.fetchall(), names)


def test_entry(spark):
    if not DATA.is_dir():
        pytest.skip("no test data")
    flagship = entry.entry(spark)
    assert flagship.count() > 0 and {"accepted", "reason"} <= set(flagship.columns)
