"""Every core query with SQL gives the same rows as DuckDB."""

from pathlib import Path

import duckdb
import pytest

from leadlens.plans import catalog, decisions, files, general, projections, registry, rollups, selections, streams

DATA = Path("/root/testdata/sf0.001")
SQL = {**registry.SQL, **general.oracle_sql()}
QUERIES = {**registry.QUERIES, **general.queries()}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
assert catalog and decisions and files and projections and rollups and selections and streams


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for file in DATA.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, database, name, tmp_path):
    made = QUERIES[name](spark, str(DATA))
    made.write.parquet(str(tmp_path / "out"))
    columns = ", ".join(sorted(made.columns))
    database.sql(f"create or replace table want as select {columns} from ({SQL[name]})")
    database.sql(f"create or replace table got as select {columns} from '{tmp_path}/out/*.parquet'")
    assert database.sql("select count(*) from (from got except all from want)").fetchall() == [(0,)]
    assert database.sql("select count(*) from (from want except all from got)").fetchall() == [(0,)]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    made = QUERIES[name](spark, str(DATA))
    assert made.count() >= 0 and made.columns
