"""Each registered query that has SQL gives the rows of that SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tessera.plans.oracles import ORACLE_SQL
from tessera.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(repr(x) for x in row) for row in zip(*(table.column(n).to_pylist() for n in names))))


def kind(t):
    return str(t).replace("large_", "").replace("timestamp[us, tz=UTC]", "timestamp[us]")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLE_SQL:
        assert got.num_rows
        return
    want = duck.execute(ORACLE_SQL[name]).to_arrow_table()
    assert {n: kind(got.schema.field(n).type) for n in got.column_names} == {n: kind(want.schema.field(n).type) for n in want.column_names}
    assert rows(got) == rows(want)
    assert got.num_rows or name == "point_lookup"
