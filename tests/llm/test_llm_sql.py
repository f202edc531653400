"""The operators' queries against their SQL, on the small tables."""

import os

import duckdb
import pytest

from sievelane.llm import queries


def rows(table, columns):
    plain = lambda x: round(float(x), 9) + 0.0 if isinstance(x, int | float) and not isinstance(x, bool) else float(x) if type(x).__name__ == "Decimal" else x
    return sorted(repr([plain(r[c]) for c in columns]) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    got, want = queries.QUERIES[name](spark, data).toArrow(), con.execute(queries.ORACLE[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got, sorted(got.column_names)) == rows(want, sorted(got.column_names))
