"""The queries that have SQL against it, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from blobsmith.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query(spark, name):
    with duckdb.connect() as c:
        for path in SF.glob("*.parquet"):
            c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        found = c.execute(queries.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        want = sorted((tuple(str(v) for _, v in sorted(zip(names, row, strict=True))) for row in found.fetchall()))
    df = queries.QUERIES[name](spark, str(SF))
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want
