"""Queries of this subpackage against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from planloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shown(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    a = sorted(tuple(shown(r[x]) for x in sorted(columns)) for r in got.collect())
    b = sorted(tuple(shown(v) for _, v in sorted(zip(columns, r, strict=True))) for r in want.fetchall())
    assert sorted(got.columns) == sorted(columns) and a == b
