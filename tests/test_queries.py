"""Every registered query with SQL gives DuckDB's rows; the rest give rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return [plain(x) for x in v.tolist()]
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if pd.isna(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    cols = sorted(df.columns)
    return sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pipeline"])
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 1
