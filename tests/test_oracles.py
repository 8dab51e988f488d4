"""Every query with a SQL oracle gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from murmur.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(rows, columns):
    def cell(v):
        if v is None or v != v:
            return ""
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf, con, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    expected = con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert plain(got.to_dict("records"), columns) == plain(expected.to_dict("records"), columns)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
