import duckdb
import pandas as pd
import pytest

from isospan import catalog, catalog_more, catalog_scale, catalog_shapes, catalog_tables  # noqa: F401  all register


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        v = v.item() if hasattr(v, "item") else v
        if pd.isna(v):
            return "-"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    cols = sorted(got.columns)
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(want.columns) == cols
    assert plain(rows) == plain(want[cols].itertuples(index=False))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
