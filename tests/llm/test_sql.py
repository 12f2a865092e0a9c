import os

import duckdb
import pandas as pd
import pytest

from isospan.llm import queries, sql


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def plain(rows):
    def one(v):
        v = v.item() if hasattr(v, "item") else v
        return "-" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = queries.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = duck.execute(sql.oracle_sql()[name]).df()
    assert sorted(want.columns) == cols
    assert plain(tuple(r[c] for c in cols) for r in got.collect()) == plain(want[cols].itertuples(index=False))


def test_a_query_for_each_operator():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
