"""Shapes made from the driver's tables, against their SQL."""

import duckdb

from isospan import catalog_shapes


def test_sizes_round_half_way_as_the_sql_does(spark):
    """At sf0.1 a customer's size is half-way; Spark's own round puts it apart."""
    sf = "/root/testdata/sf0.1"
    got = {r["k"]: r["r"] for r in catalog_shapes._spots(spark, sf, "customer", "c", catalog_shapes._C_SIZE).collect()}
    want = dict(duckdb.sql(f"SELECT c_custkey, round(0.5 + abs(c_acctbal) / 5000, 3) FROM '{sf}/customer.parquet'").fetchall())
    assert got == want
