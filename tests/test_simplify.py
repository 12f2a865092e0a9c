"""Rings dealt in batches: many small ones, and those that lie across batches."""

import pandas as pd

from isospan import shared
from isospan.operators import spatial


def test_groups_stay_whole_across_batches():
    whole = pd.DataFrame({"group": [None, None, 1, 1, 1, 1, 1, 2, 3, 3], "v": range(10)})
    for size in (1, 2, 3, 7, 10):
        batches = [whole.iloc[i : i + size] for i in range(0, 10, size)]
        got = [(pdf, starts) for pdf, starts in spatial.whole_groups(iter([batches[0].iloc[:0], *batches]), "group")]
        assert [v for pdf, _ in got for v in pdf["v"]] == list(range(10))
        rings = [pdf["v"].tolist()[a:b] for pdf, starts in got for a, b in zip(starts, [*starts[1:], len(pdf)])]
        assert rings == [[0, 1], [2, 3, 4, 5, 6], [7], [8, 9]]
    assert list(spatial.whole_groups(iter([]), "group")) == []


def test_many_rings_share_a_call(spark, monkeypatch):
    """2,000 dented squares keep their corners; Python gets them by batches, not one by one."""
    dented = [(0, 0), (0.5, 0.00625), (1, 0), (1.00625, 0.5), (1, 1), (0.5, 0.99375), (0, 1), (0.00625, 0.5)]
    rows = [("A", g, i, x + 3.0 * g, float(y)) for g in range(2000) for i, (x, y) in enumerate(dented)]
    frame = spark.createDataFrame(rows, "iso3c string, `group` int, `order` int, long double, lat double")
    plans = []
    made = shared.cut
    monkeypatch.setattr(shared, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or made(df))
    out = spatial.simplify_geometry(frame, 0.4)
    got = {(r["group"], r["order"]) for r in out.collect()}
    assert got == {(g, i) for g in range(2000) for i in (0, 2, 4, 6)}
    assert any("MapInPandas" in p for p in plans) and not any("FlatMapGroupsInPandas" in p for p in plans)
