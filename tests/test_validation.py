"""The queries of these modules against their SQL on the smallest tables, when these are there."""

from pathlib import Path

import numpy as np
import pytest

from crosswalk.operators import vector_index
from crosswalk.plans import reviews, sources, validation

D = Path("/root/testdata/sf0.001")
QUERIES, SQL = reviews.QUERIES | sources.QUERIES | validation.QUERIES, reviews.SQL | sources.SQL | validation.SQL


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.skipif(not D.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in D.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, str(D))
    r = c.execute(SQL[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(plain, x)) for x in r.fetchall()), key=repr)
    assert want and sorted((tuple(map(plain, x)) for x in df.select(*cols).collect()), key=repr) == want


def _brute(q, t, k):
    out = set()
    for i, v in q:
        s = sorted((-round(float(np.dot(v, w)), 6), j) for j, w in t)[:k]
        out |= {(i, j, -x, n + 1) for n, (x, j) in enumerate(s)}
    return out


def test_index_skips_cells_and_loses_nothing(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 5
    clustered = [(f"t{i}", (centres[i % 12] + rng.normal(size=16) * 0.3).tolist()) for i in range(600)] + [("zero", [0.0] * 16), ("same", (centres[0] * 2).tolist()), ("tie", (centres[0] * 2).tolist())]
    asked = [(i, (centres[i % 12] * rng.uniform(0.2, 3) + rng.normal(size=16) * 0.2).tolist()) for i in range(40)] + [(100, [0.0] * 16), (101, (-centres[3]).tolist())]
    t = spark.createDataFrame([*clustered, ("none", None), (None, [1.0] * 16)], "id string, vec array<double>").repartition(3)
    q = spark.createDataFrame([*asked, (102, None)], "id long, vec array<double>").repartition(3)
    index = vector_index.build(t, 24)
    for k in (1, 7, 700):
        got = {(r["q"], r["t"], round(r["score"], 4), r["rank"]) for r in vector_index.search(index, q, k).collect()}
        assert got == {(i, j, round(x, 4), n) for i, j, x, n in _brute(asked, clustered, k)}
    assert vector_index.share(index, q.where("id < 100"), 5) < 0.5
    bounds = index.bounds(np.array([v for _, v in asked]))
    cell = {x["t"]: r["cell"] for r in index.packs.collect() for x in r["ts"]}
    assert all(bounds[n, cell[j]] >= np.dot(v, w) - 1e-9 for n, (_, v) in enumerate(asked) for j, w in clustered)
    vector_index.save(index, f"file://{tmp_path}/index")
    again = vector_index.load(spark, f"file://{tmp_path}/index")
    assert sorted(map(tuple, vector_index.search(again, q, 3).collect())) == sorted(map(tuple, vector_index.search(index, q, 3).collect()))
    plan = vector_index.search(index, q, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert vector_index.search(vector_index.build(t.where("false")), q, 3).count() == 0 == vector_index.search(index, q.where("false"), 3).count()
