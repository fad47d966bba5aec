"""Faults that the third round's findings named: work that grew faster than its input, and ties."""

import json
import random

import pandas as pd
import pytest

from crosswalk.operators import active, graph, search
from crosswalk.plans import packages
from crosswalk.sources import rdf, rdf_formats


def shuffled(spark) -> int:
    """Bytes that all tasks so far wrote to shuffles."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_uses_without_an_owner_of_their_own_are_not_dealt_again(spark):
    n = 400
    uses = spark.range(n).selectExpr("concat('c', id) AS context", "concat('l', id) AS leaf", "'p' AS property")
    owners = spark.range(n).selectExpr("'p' AS property", "concat('o', id) AS owner")
    act = spark.range(n).selectExpr("concat('o', id) AS qname", "'reuse' AS action")
    before = shuffled(spark)
    got = active.emitting_identities(uses, owners, act, uses.selectExpr("property AS qname"))
    assert got.count() == n * n
    assert shuffled(spark) - before < 200_000


def test_owners_of_uses(spark):
    uses = spark.createDataFrame([("c1", "l1", "p"), ("c2", "l2", "p"), ("c3", "l3", "p"), ("c4", "l4", "x"), ("c5", "l5", "q"), ("c5", "l5", "q")], "context string, leaf string, property string")
    owners = spark.createDataFrame([("p", "l1"), ("p", "c1"), ("p", "c2"), ("p", "c2")], "property string, owner string")
    act = spark.createDataFrame([("l1", "reuse"), ("c2", "extend"), ("c4", "augment")], "qname string, action string")
    got = active.emitting_identities(uses, owners, act, spark.createDataFrame([("p",), ("q",)], "qname string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([
        ("c1", "l1", "p", "l1", "reuse"), ("c2", "l2", "p", "c2", "extend"), ("c3", "l3", "p", "l1", "reuse"), ("c3", "l3", "p", "c1", None),
        ("c3", "l3", "p", "c2", "extend"), ("c4", "l4", "x", "c4", "augment"), ("c5", "l5", "q", None, "reuse"),
    ], key=repr)


def test_triples_of_small_texts_leave_together_and_of_large_ones_apart():
    texts = [json.dumps({"@id": f"x:{i}", "x:p": list(range(k))}) for i, k in enumerate([1] * 3000 + [2500])]
    given = iter([pd.DataFrame({"text": texts, "graph": "g"})])
    sizes = [len(f) for f in rdf.frames(given, "text", "graph", lambda x, g: rdf_formats.parse(x, g, "json-ld"), 1000)]
    assert sizes == [1000] * 5 + [500]


def test_ancestors_of_graphs_with_cycles_and_shared_parents(spark):
    r = random.Random(3)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(21)] + [(121, 100), (7, 7)]
    up, want = {}, set()
    for n, p in edges:
        up.setdefault(n, set()).add(p)
    for n in up:
        front = seen = up[n]
        while front:
            front = {p for x in front for p in up.get(x, ())} - seen
            seen = seen | front
        want |= {(n, a) for a in seen if a != n}
    got = [tuple(x) for x in graph.ancestors(spark.createDataFrame(edges, "node int, parent int")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_a_lattice_are_not_met_by_every_node_between(spark):
    e = spark.range(1, 3000).selectExpr("id AS node", "explode(array(id div 2, id div 3)) AS parent").where("parent > 0")
    before = shuffled(spark)
    n = graph.ancestors(e).count()
    assert (shuffled(spark) - before) / n < 45


def test_bounds_at_equal_prices_are_those_of_the_first_row(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(5)
    rows = [(i, r.randrange(9), 0, r.randrange(1, 3), float(r.randrange(50)), r.choice([1.0, 2.0, 3.0]), r.choice("ANR"), r.choice("FO")) for i in range(200)]
    columns = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_returnflag l_linestatus".split()
    pd.DataFrame(rows, columns=columns).to_parquet(tmp_path / "lineitem.parquet")
    c = duckdb.connect()
    c.execute("set threads = 1")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert sorted(map(tuple, packages.cardinality_map(spark, str(tmp_path)).select("type", "bounds").collect())) == sorted(c.execute(packages.SQL["cardinality_map"]).fetchall())


def test_blocks_of_queries_and_targets_meet_in_pairs(spark):
    v = spark.range(90).selectExpr("id", "transform(sequence(0, 5), i -> cast((id * 37 + i * i * 11) % 19 - 9 as float)) AS vec").cache()
    q, t = v.where("id % 3 = 0"), v.where("id % 3 <> 0")
    few, many = search.top_k(q, t, 4), search.top_k(q, t, 4, query_block=7, target_block=11)
    assert "FlatMapCoGroupsInArrow" in many._jdf.queryExecution().toString()
    assert few.count() == 120 and sorted(few.collect()) == sorted(many.collect())


def test_models_and_documents_stay_small_however_many_parts_there_are(spark, tmp_path):
    part = [(k, "n", "Brand#1", "t", k % 50, 1000.0) for k in range(5000)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    seen, made = [], packages.package.model_xml
    packages.package.model_xml = lambda *a: seen.append(made(*a)) or seen[-1]
    try:
        found = packages._models(spark, str(tmp_path))
    finally:
        packages.package.model_xml = made
    assert seen[0].selectExpr("max(length(xml))").first()[0] < 400_000
    assert found.where("kind = 'Class'").count() == 5000 and found.where("kind = 'DatatypeProperty'").count() == 50
