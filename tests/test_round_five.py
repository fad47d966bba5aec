"""Faults that the fourth round's findings named: disk and driver memory that grew with the tables."""

import random

import pytest
from pyspark.sql import functions as F

from crosswalk.operators import graph
from crosswalk.sources import extract, rdf


def shuffled(spark) -> int:
    """Bytes that all tasks so far wrote to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_pairs_of_low_layers_are_not_shuffled_each(spark):
    e = spark.range(1, 110_000).selectExpr("id AS node", "explode(array(id div 2, id div 3)) AS parent").where("parent > 0")
    before = shuffled(spark)
    n = graph.ancestors(e).count()
    by = sorted(2**a * 3**b for a in range(17) for b in range(11) if a + b)
    assert n == sum(len({k // m for m in by if m <= k}) for k in range(1, 110_000))
    assert (shuffled(spark) - before) / n < 30


@pytest.mark.parametrize("core", [0, 5, 40])
def test_ancestors_by_layers_above_cycles_and_chains(spark, core):
    r = random.Random(4)
    # a core with cycles, layers below it whose nodes have up to four parents, a loop, a chain, and roots of their own
    edges = [(r.randrange(12), r.randrange(12)) for _ in range(20)] + [(n, r.randrange(n)) for n in range(12, 150) for _ in range(r.randrange(5))]
    edges += [(200 + i, 201 + i) for i in range(9)] + [(300, 300), (301, 300), (302, None)]
    up, want = {}, set()
    for n, p in edges:
        if p is not None and p != n:
            up.setdefault(n, set()).add(p)
    for n in up:
        front = seen = up[n]
        while front:
            front = {p for x in front for p in up.get(x, ())} - seen
            seen = seen | front
        want |= {(n, a) for a in seen if a != n}
    got = [tuple(x) for x in graph.ancestors(spark.createDataFrame(edges, "node int, parent int"), core).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_shapes_are_made_of_triples_made_once_and_no_table_is_sent(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(k):
        made.add(1)
        return f"""@prefix x: <http://e.test/ns#> . @prefix sh: <http://www.w3.org/ns/shacl#> .
        x:S{k} a sh:NodeShape ; sh:targetClass x:A{k}, x:B{k} ; sh:property [ sh:path x:p ; sh:minCount {k} ; sh:maxCount 30 ; sh:class x:V ], [ sh:path ( x:p x:q ) ; sh:deactivated true ] .
        x:O{k} a sh:NodeShape ; sh:deactivated true ; sh:property x:P{k} . x:P{k} sh:path x:r ; sh:severity sh:Warning .
        x:N{k} sh:targetClass x:A{k} ; sh:property [ sh:path x:p ] . x:E{k} a sh:NodeShape ; sh:targetClass x:A{k} ."""

    triples = rdf.parse_column(spark.range(20).select(text("id").alias("text"), F.col("id").cast("string").alias("graph")))
    got = extract.shapes(triples, {"x": "http://e.test/ns#"}).select("shape", "class", "path", "pathKind", "min", "max", "valueClass", "deactivated", "severity")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {tuple(x) for x in got.collect()}
    assert got.count() == len(rows) == 100 and made.value == 20
    s = "http://e.test/ns#S7"
    assert {x for x in rows if x[0] == s} == {r for c in ("x:A7", "x:B7") for r in ((s, c, "x:p", "path", 7, 30, "x:V", False, "Violation"), (s, c, None, "expression", None, None, None, True, "Violation"))}
    assert [x for x in rows if x[0] == "http://e.test/ns#O7"] == [("http://e.test/ns#O7", None, "x:r", "path", None, None, None, True, "Warning")]
