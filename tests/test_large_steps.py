"""Steps on larger tables: what they shuffle, read and hold grows no faster than the tables."""

from pyspark.sql import functions as F

from crosswalk.operators import graph, review, shacl
from crosswalk.sources.rdf import parse_text


def shuffled(spark, job) -> int:
    """Bytes that ``job`` writes to shuffles."""
    context = spark.sparkContext._jsc.sc()

    def written() -> int:
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    job()
    return written() - before


def test_paths_do_not_shuffle_edges(spark):
    # a thousand rings of 100 nodes, every edge twice
    e = spark.range(100_000).selectExpr("id as src", "id - id % 100 + (id + 1) % 100 as dst")
    e = e.unionByName(e)
    got = []
    n = shuffled(spark, lambda: got.extend(graph.shortest(e, 250, 6).collect()))
    assert sorted(map(tuple, got)) == sorted((250 + i, abs(i)) for i in range(-6, 7))
    assert n < 100_000
    # beyond the nodes that are sent, edges are shuffled and give the same
    both = e.unionByName(e.selectExpr("dst as src", "src as dst"))
    start = spark.createDataFrame([(250,), (17,)], "root long")
    rows = lambda most: sorted(map(tuple, graph.reachable(start, both, 4, most).collect()))
    assert rows(0) == rows(1) == rows(100) and len(rows(0)) == 18


def test_decisions_are_dealt_by_their_number(spark):
    p = spark.range(1_200_000).selectExpr("concat('c', id) as concept", "concat('n', id % 3) as name", "'human-must-decide' as action", "'t' as target", "'pending-review' as reviewStatus")
    d = p.where("substr(concept, 2) % 2 = 0").selectExpr("concept", "name", "'create-property' as action", "cast(null as string) as target", "1 as seq")
    got = review.decide_property(p, d.unionByName(d), spark.createDataFrame([("t",)], "key string"))
    # 2.4 million rows, so five tasks, though sessions shuffle to four and coalesce small ones
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert got.select(F.spark_partition_id()).distinct().count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got.groupBy("action", "target", "reviewStatus").count().collect()), key=str) == [("create-property", None, "accepted", 600_000), ("human-must-decide", "t", "pending-review", 600_000)]


def test_shapes_read_edges_once(spark):
    node = spark.range(20_000)
    link = node.selectExpr("concat('x:a', id) as s", "'x:next' as p", "concat('x:a', id + 1) as o", "'iri' as o_kind", "cast(null as string) as o_datatype")
    typed = node.selectExpr("concat('x:a', id) as s", f"'{shacl.RDF}type' as p", "'x:A' as o", "'iri' as o_kind", "cast(null as string) as o_datatype")
    shapes = parse_text(spark, """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix x: <x:> .
x:S a sh:NodeShape ; sh:targetClass x:A ; sh:property [ sh:path x:next ; sh:class x:A ] ; sh:property [ sh:path ( x:next x:next ) ; sh:minCount 1 ] ; sh:property [ sh:path x:next ; sh:maxCount 1 ] .""", "shapes")
    got = []
    n = shuffled(spark, lambda: got.extend(shacl.validate(link.unionByName(typed), shapes).collect()))
    assert sorted((r["focus"], r["component"]) for r in got) == [("x:a19999", "class"), ("x:a19999", "minCount")]
    assert n < 5_500_000
