import pytest
from pyspark.sql import functions as F

from crosswalk.operators import catalog, decide, evaluate, graph, quality, review, search, similarity, summaries


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_top_k_breaks_ties_by_id_and_filters_before_ranking(spark):
    t = spark.createDataFrame([(3, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 0), (9, None, 0)], "id long, vec array<float>, label int")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [-1.0, 0.0]), (5, None)], "id long, vec array<float>")
    assert rows(search.top_k(q, t, 2).select("q", "t", "rank"), "q", "rank") == [(7, 1, 1), (7, 3, 2), (8, 2, 1), (8, 1, 2)]
    assert rows(search.top_k(q, t, 2, F.col("label") == 0).select("q", "t", "rank"), "q", "rank") == [(7, 3, 1), (7, 2, 2), (8, 2, 1), (8, 3, 2)]
    assert search.top_k(q.limit(0), t, 2).count() == 0 and search.top_k(q, t.limit(0), 2).count() == 0


def test_top_k_does_not_depend_on_blocks(spark):
    v = spark.range(200).select("id", F.array(*[F.sin(F.col("id") * k).cast("float") for k in range(1, 6)]).alias("vec"))
    a, b = rows(search.top_k(v, v, 7), "q", "rank"), rows(search.top_k(v, v, 7, query_block=13), "q", "rank")
    assert a == b and len(a) == 1400


def test_floor_keeps_all_when_the_best_is_not_positive(spark):
    f = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.74), (1, "c", 0.75), (2, "a", 0.0), (2, "b", -3.0)], "q int, t string, score double")
    assert rows(search.score_floor(f, 0.75).select("q", "t"), "q", "t") == [(1, "a"), (1, "c"), (2, "a"), (2, "b")]


def test_duplicates_are_numbered_only_where_they_occur(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate("ABACA")], "pos int, id string").withColumn("g", F.lit(1))
    assert [r["display"] for r in search.number_duplicates(d, ["g"], "id", ["pos"]).orderBy("pos").collect()] == ["A [1]", "B", "A [2]", "C", "A [3]"]


def test_search_has_no_wildcards(spark):
    c = spark.createDataFrame([("n:a%b", "a%b", "", 0), ("n:axb", "axb", "", 1), ("n:z", "z", "has A%B", 2)], "qname string, local string, definition string, pos int")
    assert [r["qname"] for r in search.search_catalog(c, "A%B").collect()] == ["n:a%b", "n:z"]


def test_jaccard(spark):
    d = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "a"]), (["a", "b"], ["b", "c"]), (None, None)], "a array<string>, b array<string>")
    assert [round(r[0], 3) for r in d.select(similarity.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0, 0.333, 0.0]


def test_staleness(spark):
    k = "key string, hash string, pos int"
    old = spark.createDataFrame([("same", "1", 0), ("changed", "1", 0), ("oldnull", None, 0), ("dropped", "1", 0), ("twice", "0", 0), ("twice", "2", 1)], k)
    new = spark.createDataFrame([("same", "1", 0), ("changed", "2", 0), ("oldnull", "1", 0), ("new", "1", 0), ("twice", "2", 0)], k)
    assert dict(rows(similarity.staleness(old, new))) == {"same": "current", "changed": "stale", "oldnull": "current", "dropped": "dropped", "new": "new", "twice": "current"}


def test_actions(spark):
    c = spark.createDataFrame([("none", "T"), ("all", "T"), ("tie", "T"), ("more", "T"), ("open", "T"), ("lost", None)], "concept string, target string")
    p = spark.createDataFrame([("all", "a", "x"), ("tie", "a", "y"), ("tie", "b", None), ("more", "a", None), ("open", "a", "[undecided]")], "concept string, name string, target string")
    t = spark.createDataFrame([("T", "x")], "type string, property string")
    got = {r["concept"]: r for r in decide.resolve(c, p, t, "Base").collect()}
    assert {k: r["action"] for k, r in got.items()} == {"none": "reuse", "all": "reuse", "tie": "augment", "more": "extend", "open": "extend", "lost": "extend"}
    assert got["lost"]["baseType"] == "Base" and got["tie"]["augmentsType"] == "T" and got["tie"]["extensionType"] is None
    assert got["none"]["rationale"] == "All 0 source properties have equivalents on the target type."
    assert [r[0] for r in p.orderBy("concept", "name").select(decide.property_action(F.col("target"))).collect()] == ["reuse-property", "create-property", "human-must-decide", "reuse-property", "create-property"]


def test_chains_end_at_cycles_and_missing_parents(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "C"), ("E", None), ("F", "gone")], "node string, parent string")
    assert dict(rows(graph.chains(e))) == {"A": ["B", "C"], "B": ["C", "A"], "C": ["A", "B"], "D": ["C", "A", "B"], "E": [], "F": ["gone"]}
    near = graph.nearest_kept(graph.chains(e), spark.createDataFrame([("A",), ("D",), ("C",), ("B",)], "node string"))
    assert dict(rows(near)) == {"A": None, "B": None, "C": None, "D": None, "E": "E", "F": "F"}


def test_pointers_and_recursive_chains_equal_chains(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "C"), ("E", None), ("F", "gone"), ("G", "F"), ("H", "G"), ("I", "H"), ("S", "S"), *[(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]], "node string, parent string")
    assert dict(rows(graph.chains_recursive(e))) == dict(rows(graph.chains(e)))
    for names in (["A", "D", "C", "B"], [], ["F", "G", "H"], ["F", "G", "H", "gone"], ["A", "C", "S"], [f"n{i}" for i in range(1, 39)], [f"n{i}" for i in range(40)]):
        out = spark.createDataFrame([(x,) for x in names], "node string")
        assert dict(rows(graph.first_kept(e, out))) == dict(rows(graph.nearest_kept(graph.chains(e), out))), names


def test_long_chain(spark):
    e = spark.range(60).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert graph.chains(e).where("node = 59").first()["chain"] == list(range(58, -1, -1))


def test_paths(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(2, 2), (20, 21)], "src int, dst int")
    assert dict(rows(graph.shortest(e, 0))) == {i: i for i in range(7)}
    assert rows(graph.subgraph(e, 0), "src") == [(0, 1), (1, 2)]
    assert graph.shortest(e, 99).collect() == [(99, 0)]


def test_blank_nodes_have_stable_distinct_names(spark):
    k = "s string, s_kind string, p string, o string, o_kind string"
    t = [("_:a", "bnode", "p", "1", "literal"), ("_:b", "bnode", "p", "1", "literal"), ("_:c", "bnode", "p", "_:a", "bnode"), ("x", "iri", "q", "_:c", "bnode")]
    got = dict(rows(graph.blank_names(spark.createDataFrame(t, k))))
    assert len(set(got.values())) == 3 and got == dict(rows(graph.blank_names(spark.createDataFrame(t[::-1], k))))


def test_gates_and_audit(spark):
    s = "total int, reuse int, extend int, augment int, exclude int, properties int, reused int, created int"
    assert [r["code"] for r in quality.gates(spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0, 0)], s)).collect()] == ["QG-001"]
    assert [r["code"] for r in quality.gates(spark.createDataFrame([(3, 1, 1, 0, 0, 5, 2, 2)], s)).collect()] == ["QG-002", "QG-003"]
    m = spark.createDataFrame([("a", "extend", "T", None, "T", None, None), ("b", "augment", "T", None, None, "X", "U"), ("c", "exclude", None, None, None, None, None)], "concept string, action string, target string, extensionType string, baseType string, augmentationType string, augmentsType string")
    p = spark.createDataFrame([("b", "x", "create-property")], "concept string, name string, action string")
    n = spark.createDataFrame([("a", 2), ("b", 1)], "concept string, n int")
    assert sorted((r["key"], r["code"]) for r in quality.audit(m, p, n).collect()) == [("a", "GA-004"), ("a", "GA-005"), ("b", "GA-003"), ("b", "GA-007")]
    assert ("b", "GA-002") in {(r["key"], r["code"]) for r in quality.audit(m, p, n, "folio").collect()}


def test_shapes(spark):
    i = spark.createDataFrame([("s1", "C"), ("s2", "C")], "s string, class string")
    t = spark.createDataFrame([("s1", "p", "1", "int"), ("s1", "p", "2", "int")], "s string, p string, o string, o_datatype string")
    c = spark.createDataFrame([("C", "p", 1, 1, "string", False), ("C", "q", 1, None, None, True)], "class string, path string, min int, max int, datatype string, deactivated boolean")
    assert sorted((r["code"], r["key"]) for r in quality.shapes(i, t, c).collect()) == [("datatype", "s1 p"), ("max-count", "s1 p"), ("min-count", "s2 p")]


def test_review(spark):
    m = spark.createDataFrame([("a", "reuse", "pending-review"), ("b", "extend", "accepted")], "concept string, action string, reviewStatus string")
    p = spark.createDataFrame([("a", "x", "human-must-decide", "[undecided]")], "concept string, name string, action string, target string")
    with pytest.raises(ValueError, match="a"):
        review.approve_all(m, p)
    assert dict((r["concept"], r["reviewStatus"]) for r in review.approve_all(m, p.limit(0)).collect()) == {"a": "accepted", "b": "accepted"}
    d = spark.createDataFrame([("a", "x", "reuse-property", "nc:1", 1), ("a", "x", "create-property", None, 2)], "concept string, name string, action string, target string, seq int")
    done = review.decide_property(p.withColumn("reviewStatus", F.lit("p")), d, spark.createDataFrame([("k",)], "key string")).first()
    assert (done["action"], done["target"], done["reviewStatus"]) == ("create-property", None, "accepted")
    with pytest.raises(ValueError, match="nc:1"):
        review.decide_property(p.withColumn("reviewStatus", F.lit("p")), d.where("seq = 1"), spark.createDataFrame([("k",)], "key string"))


def test_evaluation(spark):
    def judge(source, candidates):
        if source == "bad":
            raise RuntimeError("no")
        return evaluate.first_candidate(source, candidates)

    r = spark.createDataFrame([("1", "a", ["x", "y"]), ("2", "bad", ["x"]), ("3", "c", [])], "key string, source string, candidates array<string>")
    got = {x["key"]: x for x in evaluate.evaluate(r, judge).collect()}
    assert got["1"]["target"] == "x" and got["2"]["status"] == "failed" and got["2"]["attempts"] == 2 and got["3"]["target"] is None
    bad = spark.createDataFrame([("1", "a", "a", "z", ["x"], "long enough a reason for it"), ("2", "a", "b", None, ["x"], "short")], "key string, source string, expected string, target string, candidates array<string>, rationale string")
    assert sorted((x["key"], x["code"]) for x in quality.evaluations(bad).collect()) == [("1", "target"), ("2", "rationale"), ("2", "source")]


def test_catalog(spark):
    u = spark.createDataFrame([(1, "n", "a"), (2, "n", "z"), (3, "m", "a")], "use int, name string, prefix string")
    d = spark.createDataFrame([("n", "b", "first", 0), ("n", "a", "own", 1)], "name string, prefix string, definition string, pos int")
    assert {r["use"]: r["definition"] for r in catalog.best_definition(u, d).collect()} == {1: "own", 2: "first", 3: None}
    assert catalog.merge_bounds(spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", None, 4)], "k string, min int, max int"), ["k"]).first() == ("a", 2, 4)
    c = catalog.codelist_types(spark.createDataFrame([("Color",)], "name string"), spark.createDataFrame([("n:ColorSimpleType",), ("n:ColorCodeType",)], "qname string"))
    assert c.first()["qname"] == "n:ColorCodeType"
    each = summaries.candidate_entropy(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "q int, t string"))
    assert rows(each, "q") == [(1, 2, 1.0), (2, 1, 0.0)]
