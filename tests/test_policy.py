"""Class-target policy, cascades of new targets and whole decisions."""

import hashlib

import pytest

from crosswalk.operators import policy


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def model(spark):
    classes = spark.createDataFrame([("http://a.test/", "Person"), ("http://a.test/more/", "Boat")], "namespace string, name string")
    spaces = spark.createDataFrame([("a", "http://a.test/"), ("m", "http://a.test/more/")], "prefix string, base string")
    return policy.Policy(classes, spaces, spark.createDataFrame([("http://a.test/", "Root")], "namespace string, name string"))


def test_targets(spark, model):
    picked = spark.createDataFrame([("c1", "a:Person"), ("c2", "http://a.test/more/Boat"), ("c3", None), ("c4", "[undecided]"), ("c5", "a:Text"), ("c6", "http://other.test/X"), ("c7", "zz:Person"), ("c8", "http://a.test/Root")], "concept string, target string")
    kept, rejected = policy.canonical_targets(picked, model)
    assert rows(kept) == [("c1", "a:Person"), ("c2", "m:Boat"), ("c3", None), ("c4", "[undecided]"), ("c8", "a:Root")]
    assert [r[:2] for r in rows(rejected)] == [("c5", "a:Text"), ("c6", "http://other.test/X"), ("c7", "zz:Person")]
    with pytest.raises(ValueError, match="3 targets are rejected: c5: .*c6: .*c7: "):
        policy.checked_targets(picked, model)
    free = policy.Policy(None, model.namespaces)
    assert rows(policy.checked_targets(picked, free)) == rows(picked)


def test_invalid_targets_of_a_matrix(spark, model):
    m = spark.createDataFrame(
        [("c1", "reuse", "a:Text", None, None), ("c2", "extend", "a:Text", "a:Text", None), ("c3", "extend", "a:Person", "a:Root", None), ("c4", "augment", "a:Person", "a:Text", "a:Root"), ("c5", "reuse", "a:Root", None, None), ("c6", "exclude", "a:Text", None, None), ("c7", "reuse", None, None, None), ("c8", "extend", "a:Text", "m:None", None)],
        "concept string, action string, target string, baseType string, augmentsType string",
    )
    assert rows(policy.invalid_targets(m, model)) == [
        ("c1", "a:Text", "target", "not-a-class"), ("c2", "a:Text", "target/baseType", "not-a-class"), ("c4", "a:Root", "augmentsType", "root-only-extends"), ("c5", "a:Root", "target", "root-only-extends"),
        ("c8", "a:Text", "target", "not-a-class"), ("c8", "m:None", "baseType", "not-a-class"),
    ]


def test_cascade(spark, model):
    cols = "concept string, target string, action string, rationale string, extensionType string, baseType string, augmentationType string, augmentsType string, reviewStatus string, ruleId string, targetDefinition string, targetDefinitionHash string, targetLabel string, note string"
    old = ("reuse", "why", None, None, None, None, "accepted", "r", "old", "h", "Old", "kept")
    m = spark.createDataFrame([(f"s:C{i}", "a:Person", *old) for i in range(4)], cols)
    props = spark.createDataFrame([(f"s:C{i}", f"p{j}", t, "accepted") for i in range(4) for j, t in enumerate(("x:on", "x:else", None))], "concept string, name string, target string, reviewStatus string")
    has = spark.createDataFrame([("m:Boat", "x:on"), ("a:Person", "x:on")], "type string, property string")
    catalog = spark.createDataFrame([("m:Boat", "Boat", "It floats."), ("a:Person", "", None)], "key string, label string, definition string")
    changes = spark.createDataFrame([("s:C1", "http://a.test/more/Boat"), ("s:C2", None), ("s:C3", "a:Person"), ("s:gone", "a:Person")], "concept string, target string")
    got, after = policy.cascade(m, changes, props, has, catalog, model, "root:Base")
    assert got.columns == m.columns
    by = {r["concept"]: r for r in got.collect()}
    assert len(by) == 4 and tuple(by["s:C0"]) == tuple(m.where("concept = 's:C0'").first())
    b = by["s:C1"]
    assert (b["target"], b["action"], b["augmentsType"], b["baseType"], b["reviewStatus"], b["ruleId"], b["targetDefinition"], b["targetLabel"], b["note"]) == ("m:Boat", "augment", "m:Boat", None, "pending-review", policy.CASCADE, "It floats.", "Boat", "kept")
    assert b["targetDefinitionHash"] == hashlib.sha256(b"It floats.").hexdigest()[:16]
    none = by["s:C2"]
    assert (none["target"], none["action"], none["baseType"], none["targetDefinition"], none["targetDefinitionHash"], none["targetLabel"]) == (None, "extend", "root:Base", "", None, None)
    assert (by["s:C3"]["targetDefinition"], by["s:C3"]["targetLabel"]) == ("", None)
    assert {(r["concept"], r["reviewStatus"]) for r in after.collect()} == {("s:C0", "accepted"), *((f"s:C{i}", "pending-review") for i in (1, 2, 3))} and after.count() == 12
    with pytest.raises(ValueError, match="rejected"):
        policy.cascade(m, changes.limit(0).union(spark.createDataFrame([("s:C1", "a:Text")], "concept string, target string")), props, has, catalog, model)


def test_properties_and_issues(spark):
    v = "concept string, name string, hash string, definition string, pos int"
    old = spark.createDataFrame([("c", "a", "1", "x", 0), ("c", "b", "1", "x", 0), ("c", "d", None, "x", 0), ("c", "e", "1", "x", 0), ("gone", "a", "1", "x", 0), ("c", "f", "0", "w", 0), ("c", "f", "1", "x", 1)], v)
    new = spark.createDataFrame([("c", "a", "2", "y", 0), ("c", "b", "1", "x", 0), ("c", "d", "2", "y", 0), ("c", "new", "2", "y", 0), ("fresh", "a", "2", "y", 0), ("c", "f", "2", "y", 0)], v)
    assert rows(policy.stale_properties(old, new)) == [("c", "a", "x", "y"), ("c", "f", "x", "y")]
    cols = "concept string, action string, target string, extensionType string, baseType string, augmentationType string, augmentsType string"
    entries = spark.createDataFrame([("ok", "extend", None, "E", "B", None, ""), ("x", "extend", None, "E", None, None, "A"), ("y", "reuse", "", None, "B", None, None), ("z", "augment", "t", "E", None, "A", None), ("w", "exclude", None, "E", None, None, None)], cols)
    assert rows(policy.class_issues(entries)) == [("x", "extend requires baseType"), ("x", "extend should not have augmentsType"), ("y", "reuse requires target"), ("y", "reuse should not have baseType"), ("z", "augment requires augmentsType"), ("z", "augment should not have extensionType")]
    p = spark.createDataFrame([("c", "a", "reuse-property", "[undecided]"), ("c", "b", "reuse-property", "t"), ("c", "d", "create-property", None), ("c", "e", "human-must-decide", None), ("c", "f", None, None), ("c", "g", "odd", "t")], "concept string, name string, action string, target string")
    assert rows(policy.property_issues(p)) == [("c", "a", "reuse-property requires target"), ("c", "e", "human-must-decide: must be resolved"), ("c", "f", "unknown property action: none"), ("c", "g", "unknown property action: odd")]
    catalog = spark.createDataFrame([("t", "It is."), ("[undecided]", "never")], "key string, definition string")
    assert [r[-2:] for r in sorted(map(tuple, policy.refingerprint(p.select("name", "target"), catalog).collect()))][:2] == [(None, None), ("It is.", hashlib.sha256(b"It is.").hexdigest()[:16])]
