import hashlib

import pytest
from pyspark.sql import functions as F

from crosswalk.functions import names, values


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("a:Foo", "Foo"), ("a:b:c", "b:c"), ("Foo", "Foo"), ("http://x.test/ns#Foo", "Foo"), ("urn:x:y", "y"), ("https://x.test/", "https://x.test/"), ("", ""), (None, None)])
def test_local_name(spark, text, want):
    assert one(spark, text, names.local_name) == want


@pytest.mark.parametrize(("text", "want"), [(None, None), ("", hashlib.sha256(b"").hexdigest()[:16]), ("né", hashlib.sha256("né".encode()).hexdigest()[:16])])
def test_definition_hash(spark, text, want):
    assert one(spark, text, values.definition_hash) == want


@pytest.mark.parametrize(("text", "want"), [("", (0, None)), ("*", (0, None)), ("1", (1, 1)), ("0..1", (0, 1)), ("1..*", (1, None)), ("x", (0, None))])
def test_multiplicity(spark, text, want):
    lo, hi = values.multiplicity(F.col("x"))
    assert tuple(spark.createDataFrame([(text,)], "x string").select(lo, hi).first()) == want


def test_a_bound_that_is_no_number_raises(spark):
    lo, hi = values.multiplicity(F.col("x"))
    with pytest.raises(Exception, match="(?i)cast|invalid"):
        spark.createDataFrame([("0..x",)], "x string").select(lo, hi).collect()


@pytest.mark.parametrize(("f", "text", "want"), [(names.relationship_type, "a:hasPart2Of", "HAS_PART2_OF"), (names.kebab, "FooBarBaz", "foo-bar-baz"), (names.graph_identifier, "2nd line", "_2nd_line"), (names.id_to_qname, "nc.A.B", "nc:A.B"), (names.augmentation_type_name, "nc:PersonType", "PersonAugmentationType"), (lambda c: names.slugify_ncname(c), " 9 a  b! ", "a-b"), (lambda c: names.split_capitals(c, " "), "FooBAR", "Foo B A R")])
def test_names(spark, f, text, want):
    assert one(spark, text, f) == want


def test_quirks_of_types(spark):
    assert one(spark, "dateTime", values.tabular_type) == "xs:string" and one(spark, "INT", values.tabular_type) == "xs:integer"
    assert one(spark, values.XSD + "dateTime", values.graph_type) == "DATETIME" and one(spark, None, values.graph_type) == "STRING"
    assert one(spark, "FooCodeType", values.pattern_of) == "simple_value" and one(spark, "Foo", values.pattern_of) == "object"


def test_org_and_source(spark):
    got = spark.createDataFrame([("https://data.x.gov/ontology/y/",), ("https://x.org/ontology/y#",), ("http://x.org/y",), ("urn",), (None,), ("",)], "x string").select(*names.org_and_source(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("x", "y", "high"), ("x", "y", "high"), ("x", "y", "medium"), (None, "urn", "low"), (None, None, "none"), (None, None, "none")]


def test_literals_and_definitions(spark):
    rows = spark.createDataFrame([("12", "integer"), ("1x", "integer"), ("it's", "string"), ("TRUE", "boolean"), ("1e3", "double")], "v string, t string")
    assert [r[0] for r in rows.select(values.cypher_literal(F.col("v"), F.concat(F.lit(values.XSD), "t"))).collect()] == ["12", "'1x'", "'it\\'s'", "true", "1e3"]
    assert one(spark, "Element# 1\nUser Story:\nUser Story: told\n  plain ", values.clean_definition) == "told plain" and one(spark, None, values.clean_definition) == ""
