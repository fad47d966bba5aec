"""Prefixes, settings and repairs that tables can't show."""

from pyspark.sql import functions as F

from crosswalk.functions import naming


def test_prefixes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "prefix string, uri string")
    source = frame([("nc:", "http://own/nc"), ("source_nc", "http://own/2"), ("own", "http://own/"), ("sh", "http://www.w3.org/ns/shacl#"), ("ext", "http://own/ext"), ("edge", "http://own/edge"), ("plain", "http://p/")])
    got = {r["prefix"]: r["emitted"] for r in naming.namespace_bindings(source, frame([("nc", "http://target/nc")]), "own", "edge:").collect()}
    assert got == {"nc": "source_nc_2", "source_nc": "source_nc", "sh": "sh", "ext": "source_ext", "edge": "source_edge", "plain": "plain"}
    declared = spark.createDataFrame([("a", "x:"), ("b", None), ("c", "")], "inventory string, prefix string")
    classes = spark.createDataFrame([("b", "late:A", 1), ("b", "first:B", 0)], "inventory string, qname string, pos int")
    assert {tuple(r) for r in naming.source_prefix(declared, classes).collect()} == {("a", "x"), ("b", "first"), ("c", "")}


def test_names_and_repairs(spark):
    n = spark.range(1).select(naming.package_names(F.lit("redvale_pd"), F.lit("Hate Crimes"), F.lit("t")).alias("n")).first()["n"]
    assert (n["package"], n["agency_package"], n["edge_namespace"], n["label"], n["trig_file"], n["description"]) == ("redvale_pd_Hate-Crimes_edge_package", "redvale_pd_Hate Crimes_agency_package", "http://redvale_pd.gov/Hate-Crimes/edge#", "Redvale Pd HATE CRIMES", "Hate-Crimes-edge.trig", "t-aligned edge ontology for Hate Crimes")
    rows = spark.createDataFrame([("Address", "d:Address"), ("A &lt; B", "d:A < B"), ("x:Address", "d:Address"), (None, "d:A"), ("A", "A")], "said string, meant string")
    assert [r[0] for r in rows.select(naming.repaired(F.col("said"), F.col("meant"))).collect()] == ["d:Address", "d:A < B", "x:Address", None, "A"]


def test_settings():
    assert naming.settings({"depth": 2, "k": 1}, '{"thresholds": {"depth": 3, "other": 4}}') == {"depth": 3, "k": 1}
    assert naming.settings({"depth": 2}, "no json") == naming.settings({"depth": 2}, "[1]") == naming.settings({"depth": 2}, None) == naming.settings({"depth": 2}, '{"thresholds": [1]}') == {"depth": 2}
