"""Text artifacts from tables: graph schema and data statements, ontologies, named graphs, directories and reports.

Each function gives rows (section, key, line) or (key, line); :func:`write_lines` writes them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.functions.names import kebab, relationship_type
from crosswalk.functions.values import cypher_literal, cypher_text


def _t(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def write_lines(lines: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """Lines in order as one text folder; an artifact is read as a whole, so it is one file."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode(mode).text(path)


def schema_statements(classes: DataFrame, relationships: DataFrame) -> DataFrame:
    """Constraints and name indexes of classes (label, key), and a comment for each relationship (type, src, dst)."""
    unique = classes.select(F.lit(1).alias("section"), F.col("label").alias("key"), _t("CREATE CONSTRAINT ", kebab(F.col("label")), "_key IF NOT EXISTS FOR (n:", F.col("label"), ") REQUIRE n.", F.col("key"), " IS UNIQUE;").alias("line"))
    index = classes.select(F.lit(2).alias("section"), F.col("label").alias("key"), _t("CREATE INDEX ", kebab(F.col("label")), "_name IF NOT EXISTS FOR (n:", F.col("label"), ") ON (n.name);").alias("line"))
    notes = relationships.select(F.lit(3).alias("section"), _t(F.col("type"), F.col("src"), F.col("dst")).alias("key"), _t("// (:", F.col("src"), ")-[:", F.col("type"), "]->(:", F.col("dst"), ")").alias("line"))
    return unique.unionByName(index).unionByName(notes)


def seed_statements(nodes: DataFrame, literals: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, label) with their literals (id, name, value, datatype), then edges (src, src_label, type, dst, dst_label) between them."""
    sets = literals.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(_t(F.col("name"), ": ", cypher_literal(F.col("value"), F.col("datatype"))))), ", ").alias("props"))
    props = F.when(F.col("props").isNotNull(), _t(", ", F.col("props"))).otherwise("")
    made = nodes.join(sets, "id", "left").select(F.lit(1).alias("section"), F.col("id").alias("key"), _t("CREATE (:", F.col("label"), " {id: '", cypher_text(F.col("id")), "'", props, "});").alias("line"))
    end = lambda n, c: _t("(", n, ":", F.col(f"{c}_label"), " {id: '", cypher_text(F.col(c)), "'})")
    linked = edges.select(F.lit(2).alias("section"), _t(F.col("src"), F.col("type"), F.col("dst")).alias("key"), _t("MATCH ", end("a", "src"), ", ", end("b", "dst"), " CREATE (a)-[:", relationship_type(F.col("type")), "]->(b);").alias("line"))
    return made.unionByName(linked)


def query_templates(classes: DataFrame) -> DataFrame:
    """Templates for the three classes (label, n_values, n_relations) with most values, and for the first five with two relations or more."""
    top = classes.orderBy(F.desc("n_values"), "label").limit(3).select(F.lit(1).alias("section"), F.col("label").alias("key"), _t("MATCH (n:", F.col("label"), ") WHERE n[$key] = $value RETURN n;").alias("line"))
    wide = classes.where("n_relations >= 2").orderBy("label").limit(5).select(F.lit(2).alias("section"), F.col("label").alias("key"), _t("MATCH (n:", F.col("label"), " {id: $id}) OPTIONAL MATCH (n)-[r]-(m) RETURN n, collect(DISTINCT [type(r), m]);").alias("line"))
    spark = classes.sparkSession
    fixed = [(3, "path", "MATCH p = shortestPath((a {id: $from})-[*..6]-(b {id: $to})) RETURN p;"), (4, "subgraph", "MATCH p = (n {id: $id})-[*0..2]-() RETURN p;")]
    return top.unionByName(wide).unionByName(spark.createDataFrame(fixed, "section int, key string, line string"))


def turtle_term(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    text = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    quoted = _t('"', text, '"')
    plain = datatype.isNull() | datatype.endswith("#string")
    return F.when(kind == "iri", _t("<", value, ">")).when(kind == "bnode", value).when(lang.isNotNull(), _t(quoted, "@", lang)).when(plain, quoted).otherwise(_t(quoted, "^^<", datatype, ">"))


def statements(triples: DataFrame) -> DataFrame:
    """A line for each triple."""
    none = F.lit(None).cast("string")
    line = _t(turtle_term(F.col("s"), F.col("s_kind"), none, none), " <", F.col("p"), "> ", turtle_term(F.col("o"), F.col("o_kind"), F.col("o_datatype"), F.col("o_lang")), " .")
    return triples.select(F.concat_ws(" ", "s", "p", "o").alias("key"), line.alias("line"))


def named_graph(triples: DataFrame, graph: str, prefixes: dict[str, str]) -> DataFrame:
    """A graph in braces after its prefixes; of repeated prefixes the first counts."""
    spark = triples.sparkSession
    head = [(0, p, f"@prefix {p}: <{u}> .") for p, u in prefixes.items()] + [(1, "", f"<{graph}> {{"), (3, "", "}")]
    return spark.createDataFrame(head, "section int, key string, line string").unionByName(statements(triples).select(F.lit(2).alias("section"), "key", _t("  ", F.col("line")).alias("line")))


def class_blocks(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Classes (name, parent, label, comment) and their properties (class, name, kind, range, declared) as an ontology; domains only where declared."""
    q = lambda c: turtle_term(c, F.lit("literal"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    c = classes.select(F.lit(1).alias("section"), F.col("name").alias("key"), _t(F.col("name"), " a owl:Class", F.when(F.col("parent").isNotNull(), _t(" ; rdfs:subClassOf ", F.col("parent"))).otherwise(""), " ; rdfs:label ", q(F.col("label")), F.when(F.coalesce("comment", F.lit("")) != "", _t(" ; rdfs:comment ", q(F.col("comment")))).otherwise(""), " .").alias("line"))
    kind = F.when(F.col("kind") == "object", "owl:ObjectProperty").otherwise("owl:DatatypeProperty")
    p = properties.select(F.lit(2).alias("section"), F.col("name").alias("key"), _t(F.col("name"), " a ", kind, F.when(F.col("declared"), _t(" ; rdfs:domain ", F.col("class"))).otherwise(""), F.when(F.col("range").isNotNull(), _t(" ; rdfs:range ", F.col("range"))).otherwise(""), " .").alias("line"))
    return c.unionByName(p.dropDuplicates(["key", "line"]))


def restrictions(reused: DataFrame) -> DataFrame:
    """A restriction for each distinct reused property (class, target, range): all values from its range, or a minimum of 0 without one."""
    r = reused.groupBy("class", "target").agg(F.min("range").alias("range"))
    how = F.when(F.col("range").isNotNull(), _t("owl:allValuesFrom ", F.col("range"))).otherwise("owl:minCardinality 0")
    return r.select(F.concat_ws(" ", "class", "target").alias("key"), _t(F.col("class"), " rdfs:subClassOf [ a owl:Restriction ; owl:onProperty ", F.col("target"), " ; ", how, " ] .").alias("line"))


def justifications(matrix: DataFrame) -> DataFrame:
    """A Markdown section for each extended or augmented concept (concept, action, target, rationale)."""
    rows = matrix.where(F.col("action").isin("extend", "augment"))
    parts = F.array(_t("## ", F.col("concept")), F.lit(""), _t("- action: ", F.col("action")), _t("- target: ", F.coalesce("target", F.lit("none"))), _t("- reason: ", F.col("rationale")), F.lit(""))
    return rows.select(F.col("concept").alias("key"), F.posexplode(parts).alias("section", "line")).select("key", "section", "line")


def transform_rules(fields: DataFrame) -> DataFrame:
    """Import rules of each class (class, source, target, datatype) as one JSON text."""
    from crosswalk.functions.values import date_transform

    rule = F.struct("source", "target", date_transform(F.col("datatype")).alias("transform"))
    return fields.groupBy(F.col("class").alias("key")).agg(F.to_json(F.sort_array(F.collect_list(rule))).alias("line"))
