"""Hierarchies and graphs: chains of ancestors, reachable properties, paths, neighbourhoods and names of blank nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosswalk.operators.lineage import cut, dealt, sent

#: nodes of one step that are sent to all edges
FRONT = 500_000
#: edges of a hierarchy that is searched as a whole
CORE = 100_000
#: edges of a layer, each with its parent's ancestors, that a task holds
EACH = 100_000


def chains(edges: DataFrame) -> DataFrame:
    """node and chain (its ancestors, nearest first) from (node, parent), a parent each at most.

    A chain ends before a node that it already has, the start too. Chains double each round: a chain of 2^k ancestors is followed by that of its
    last one; rounds end when all chains have, however long.
    """
    e = edges.where("parent is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    kind = f"array<{dict(e.dtypes)['parent']}>"
    # past the first repetition a chain runs round a cycle, so its distinct nodes in order are what comes before
    own = lambda c: F.slice(F.array_distinct(F.concat(F.array("node"), c)), 2, F.size(c) + 1)
    first = own(F.array("parent"))
    at = cut(e.select("node", first.alias("chain"), F.when(F.size(first) > 0, F.col("parent")).alias("last")))
    while not at.where("last is not null").isEmpty():
        nxt = at.select(F.col("node").alias("n2"), F.col("chain").alias("c2"), F.col("last").alias("l2"))
        both = at.join(nxt, F.col("last") == F.col("n2"), "left").withColumn("all", F.when(F.col("c2").isNotNull(), F.concat("chain", "c2")).otherwise(F.col("chain")))
        grown = both.withColumn("kept", own(F.col("all")))
        at = cut(grown.select("node", F.col("kept").alias("chain"), F.when(F.col("c2").isNotNull() & (F.size("kept") == F.size("all")), F.col("l2")).alias("last")))
    return edges.select("node").distinct().join(at.select("node", "chain"), "node", "left").select("node", F.coalesce("chain", F.array().cast(kind)).alias("chain"))


def root_first(chain: DataFrame) -> DataFrame:
    """Chains from the root on, with the node itself at the end."""
    return chain.select("node", F.concat(F.reverse("chain"), F.array("node")).alias("chain"))


def ancestors(edges: DataFrame, core: int = CORE) -> DataFrame:
    """Distinct (node, ancestor) of nodes with any number of parents (node, parent); a node is not its own ancestor, cycles or not.

    Of more than ``core`` edges, nodes that nobody has as a parent are taken off in layers while that takes a quarter of the edges or more; what is left, cycles and long
    chains too, is searched in pairs. Each layer then takes its parents' ancestors, which travel as a list a node, so the many pairs of the lowest layers are neither
    compared with all pairs nor kept: those of the last one are made as they are read.
    """
    rest = cut(edges.where("parent is not null and parent <> node").select("node", "parent").distinct())
    layers, n = [], rest.count()
    while n > core:
        above = rest.select(F.col("parent").alias("node"), F.lit(True).alias("__above")).distinct()
        both = cut(rest.join(above, "node", "left"))
        m = both.where("__above").count()
        if m > 0.75 * n:
            break
        layers.append((both.where("__above is null").drop("__above"), n - m))
        rest, n = both.where("__above").drop("__above"), m
    found = _pairs(rest)
    if not layers:
        return found
    of = cut(found.groupBy("node").agg(F.collect_list("ancestor").alias("of")))
    while layers:
        low, rows = layers.pop()
        up = low.join(of.select(F.col("node").alias("parent"), "of"), "parent", "left").select("node", F.concat(F.array("parent"), F.coalesce("of", F.array())).alias("of"))
        own = dealt(up, rows, "node", each=EACH).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("of"))).alias("of"))
        of = of.unionByName(cut(own) if layers else own)
    return of.select("node", F.explode("of").alias("ancestor"))


def _pairs(edges: DataFrame) -> DataFrame:
    """(node, ancestor) of distinct (node, parent) without loops.

    Reach doubles each round: pairs at the largest distance so far, and only these, go on by all pairs. A pair at distance d in (r, 2r] has a node at distance r on a
    shortest path, so none is missed, and a pair is met once for each such node, not for each node between.
    """
    seen = edges.select("node", F.col("parent").alias("ancestor")).withColumn("__far", F.lit(True))
    while True:
        on = seen.select(F.col("node").alias("__at"), F.col("ancestor").alias("__to"), "__far")
        step = seen.where("__far").select("node", F.col("ancestor").alias("__at")).join(on, "__at").where(F.col("node") != F.col("__to"))
        # all at the new distance came by two whole reaches; what a shorter way leads to is nearer
        met = step.groupBy("node", F.col("__to").alias("ancestor")).agg(F.min("__far").alias("__far"))
        front = cut(met.join(seen.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if front.isEmpty():
            return seen.select("node", "ancestor")
        seen = seen.withColumn("__far", F.lit(False)).unionByName(front)


def closure(roots: DataFrame, references: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Every id (id) that references (id, ref) lead to from ``roots`` (id), these too; references to ``stop`` (id) are not followed."""
    r = references.select("id", "ref").distinct()
    if stop is not None:
        r = r.join(stop.select(F.col("id").alias("ref")), "ref", "left_anti")
    r, seen = cut(r), cut(roots.select("id").distinct())
    front = seen
    while True:
        front = cut(r.join(front, "id", "left_semi").select(F.col("ref").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def with_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node) with the distinct neighbours that edges (type, src, dst) of either direction lead to, as sorted structs; none is an empty list."""
    both = edges.select(F.col("src").alias("node"), "type", F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), "type", F.col("src").alias("other")))
    near = both.distinct().groupBy("node").agg(F.sort_array(F.collect_set(F.struct("type", "other"))).alias("relations"))
    got = nodes.join(near, "node", "left")
    return got.withColumn("relations", F.coalesce("relations", F.array().cast(dict(near.dtypes)["relations"])))


def with_value(nodes: DataFrame, label: str, key: str, value: str) -> DataFrame:
    """Nodes (label, props: a map) of a label whose property has a value."""
    return nodes.where((F.col("label") == label) & (F.try_element_at("props", F.lit(key)) == value))


def labelled_classes(triples: DataFrame, type_: str = "rdf:type", kind: str = "owl:Class", label: str = "rdfs:label", comment: str = "rdfs:comment") -> DataFrame:
    """Classes with label and comment where there are some, by label."""
    least = lambda p, name: triples.where(F.col("p") == p).groupBy("s").agg(F.min("o").alias(name))
    of = triples.where((F.col("p") == type_) & (F.col("o") == kind)).select("s").distinct()
    return of.join(least(label, "label"), "s", "left").join(least(comment, "comment"), "s", "left").orderBy("label", "s")


def nearest_kept(chain: DataFrame, excluded: DataFrame) -> DataFrame:
    """node and nearest: the node itself or the first of its ancestors that is not excluded; null without any."""
    steps = chain.select("node", F.posexplode(F.concat(F.array("node"), "chain")).alias("d", "x"))
    kept = steps.join(excluded.select(F.col("node").alias("x")).distinct(), "x", "left_anti")
    return chain.select("node").join(kept.groupBy("node").agg(F.min_by("x", "d").alias("nearest")), "node", "left")


def first_kept(edges: DataFrame, excluded: DataFrame) -> DataFrame:
    """As :func:`nearest_kept`, from (node, parent) with a parent each at most, without chains: each node carries only the node that it points at.

    A node points at itself if it is kept, else at its parent; pointers at excluded nodes jump to what those point at, twice as far each round. What still points at
    an excluded node once jumps are longer than there are excluded nodes goes round a cycle, and has none.
    """
    out = excluded.select(F.col("node").alias("__x")).distinct()
    up = edges.groupBy("node").agg(F.min("parent").alias("parent")).join(out, F.col("node") == F.col("__x"), "left")
    own = up.select("node", F.when(F.col("__x").isNull(), F.col("node")).otherwise(F.col("parent")).alias("at"), F.col("__x").isNotNull().alias("out"))
    open_ = own.join(out, F.col("at") == F.col("__x"), "left").select("node", "at", F.col("__x").isNotNull().alias("open"))
    state = cut(open_)
    reach, n = 1, state.where("open").count()
    while n and reach <= 2 * n and not state.where("open").isEmpty():
        to = state.select(F.col("node").alias("at"), F.col("at").alias("__to"), F.col("open").alias("__open"), F.lit(True).alias("__is"))
        moved = state.where("open").join(to, "at", "left")
        # an excluded node without a row has no parent, so nothing is nearest
        jumped = moved.select("node", F.col("__to").alias("at"), F.coalesce("__open", F.lit(False)).alias("open"))
        state, reach = cut(state.where("not open").unionByName(jumped)), reach * 2
    return state.select("node", F.when(~F.col("open"), F.col("at")).alias("nearest"))


def chains_recursive(edges: DataFrame, levels: int = 100) -> DataFrame:
    """As :func:`chains`, by a recursive query of Spark: a step of all chains each round, in one job without written rounds. A chain of over ``levels`` is an error of Spark's; :func:`chains` has no such bound."""
    spark = edges.sparkSession
    e = edges.where("parent is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    kind = f"array<{dict(e.dtypes)['parent']}>"
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(levels))
    try:
        found = cut(spark.sql(
            """WITH RECURSIVE up(node, chain, last) AS (
 SELECT node, array(parent), parent FROM {e} WHERE parent <> node
 UNION ALL SELECT up.node, concat(up.chain, array(p.parent)), p.parent FROM up JOIN {e} p ON p.node = up.last WHERE p.parent <> up.node AND NOT array_contains(up.chain, p.parent))
SELECT node, max_by(chain, size(chain)) AS chain FROM up GROUP BY node""", e=e,
        ))
    finally:
        spark.conf.set("spark.sql.cteRecursionLevelLimit", before)
    return edges.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("chain", F.array().cast(kind)).alias("chain"))


def reachable(start: DataFrame, edges: DataFrame, depth: int, most: int = FRONT) -> DataFrame:
    """Nodes (root, node, depth) within ``depth`` directed steps of each root (root), at their least depth.

    Edges are read once a step as they are, so repeated ones do no harm; those that are costly to make should be cut. New nodes are sent to them as long as there are ``most`` or fewer, and edges are shuffled only beyond.
    """
    seen = front = start.select("root", F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0))
    e = edges.select(F.col("src").alias("node"), F.col("dst"))
    for d in range(1, depth + 1):
        at = front.select("root", "node")
        # of a node's ways, each task keeps one before any is shuffled
        met = e.join(sent(at, most) if depth > 2 else at, "node").select("root", F.col("dst").alias("node")).distinct()
        front = met.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        if depth > 2:
            front = cut(front)
        seen = seen.unionByName(front)
    return seen


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def shortest(edges: DataFrame, root, most: int = 6) -> DataFrame:
    """Least number of hops from ``root`` to each node within ``most``, along edges either way."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(root,)], f"root {dict(edges.dtypes)['src']}")
    e = edges.select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return reachable(start, both, most).select("node", F.col("depth").alias("hops"))


def subgraph(edges: DataFrame, root, hops: int = 2) -> DataFrame:
    """Edges whose ends both lie within ``hops`` of ``root`` and that a path of so many begins with or goes on by."""
    near = shortest(edges, root, hops).where(F.col("hops") < hops).select("node")
    e = edges.select("src", "dst").distinct()
    out = e.join(near.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(e.join(near.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return out.distinct()


def neighbourhood(triples: DataFrame, entity: str) -> DataFrame:
    """Statements about an entity, and those that lead to it."""
    return triples.where((F.col("s") == entity) | (F.col("o") == entity)).distinct()


def instances(triples: DataFrame, kind: str, type_: str = "rdf:type", label: str = "rdfs:label") -> DataFrame:
    """Nodes of a class with their least label, if any."""
    of = triples.where((F.col("p") == type_) & (F.col("o") == kind)).select("s").distinct()
    return of.join(triples.where(F.col("p") == label).groupBy("s").agg(F.min("o").alias("label")), "s", "left")


def relationships(rows: DataFrame) -> DataFrame:
    return rows.select("type", "src", "dst").distinct()


def blank_names(triples: DataFrame) -> DataFrame:
    """node and name of each blank node (s or o with kind bnode): a digest of its sorted statements with other blank nodes unnamed, and a number among equals.

    Work is linear in the statements: no node's name waits for another's.
    """
    hide = lambda c, k: F.when(F.col(k) == "bnode", F.lit("_")).otherwise(F.col(c))
    out = triples.where("s_kind = 'bnode'").select(F.col("s").alias("node"), F.concat_ws(" ", F.lit(">"), "p", hide("o", "o_kind")).alias("t"))
    into = triples.where("o_kind = 'bnode'").select(F.col("o").alias("node"), F.concat_ws(" ", F.lit("<"), hide("s", "s_kind"), "p").alias("t"))
    digest = out.unionByName(into).groupBy("node").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("t"))), 256).alias("d"))
    # nodes are numbered as they were made: by the number at the end of their name, those without one first
    made = F.expr(r"coalesce(try_cast(nullif(regexp_extract(node, '(\\d+)$', 1), '') as decimal(38, 0)), -1)")
    n = F.row_number().over(Window.partitionBy("d").orderBy(made, "node"))
    return digest.select("node", F.concat(F.lit("b"), F.substring("d", 1, 16), F.lit("_"), n.cast("string")).alias("name"))


def seed_nodes(triples: DataFrame, classes: DataFrame, type_: str = "rdf:type") -> DataFrame:
    """Instances of active classes (class) with their first class in order, literal properties as a map and an identifier: the property so called, else the first that ends in Number or Id, else the node."""
    typed = triples.where(F.col("p") == type_).join(classes.select(F.col("class").alias("o")), "o", "left_semi").groupBy("s").agg(F.min("o").alias("class"))
    lits = triples.where("o_kind = 'literal'").groupBy("s", "p").agg(F.min("o").alias("o")).groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "o")))).alias("props"))
    got = typed.join(lits, "s", "left")
    keys = F.filter(F.sort_array(F.map_keys("props")), lambda k: k.rlike("(Number|Id)$"))
    ident = F.coalesce(F.try_element_at("props", F.lit("identifier")), F.try_element_at("props", F.try_element_at(keys, F.lit(1))), F.col("s"))
    return got.withColumn("identifier", ident)


def seed_edges(triples: DataFrame, nodes: DataFrame, object_properties: DataFrame) -> DataFrame:
    """Statements between two nodes by an object property (p)."""
    ends = nodes.select("s")
    e = triples.join(object_properties.select("p"), "p", "left_semi").join(ends, "s", "left_semi")
    return e.join(ends.withColumnRenamed("s", "o"), "o", "left_semi").select(F.col("s").alias("src"), F.col("p").alias("type"), F.col("o").alias("dst")).distinct()
