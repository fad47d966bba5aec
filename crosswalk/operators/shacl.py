"""Validation of triples against SHACL shapes: every constraint component is one join or aggregate over all shapes that have it.

A shape is a set of values for each focus node: the node itself, or what its path leads to. A table (shape, focus, value) of one depth of nesting is
made from the focus nodes; components judge it; the values of constraints on other shapes are the focus nodes of the next depth, whose
failures come back as a table (shape, focus). The shapes graph, which grows with a model and not with data, is read on the driver; data never is.

Nodes are structs of value, kind (iri, bnode, literal), datatype and lang. Classes are met by instances of subclasses; nothing else is inferred.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswalk.operators.graph import ancestors
from crosswalk.operators.lineage import cut, sent

RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
SH, XSD = "http://www.w3.org/ns/shacl#", "http://www.w3.org/2001/XMLSchema#"
#: triples of a shapes graph that the driver reads
MOST = 200_000
RESULT = ["focus", "path", "value", "component", "shape", "severity"]
#: components of one parameter that a value meets or not, and whether they compare text, numbers or lengths
_LIMITS = {"minInclusive": ">=", "maxInclusive": "<=", "minExclusive": ">", "maxExclusive": "<", "minLength": ">=", "maxLength": "<="}
_SEVERITIES = {SH + "Violation": "error", SH + "Warning": "warning", SH + "Info": "info"}


@dataclass
class Shape:
    name: str
    path: tuple | None = None
    severity: str = "error"
    checks: list[tuple[str, str, str | None]] = field(default_factory=list)
    members: list[tuple[str, int, str]] = field(default_factory=list)
    targets: list[tuple[str, str]] = field(default_factory=list)
    allowed: list[tuple[str, str, str | None]] = field(default_factory=list)
    closed: list[str] | None = None


class ShapeGraph:
    """Shapes by name, from the rows (s, p, o, o_kind, o_datatype, ...) of a shapes graph. A shape that leads to itself is an error."""

    def __init__(self, rows: Iterable):
        self.by: dict[str, dict[str, list]] = {}
        for r in rows:
            self.by.setdefault(r["s"], {}).setdefault(r["p"], []).append(r)
        self.shapes: dict[str, Shape] = {}
        roots = [s for s, ps in self.by.items() if any(r["o"] in (SH + "NodeShape", SH + "PropertyShape") for r in ps.get(RDF + "type", [])) or any(p.startswith(SH + "target") for p in ps)]
        self.level: dict[str, int] = {}
        for s in sorted(roots):
            self._add(s, 0, ())
        self.depth = max(self.level.values(), default=-1) + 1

    def _all(self, s: str, p: str) -> list:
        return sorted(self.by.get(s, {}).get(SH + p, []), key=lambda r: r["o"])

    def _items(self, s: str) -> list:
        out = []
        while s != RDF + "nil":
            own = self.by.get(s, {})
            if RDF + "first" not in own or len(out) > MOST:
                raise ValueError(f"{s}: a list without an end")
            out.append(own[RDF + "first"][0])
            s = own[RDF + "rest"][0]["o"]
        return out

    def path(self, s: str, kind: str = "iri") -> tuple:
        own = self.by.get(s, {})
        if kind == "iri":
            return ("iri", s)
        if RDF + "first" in own:
            return ("sequence", *[self.path(r["o"], r["o_kind"]) for r in self._items(s)])
        for p, name in (("inversePath", "inverse"), ("zeroOrMorePath", "star"), ("oneOrMorePath", "plus"), ("zeroOrOnePath", "option")):
            if SH + p in own:
                r = own[SH + p][0]
                return (name, self.path(r["o"], r["o_kind"]))
        if SH + "alternativePath" in own:
            return ("either", *[self.path(r["o"], r["o_kind"]) for r in self._items(own[SH + "alternativePath"][0]["o"])])
        raise ValueError(f"{s}: no path")

    def _add(self, s: str, level: int, above: tuple[str, ...]) -> bool:
        """Adds a shape and all that it leads to; whether it is active."""
        if s in above:
            raise ValueError(f"{s}: a shape that leads to itself")
        if any(r["o"] == "true" for r in self._all(s, "deactivated")):
            return False
        # a shape is judged after all that lead to it have given their values
        self.level[s] = max(level, self.level.get(s, 0))
        shape = self.shapes.setdefault(s, Shape(s))
        shape.checks, shape.members = [], []
        if path := self._all(s, "path"):
            shape.path = self.path(path[0]["o"], path[0]["o_kind"])
        for r in self._all(s, "severity"):
            shape.severity = _SEVERITIES.get(r["o"], "error")
        types = {r["o"] for r in self.by.get(s, {}).get(RDF + "type", [])}
        shape.targets = [("class", r["o"]) for r in self._all(s, "targetClass")] + [("class", s)] * bool(types & {RDFS + "Class", OWL + "Class"})
        shape.targets += [(k, r["o"]) for p, k in (("targetNode", "node"), ("targetSubjectsOf", "subjects"), ("targetObjectsOf", "objects")) for r in self._all(s, p)]
        for p in ("minCount", "maxCount", "class", "datatype", "nodeKind", "hasValue", "equals", "disjoint", *_LIMITS):
            shape.checks += [(p, r["o"], None) for r in self._all(s, p)]
        flags = "".join(r["o"] for r in self._all(s, "flags"))
        shape.checks += [("pattern", f"(?{flags}){r['o']}" if flags else r["o"], None) for r in self._all(s, "pattern")]
        shape.checks += [("uniqueLang", "true", None) for r in self._all(s, "uniqueLang") if r["o"] == "true"]
        for r in self._all(s, "in"):
            shape.checks.append(("in", r["o"], None))
            shape.allowed = [(x["o"], x["o_kind"], x["o_datatype"]) for x in self._items(r["o"])]
        if any(r["o"] == "true" for r in self._all(s, "closed")):
            also = [x["o"] for r in self._all(s, "ignoredProperties") for x in self._items(r["o"])]
            own = [self.path(x["o"], x["o_kind"]) for r in self._all(s, "property") for x in self._all(r["o"], "path")]
            shape.closed = also + [p[1] for p in own if p[0] == "iri"]
        groups = [(p, [r["o"]]) for p in ("property", "node", "not") for r in self._all(s, p)]
        groups += [(p, [x["o"] for x in self._items(r["o"])]) for p in ("or", "and", "xone") for r in self._all(s, p)]
        for k, (p, names) in enumerate(groups):
            for name in names:
                if self._add(name, self.level[s] + 1, (*above, s)) or p != "property":
                    shape.members.append((p, k, name))
        return True


def _node(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    return F.struct(value.alias("value"), kind.alias("kind"), datatype.alias("datatype"), lang.alias("lang"))


def _text(path: tuple | None) -> str | None:
    """A path as it is written in queries."""
    if path is None:
        return None
    name, *parts = path
    if name == "iri":
        return parts[0]
    inner = [_text(p) for p in parts]
    return {"inverse": f"^{inner[0]}", "star": f"({inner[0]})*", "plus": f"({inner[0]})+", "option": f"({inner[0]})?", "sequence": "/".join(inner), "either": "|".join(inner)}[name]


class Validator:
    """The tables that components join with, made once for the data."""

    def __init__(self, data: DataFrame, graph: ShapeGraph):
        self.spark, self.graph = data.sparkSession, graph
        null = F.lit(None).cast("string")
        lang, kind = (F.col(c) if c in data.columns else null for c in ("o_lang", "s_kind"))
        own = F.coalesce(kind, F.when(F.col("s").startswith("_:"), "bnode").otherwise("iri"))
        # every walk and component reads the edges, so they are made distinct once
        self.edges = cut(data.select(_node(F.col("s"), own, null, null).alias("s"), "p", _node(F.col("o"), F.col("o_kind"), F.col("o_datatype"), lang).alias("o")).distinct())
        named = {c for s in graph.shapes.values() for k, c in s.targets if k == "class"} | {v for s in graph.shapes.values() for c, v, _ in s.checks if c == "class"}
        types = self.edges.where(F.col("p") == RDF + "type").select(F.col("s").alias("node"), F.col("o.value").alias("type"))
        below = ancestors(data.where(F.col("p") == RDFS + "subClassOf").select(F.col("s").alias("node"), F.col("o").alias("parent"))).select(F.col("node").alias("type"), F.col("ancestor").alias("class"))
        wanted = self.table([(c,) for c in sorted(named)], "class string")
        kinds = wanted.select(F.col("class").alias("type"), "class").unionByName(below.join(F.broadcast(wanted), "class").select("type", "class"))
        self.instances = types.join(sent(kinds), "type").select("node", "class").distinct() if named else None

    def table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def targets(self) -> DataFrame:
        """shape and focus of every target of the data."""
        rows = [(s.name, k, v) for s in self.graph.shapes.values() for k, v in s.targets]
        t = self.table(rows, "shape string, how string, of string")
        of = lambda how, key: F.broadcast(t.where(F.col("how") == how).select("shape", F.col("of").alias(key)))
        out = [of("node", "of").select("shape", _node(F.col("of"), F.when(F.col("of").startswith("_:"), "bnode").otherwise("iri"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("focus"))]
        if self.instances is not None:
            out.append(self.instances.join(of("class", "class"), "class").select("shape", F.col("node").alias("focus")))
        out += [self.edges.join(of(how, "p"), "p").select("shape", F.col(end).alias("focus")) for how, end in (("subjects", "s"), ("objects", "o")) if any(k == how for _, k, _ in rows)]
        found = out[0]
        for x in out[1:]:
            found = found.unionByName(x)
        return found.distinct()

    def walk(self, front: DataFrame, path: tuple) -> DataFrame:
        """(shape, focus, at) moved along a path; each way's end once."""
        name, *parts = path
        if name == "iri":
            step = self.edges.where(F.col("p") == parts[0]).select(F.col("s").alias("at"), F.col("o").alias("to"))
            return front.join(step, "at").select("shape", "focus", F.col("to").alias("at"))
        if name == "inverse" and parts[0][0] == "iri":
            step = self.edges.where(F.col("p") == parts[0][1]).select(F.col("o").alias("at"), F.col("s").alias("to"))
            return front.join(step, "at").select("shape", "focus", F.col("to").alias("at"))
        if name == "inverse":
            return self.walk(front, _turned(parts[0]))
        if name == "sequence":
            for p in parts:
                front = self.walk(front, p).distinct()
            return front
        if name == "either":
            out = self.walk(front, parts[0])
            for p in parts[1:]:
                out = out.unionByName(self.walk(front, p))
            return out.distinct()
        if name == "option":
            return front.unionByName(self.walk(front, parts[0])).distinct()
        last = cut((front if name == "star" else self.walk(front, parts[0])).distinct())
        seen = last
        while not last.isEmpty():  # only what is new goes on
            last = cut(self.walk(last, parts[0]).distinct().join(seen, ["shape", "focus", "at"], "left_anti"))
            seen = seen.unionByName(last)
        return seen

    def values(self, focus: DataFrame, shapes: list[Shape]) -> DataFrame:
        """(shape, focus, value): the focus itself without a path; all plain paths in one join, each other path in its own."""
        out = focus.join(F.broadcast(self.table([(s.name,) for s in shapes if s.path is None], "shape string")), "shape").select("shape", "focus", F.col("focus").alias("value"))
        plain = self.table([(s.name, s.path[1]) for s in shapes if s.path and s.path[0] == "iri"], "shape string, p string")
        out = out.unionByName(focus.join(F.broadcast(plain), "shape").join(self.edges.withColumnRenamed("s", "focus"), ["focus", "p"]).select("shape", "focus", F.col("o").alias("value")))
        others: dict[tuple, list[str]] = {}
        for s in shapes:
            if s.path and s.path[0] != "iri":
                others.setdefault(s.path, []).append(s.name)
        for path, names in others.items():
            front = focus.where(F.col("shape").isin(names)).withColumn("at", F.col("focus"))
            out = out.unionByName(self.walk(front, path).distinct().select("shape", "focus", F.col("at").alias("value")))
        return out

    def judged(self, focus: DataFrame, values: DataFrame, shapes: list[Shape]) -> DataFrame:
        """(shape, focus, value, component) of what fails the components that need no other shape; value is null where all values together fail."""
        checks = self.table([(s.name, c, v) for s in shapes for c, v, _ in s.checks], "shape string, component string, of string")
        given = {c for s in shapes for c, _, _ in s.checks}
        has = lambda *names: F.broadcast(checks.where(F.col("component").isin(*names)))
        v, of, out = F.col("value.value"), F.col("of"), []
        keys = ["shape", "focus", "value", "component"]
        single = {
            "datatype": ~((F.col("value.kind") == "literal") & F.col("value.datatype").eqNullSafe(of) & self._wellformed(v, of)),
            "nodeKind": ~F.array_contains(F.split(F.lower(F.regexp_replace(of, "^.*#", "")), "or"), F.when(F.col("value.kind") == "bnode", "blanknode").otherwise(F.col("value.kind"))),
            "pattern": (F.col("value.kind") == "bnode") | ~F.expr("regexp_like(value.value, of)"),
        }
        number = {c: F.expr(f"try_cast(value.value as double) {op} try_cast(of as double)") for c, op in _LIMITS.items() if "Length" not in c}
        length = {c: F.expr(f"value.kind <> 'bnode' and length(value.value) {op} cast(of as int)") for c, op in _LIMITS.items() if "Length" in c}
        single |= {c: ~F.coalesce(x, F.lit(False)) for c, x in (number | length).items()}
        if used := [c for c in single if c in given]:
            test = F.lit(False)
            for c in used:
                test = F.when(F.col("component") == c, single[c]).otherwise(test)
            out.append(values.join(has(*used), "shape").where(test).select(*keys))
        if "class" in given:
            a = values.join(has("class"), "shape").withColumnsRenamed({"value": "node", "of": "class"})
            out.append(a.join(self.instances, ["node", "class"], "left_anti").withColumnRenamed("node", "value").select(*keys))
        if "in" in given:
            allowed = self.table([(s.name, *a) for s in shapes for a in s.allowed], "shape string, __v string, __k string, __d string")
            same = (values["shape"] == allowed["shape"]) & (F.col("value.value") == F.col("__v")) & (F.col("value.kind") == F.col("__k")) & F.col("value.datatype").eqNullSafe(F.col("__d"))
            out.append(values.join(F.broadcast(allowed), same, "left_anti").join(has("in"), "shape").select(*keys))
        if "hasValue" in given:
            ok = values.select("shape", "focus", F.col("value.value").alias("of")).distinct()
            out.append(focus.join(has("hasValue"), "shape").join(ok, ["shape", "focus", "of"], "left_anti").withColumn("value", F.lit(None).cast(values.schema["value"].dataType)).select(*keys))
        if given & {"minCount", "maxCount"}:
            n = values.groupBy("shape", "focus").agg(F.count("*").alias("n"))
            limits = focus.join(has("minCount", "maxCount"), "shape").join(n, ["shape", "focus"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
            bad = F.when(F.col("component") == "minCount", F.col("n") < of.cast("long")).otherwise(F.col("n") > of.cast("long"))
            out.append(limits.where(bad).withColumn("value", F.lit(None).cast(values.schema["value"].dataType)).select(*keys))
        if "uniqueLang" in given:
            twice = values.where("value.lang is not null").groupBy("shape", "focus", "value.lang").agg(F.count("*").alias("n")).where("n > 1")
            out.append(twice.join(has("uniqueLang"), "shape").withColumn("value", F.lit(None).cast(values.schema["value"].dataType)).select(*keys))
        other = self.edges.select(F.col("s").alias("focus"), F.col("p").alias("of"), F.col("o").alias("value"))
        if "equals" in given:
            want = focus.join(has("equals"), "shape").join(other, ["focus", "of"])
            have = values.join(has("equals"), "shape")
            out += [a.join(b.select("shape", "focus", "of", "value"), ["shape", "focus", "of", "value"], "left_anti").select(*keys) for a, b in ((want, have), (have, want))]
        if "disjoint" in given:
            out.append(values.join(has("disjoint"), "shape").join(other, ["focus", "of", "value"], "left_semi").select(*keys))
        if closed := [(s.name, p) for s in shapes if s.closed is not None for p in s.closed or [""]]:
            mine = focus.join(F.broadcast(self.table(sorted({(s, "closed") for s, _ in closed}), "shape string, component string")), "shape").join(self.edges.withColumnRenamed("s", "focus"), "focus")
            out.append(mine.join(F.broadcast(self.table(closed, "shape string, p string")), ["shape", "p"], "left_anti").select("shape", "focus", F.col("o").alias("value"), "component"))
        found = values.where("false").withColumn("component", F.lit("")).select(*keys)
        for x in out:
            found = found.unionByName(x)
        return found.distinct()

    @staticmethod
    def _wellformed(v: Column, datatype: Column) -> Column:
        """Whether a text is one of its datatype, where that is a number, a boolean or a day; others are taken as they are."""
        tests = {"integer": r"^[+-]?\d+$", "int": r"^[+-]?\d+$", "long": r"^[+-]?\d+$", "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$", "double": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$", "boolean": "^(true|false|0|1)$", "date": r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$"}
        out = F.lit(True)
        for name, form in tests.items():
            out = F.when(datatype == XSD + name, v.rlike(form)).otherwise(out)
        return out

    def results(self) -> DataFrame:
        """RESULT rows of every target. Failures inside of or, and, xone, not and node count only there."""
        by_depth = [[s for s in self.graph.shapes.values() if self.graph.level[s.name] == d] for d in range(self.graph.depth)]
        focus = cut(self.targets().withColumn("told", F.lit(True)))
        # what a property shape finds is told there; that it fails its parent matters only where other shapes ask for that
        asks = {m for s in self.graph.shapes.values() for _, _, m in s.members}
        rounds = []
        for shapes in by_depth:  # values, from the targets down
            here = cut(focus.join(F.broadcast(self.table([(s.name,) for s in shapes], "shape string")), "shape").groupBy("shape", "focus").agg(F.bool_or("told").alias("told")))
            values = cut(self.values(here.select("shape", "focus"), shapes))
            members = self.table([(s.name, p, k, m) for s in shapes for p, k, m in s.members], "shape string, component string, k int, member string")
            asked = values.join(F.broadcast(members), "shape")
            rounds.append((shapes, here, values, asked))
            if any(s.members for s in shapes):
                onward = asked.join(here, ["shape", "focus"]).select(F.col("member").alias("shape"), F.col("value").alias("focus"), (F.col("told") & (F.col("component") == "property")).alias("told"))
                focus = focus.unionByName(cut(onward))
        failed = out = None
        for shapes, here, values, asked in reversed(rounds):  # failures, from the innermost up
            found = self.judged(here.select("shape", "focus"), values, shapes)
            if failed is not None and any(s.members for s in shapes):
                bad = failed.select(F.col("shape").alias("member"), F.col("focus").alias("value"), F.lit(1).alias("bad"))
                kept = asked.where((F.col("component") != "property") | F.col("shape").isin(*[s.name for s in shapes if s.name in asks]))
                n = kept.join(bad, ["member", "value"], "left").groupBy("shape", "focus", "value", "component", "k").agg(F.count("*").alias("n"), F.count("bad").alias("bad"))
                c, ok = F.col("component"), F.col("n") - F.col("bad")
                fails = F.when(c == "or", ok == 0).when(c == "xone", ok != 1).when(c == "not", F.col("bad") == 0).otherwise(F.col("bad") > 0)
                found = found.unionByName(n.where(fails).select("shape", "focus", "value", "component").distinct())
            found = cut(found)
            own = found.select("shape", "focus").distinct()
            failed = own if failed is None else failed.unionByName(own)
            told = found.where("component <> 'property'").join(here.where("told").select("shape", "focus"), ["shape", "focus"])
            out = told if out is None else out.unionByName(told)
        about = self.table([(s.name, _text(s.path), s.severity) for s in self.graph.shapes.values()], "shape string, path string, severity string")
        if out is None:
            return self.table([], ", ".join(f"{c} string" for c in RESULT))
        return out.join(F.broadcast(about), "shape").select(F.col("focus.value").alias("focus"), "path", F.col("value.value").alias("value"), "component", "shape", "severity")


def _turned(path: tuple) -> tuple:
    """The path that leads back along ``path``."""
    name, *parts = path
    if name == "iri":
        return ("inverse", path)
    if name == "inverse":
        return parts[0]
    turned = [_turned(p) for p in parts]
    return (name, *(reversed(turned) if name == "sequence" else turned))


def validate(data: DataFrame, shapes: DataFrame) -> DataFrame:
    """What of ``data`` (s, p, o, o_kind, o_datatype, and if there: s_kind, o_lang) breaks the shapes of the triples ``shapes``, which are in the same form.

    A row for each failing value, with a null value where all values of a focus node fail together: focus, path, value, component (the
    parameter's name), shape and severity (error, warning or info). Deactivated shapes don't count. Shapes that lead to themselves and shapes graphs of over ``MOST`` triples are refused.
    """
    rows = shapes.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} triples of shapes")
    return Validator(data, ShapeGraph(rows)).results()
