"""RDF files as a table of triples: Turtle and N-Triples, read whole by a parser of their grammar."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TRIPLE = "graph string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')"""
    r"""|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*\w)"""
    r"""|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%\\/~-](?:[\w:.%\\~-]*[\w:%\\~-])?)?)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _text(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), s)


class Turtle:
    """Triples of a Turtle document: prefixes, a, ; and , lists, nested blank nodes, collections, typed and language literals."""

    def __init__(self, text: str, graph: str):
        self.graph, self.prefixes, self.base, self.n = graph, {}, "", 0
        self.salt = hashlib.sha1(graph.encode()).hexdigest()[:8]
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"{graph}: cannot read {text[at : at + 40]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.out = 0, []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end" or value is not None and t[1] != value:
            raise ValueError(f"{self.graph}: expected {value or 'more'}, found {t[1]!r}")
        self.at += 1
        return t

    def blank(self) -> tuple[str, str]:
        self.n += 1
        return f"_:{self.salt}n{self.n}", "bnode"

    def iri(self, token: tuple[str, str]) -> str:
        kind, s = token
        if kind == "iri":
            s = _text(s[1:-1])
            return s if re.match(r"[A-Za-z][\w+.-]*:", s) else self.base + s
        prefix, _, local = s.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"{self.graph}: no prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def add(self, s, p: str, o) -> None:
        self.out.append((self.graph, *s, p, *o, *(None,) * (4 - len(o))))

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, s = self.peek()
            low = s.lower()
            if low in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1][:-1]
                self.prefixes[name] = self.iri(self.take())
                self.stop(low[0] == "@")
            elif low in ("@base", "base"):
                self.take()
                self.base = self.iri(self.take())
                self.stop(low[0] == "@")
            else:
                nested = s == "["
                subject = self.node()
                if not (nested and self.peek()[1] == "."):
                    self.properties(subject)
                self.take(".")
        return self.out

    def stop(self, dotted: bool) -> None:
        if dotted:
            self.take(".")

    def properties(self, subject) -> None:
        while True:
            kind, s = self.take()
            p = RDF + "type" if (kind, s) == ("word", "a") else self.iri((kind, s))
            while True:
                self.add(subject, p, self.node())
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                more = True
                if self.peek()[1] in (";", ".", "]"):
                    more = False
                    continue
                break
            else:
                return
            if not more:
                return

    def node(self):
        kind, s = self.take()
        if kind in ("iri", "name"):
            return self.iri((kind, s)), "iri"
        if kind == "blank":
            return f"_:{self.salt}{s[2:]}", "bnode"
        if s == "[":
            b = self.blank()
            if self.peek()[1] != "]":
                self.properties(b)
            self.take("]")
            return b
        if s == "(":
            head = last = None
            while self.peek()[1] != ")":
                item, b = self.node(), self.blank()
                if last is None:
                    head = b
                else:
                    self.add(last, RDF + "rest", b)
                self.add(b, RDF + "first", item)
                last = b
            self.take(")")
            nil = (RDF + "nil", "iri")
            if last is None:
                return nil
            self.add(last, RDF + "rest", nil)
            return head
        if kind in ("text", "long"):
            value = _text(s[3:-3] if kind == "long" else s[1:-1])
            if self.peek()[0] == "lang":
                return value, "literal", RDF + "langString", self.take()[1][1:].lower()
            if self.peek()[0] == "type":
                self.take()
                return value, "literal", self.iri(self.take()), None
            return value, "literal", XSD + "string", None
        if kind == "num":
            return s, "literal", XSD + ("double" if "e" in s.lower() else "decimal" if "." in s else "integer"), None
        if kind == "word" and s in ("true", "false"):
            return s, "literal", XSD + "boolean", None
        raise ValueError(f"{self.graph}: unexpected {s!r}")


def triples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Distinct triples of Turtle or N-Triples files; each is read whole by one task. Blank nodes are named apart for each file."""
    files = spark.read.text(paths, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("graph"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in TRIPLE.split(", ")]
        for pdf in batches:
            for text, graph in zip(pdf["value"], pdf["graph"], strict=True):
                yield pd.DataFrame(Turtle(text.removeprefix("﻿"), graph).parse(), columns=names)

    return files.mapInPandas(run, TRIPLE).dropDuplicates()


def frames(batches: Iterator[pd.DataFrame], text: str, graph: str, read: Callable[[str, str], Iterable[tuple]], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """What ``read`` gives for each text that isn't null, ``rows`` triples at a time: those of small texts together, those of a large one apart."""
    names, part = [x.split()[0] for x in TRIPLE.split(", ")], []
    for pdf in batches:
        for x, g in zip(pdf[text], pdf[graph], strict=True):
            for t in read(x, g) if x is not None else ():
                part.append(t)
                if len(part) == rows:
                    yield pd.DataFrame(part, columns=names)
                    part = []
    if part:
        yield pd.DataFrame(part, columns=names)


def parse_column(texts: DataFrame, text: str = "text", graph: str = "graph") -> DataFrame:
    """Distinct triples of Turtle texts, one a row, each with the name of its graph; blank nodes are named apart for each. A null text has none."""
    return texts.select(text, graph).mapInPandas(lambda batches: frames(batches, text, graph, lambda x, g: Turtle(x, g).parse()), TRIPLE).dropDuplicates()


#: a statement of N-Triples: subject, predicate, object
_STATEMENT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s.]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Distinct triples of N-Triples files by lines, in the JVM, so that one file is read by many tasks. Comments and empty lines are passed over; another line that is no statement is an error.

    Blank nodes are named apart for each file. Escapes are those of JSON strings; \\U with eight digits stays as it is written.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("graph")).where("line <> '' and not startswith(line, '#')")
    part = lambda k: F.regexp_extract("line", _STATEMENT, k)
    fits = F.when(F.col("line").rlike(_STATEMENT), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("no statement: "), F.substring("line", 1, 80))))
    t = lines.withColumn("line", fits).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), "graph")
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    blank = lambda c: F.concat(c, F.lit("_"), F.substring(F.md5("graph"), 1, 8))
    quoted = F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1)
    value = F.get(F.from_json(F.concat(F.lit('["'), quoted, F.lit('"]')), "array<string>"), 0)
    literal, lang = F.col("o").startswith('"'), F.lower(F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1))
    kind = lambda c: F.when(c.startswith("_:"), "bnode").when(c.startswith('"'), "literal").otherwise("iri")
    type_ = F.when(~literal, None).when(lang != "", RDF + "langString").otherwise(F.coalesce(F.nullif(F.regexp_extract("o", r'"\^\^<([^>]*)>$', 1), F.lit("")), F.lit(XSD + "string")))
    node = lambda c: F.when(c.startswith("_:"), blank(c)).otherwise(bare(c))
    got = {"s": node(F.col("s")), "s_kind": kind(F.col("s")), "p": F.col("p"), "o": F.when(literal, F.coalesce(value, quoted)).otherwise(node(F.col("o"))), "o_kind": kind(F.col("o")), "o_datatype": type_, "o_lang": F.nullif(lang, F.lit("")), "graph": F.col("graph")}
    return t.select(*[got[f.split()[0]].cast("string").alias(f.split()[0]) for f in TRIPLE.split(", ")]).distinct()


def manifest_graphs(t: DataFrame, manifest: DataFrame) -> DataFrame:
    """Triples of the graphs that a manifest (path, role) lists, with their role, but for aggregates: these repeat the others."""
    m = manifest.where("role <> 'aggregate'").select(F.col("path").alias("__path"), "role")
    named = t.withColumn("__path", F.regexp_extract("graph", r"([^/]+)$", 1))
    m = m.withColumn("__path", F.regexp_extract("__path", r"([^/]+)$", 1)).dropDuplicates(["__path"])
    return named.join(m, "__path").drop("__path")


def of_role(t: DataFrame, role: str) -> DataFrame:
    """Triples of the graphs whose declarations give them a role: shapes, vocab, seed-data or ontology."""
    return t.join(file_roles(t).where(F.col("role") == role).select("graph"), "graph", "left_semi")


def parse_text(spark: SparkSession, text: str, graph: str = "inline") -> DataFrame:
    return spark.createDataFrame(sorted(set(Turtle(text, graph).parse()), key=repr), TRIPLE)


def file_roles(t: DataFrame) -> DataFrame:
    """Role of each graph by what it declares: aggregate, shapes, vocab, seed-data, ontology or unknown."""
    owl, sh, skos = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/ns/shacl#", "http://www.w3.org/2004/02/skos/core#"
    typed, named = F.col("p") == RDF + "type", F.col("s_kind") == "iri"
    schema = [owl + x for x in ("Class", "ObjectProperty", "DatatypeProperty", "Ontology", "AnnotationProperty")] + [sh + "NodeShape", sh + "PropertyShape", skos + "ConceptScheme", skos + "Concept"]
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    f = t.groupBy("graph").agg(
        has(typed & named & (F.col("o") == owl + "Class")).alias("cls"), has(typed & named & F.col("o").isin(owl + "ObjectProperty", owl + "DatatypeProperty")).alias("prop"),
        has(typed & (F.col("o") == sh + "NodeShape")).alias("shape"), has(typed & (F.col("o") == skos + "ConceptScheme")).alias("scheme"),
        has(F.col("p") == owl + "imports").alias("imports"), has(typed & named & (F.col("o_kind") == "iri") & ~F.col("o").isin(schema)).alias("inst"),
    )
    cls, prop, shape, scheme = F.col("cls"), F.col("prop"), F.col("shape"), F.col("scheme")
    role = F.when(F.col("imports") & ~cls & ~prop & ~shape, "aggregate").when(shape & ~cls, "shapes").when(scheme & ~cls, "vocab").when(F.col("inst") & ~cls & ~shape, "seed-data").when(cls | prop, "ontology").when(scheme, "vocab").otherwise("unknown")
    return f.select("graph", role.alias("role"))
