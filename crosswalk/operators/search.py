"""Exact vector search, score floors, mutual neighbours and ranked text search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: queries of a block that are multiplied at once
_AT_ONCE = 256


def embedding_text(ident: Column, label: Column, definition: Column, context: Column) -> Column:
    """Label, or else the id, then definition and context, without the empty ones."""
    nz = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(". ", F.coalesce(nz(label), ident), nz(definition), nz(context))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(queries: DataFrame, targets: DataFrame, k: int, eligible: Column | None = None, query_block: int = 2048, digits: int = 6, target_block: int = 8192) -> DataFrame:
    """q, t, score and rank of the ``k`` best targets of every query, by inner product, ties by target id.

    ``queries`` and ``targets`` have id and vec; ``eligible`` is a condition on targets and is met before ranks are given. Queries are taken in blocks of
    ``query_block`` and targets in blocks of ``target_block``; every two blocks meet in a task, which holds no more than these, and pass the ``k`` best of each query on;
    the best of these are ranked. Scores are rounded to ``digits``. Rows with a null vector are in no result.
    """
    chosen = (targets.where(eligible) if eligible is not None else targets).where("vec is not null and id is not null").select(F.col("id").alias("t"), F.col("vec").alias("tv"))
    asked = queries.where("vec is not null and id is not null").select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    kinds = {c: t for c, t in (*asked.dtypes, *chosen.dtypes)}
    # each block of queries meets each block of targets as a pair of groups, and a task holds one pair at a time
    many = lambda n, size: max(1, -(-n // size))
    nb, np_ = many(asked.count(), query_block), many(chosen.count(), target_block)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("b", block("q", nb)).withColumn("p", every(np_))
    right = chosen.withColumn("p", block("t", np_)).withColumn("b", every(nb))

    def best(qs: pa.Table, ts: pa.Table) -> pa.Table:
        qi, ti, parts = np.asarray(qs["q"]), np.asarray(ts["t"]), []
        if len(qi) and len(ti):
            by_id = np.argsort(ti, kind="stable")
            ti = ti[by_id]
            tm = np.stack([np.asarray(v.values, float) for v in ts["tv"]])[by_id].T
            qm = np.stack([np.asarray(v.values, float) for v in qs["qv"]])
            for at in range(0, len(qi), _AT_ONCE):
                s = np.round(qm[at : at + _AT_ONCE] @ tm, digits)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                parts.append((np.repeat(qi[at : at + _AT_ONCE], top.shape[1]), ti[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [qi[:0], ti[:0], np.zeros(0)]
        return pa.table([pa.array(cols[0], type=qs.schema.field("q").type), pa.array(cols[1], type=ts.schema.field("t").type), pa.array(cols[2])], names=["q", "t", "score"])

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInArrow(best, f"q {kinds['q']}, t {kinds['t']}, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "t")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score_floor(found: DataFrame, ratio: float) -> DataFrame:
    """Keeps scores of ``ratio`` times the query's best or more; all of a query whose best is not above 0."""
    top = F.max("score").over(Window.partitionBy("q"))
    return found.withColumn("__top", top).where((F.col("__top") <= 0) | (F.col("score") >= F.col("__top") * ratio)).drop("__top")


def mutual(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Pairs that are each other's best, with the mean of both scores."""
    a = forward.where("rank = 1").select(F.col("q").alias("a"), F.col("t").alias("b"), F.col("score").alias("s1"))
    b = reverse.where("rank = 1").select(F.col("q").alias("b"), F.col("t").alias("a"), F.col("score").alias("s2"))
    return a.join(b, ["a", "b"]).select("a", "b", F.round((F.col("s1") + F.col("s2")) / 2, 6).alias("score"))


def number_duplicates(rows: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """Adds display: ' [n]' after names that occur more than once in a group, in order."""
    w = Window.partitionBy(*group, name)
    n = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("display", F.when(F.count("*").over(w) > 1, F.concat(F.col(name), F.lit(" ["), n.cast("string"), F.lit("]"))).otherwise(F.col(name)))


def match_rank(query: str, qname: Column, local: Column, definition: Column) -> Column:
    """0 equal local name, 1 its start, 2 part of the qualified name, 3 part of the definition, else null; case does not count and nothing is a wildcard."""
    q = query.lower()
    return F.when(F.lower(local) == q, 0).when(F.lower(local).startswith(q), 1).when(F.lower(qname).contains(q), 2).when(F.lower(definition).contains(q), 3)


def search_catalog(rows: DataFrame, query: str, limit: int = 20, namespace: str | None = None) -> DataFrame:
    """The best ``limit`` rows (qname, local, definition, pos) by match rank, then by their position in the catalog."""
    kept = rows.where(F.col("qname").startswith(namespace + ":")) if namespace else rows
    ranked = kept.withColumn("match", match_rank(query, F.col("qname"), F.col("local"), F.col("definition"))).where("match is not null")
    return ranked.orderBy("match", "pos").limit(limit)


def find_concept(names: DataFrame, ref: str) -> DataFrame:
    """Rows (name) that a reference means: the equal one, else those that end in it, else those that do in any case; kind says which."""
    kind = F.when(F.col("name") == ref, 1).when(F.col("name").endswith(ref), 2).when(F.lower("name").endswith(ref.lower()), 3)
    found = names.withColumn("kind", kind).where("kind is not null")
    return found.join(found.agg(F.min("kind").alias("least")), F.col("kind") == F.col("least")).drop("least")


def resolve_concept(names: DataFrame, refs: DataFrame) -> DataFrame:
    """References (ref) with the one name (name) that each means: the equal one; else the only one that ends in it; else the only one that does in any case. Null where there is none or more than one."""
    local = lambda c: F.substring_index(c, ":", -1)
    n, r = names.select("name").distinct(), refs.select("ref").distinct()
    only = lambda key, ask: n.groupBy(key.alias("__key")).agg(F.min("name").alias("__name"), F.count("*").alias("__n")).join(r.select("ref", ask.alias("__key")), "__key").where("__n = 1").select("ref", "__name")
    equal = r.join(n, F.col("ref") == F.col("name")).select("ref", F.col("name").alias("equal"))
    ends = only(local(F.col("name")), F.col("ref")).withColumnRenamed("__name", "ends")
    folded = only(F.lower(local(F.col("name"))), F.lower("ref")).withColumnRenamed("__name", "folded")
    return refs.join(equal, "ref", "left").join(ends, "ref", "left").join(folded, "ref", "left").withColumn("name", F.coalesce("equal", "ends", "folded")).drop("equal", "ends", "folded")


def sample_two_thirds(rows: DataFrame, is_type, ident: str, n: int, seed: int = 42, offset: int = 0) -> DataFrame:
    """``n`` rows, two thirds of them (rounded down) types and the rest others, in the order of a hash of their id and ``seed``; ``offset`` rows are passed over in the same shares."""
    types, passed = n * 2 // 3, offset * 2 // 3
    w = Window.partitionBy(F.coalesce(is_type, F.lit(False))).orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(ident).cast("string"))), ident)
    at = rows.withColumn("__type", F.coalesce(is_type, F.lit(False))).withColumn("place", F.row_number().over(w))
    lo, most = F.when(F.col("__type"), passed).otherwise(offset - passed), F.when(F.col("__type"), types).otherwise(n - types)
    return at.where((F.col("place") > lo) & (F.col("place") <= lo + most)).drop("__type")


def stratified(rows: DataFrame, stratum: str, ident: str, n: int) -> DataFrame:
    """``n`` rows of each stratum in the order of a hash of their id."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.col(ident).cast("string")), ident)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
