"""Mixing sources to target weights: token totals are raked to source, language and topic shares, then documents are sampled.

Raking (iterative proportional fitting) scales the cells of a contingency table to one marginal after the other until all hold.
It works on one row per combination of values that occurs; documents only look their cell up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = ("source", "lang", "topic")
#: a text's topic is the first of these whose pattern it has, else prose
TOPICS = (("legal", r"(?i)licen[sc]e"), ("table", r" \| "), ("contact", r"@|https?://"))
#: target share of a value: its share of the tokens to this power, made to add up to 1
POWERS = {"source": 0.9, "lang": 0.9, "topic": 0.95}
STEPS, BUDGET, MOST_CELLS = 20, 0.85, 1_000_000


def topic(text: Column) -> Column:
    out = None
    for name, pattern in TOPICS:
        hit = text.rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("prose"))


def tokens(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cells_of(docs: DataFrame, text_col: str = "text", topic_of: Column | None = None) -> DataFrame:
    """The rows as the struct row, with __source, __lang, __topic (``topic_of``, or else :func:`topic`) and __tokens; a null of the three is the value '' and a null text is empty."""
    text, some = F.coalesce(F.col(text_col).cast("string"), F.lit("")), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), some(F.col("source")).alias("__source"), some(F.col("lang")).alias("__lang"), (topic(text) if topic_of is None else some(topic_of)).alias("__topic"), tokens(text).alias("__tokens"))


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], steps: int = STEPS) -> np.ndarray:
    """Token totals of the cells, scaled to the target shares of each dimension in turn, ``steps`` times over.

    ``cells``: a column for each dimension, and tokens. A value without a target keeps its total's share; one whose total is 0 stays so.
    """
    w = cells["tokens"].to_numpy(float)
    total = w.sum()
    codes = {d: pd.factorize(cells[d]) for d in targets}
    goals = {}
    for d, (at, names) in codes.items():
        have = np.bincount(at, w, len(names))
        goal = np.array([targets[d].get(n, np.nan) for n in names]) * total
        goals[d] = np.where(np.isnan(goal), have, goal)
    for _ in range(steps):
        for d, (at, names) in codes.items():
            have = np.bincount(at, w, len(names))
            w = w * np.divide(goals[d], have, out=np.zeros(len(names)), where=have > 0)[at]
    return w


def tempered(cells: pd.DataFrame, powers: dict[str, float]) -> dict[str, dict[str, float]]:
    """Target shares: the shares of the tokens to a power for each dimension, made to add up to 1."""
    out = {}
    for d, p in powers.items():
        s = cells.groupby(d)["tokens"].sum().astype(float)
        s = (s[s > 0] / s.sum()) ** p
        out[d] = (s / s.sum()).to_dict()
    return out


def probabilities(tokens_: np.ndarray, raked: np.ndarray, budget: float) -> np.ndarray:
    """Inclusion probability of each cell's documents, in proportion to raked over actual tokens, 1 at most.

    Cells that reach 1 are fixed there and the rest scaled up, until ``budget`` of all tokens is expected. A cell without tokens has 1.
    """
    ratio = np.divide(raked, tokens_, out=np.zeros(len(raked)), where=tokens_ > 0)
    p, full = np.where(tokens_ > 0, 0.0, 1.0), np.zeros(len(ratio), bool)
    goal = budget * tokens_.sum()
    while True:
        rest = ~full & (tokens_ > 0)
        have = (tokens_ * ratio)[rest].sum()
        scale = (goal - tokens_[full].sum()) / have if have > 0 else 0.0
        over = rest & (ratio * scale >= 1)
        p = np.where(rest, np.minimum(1.0, ratio * scale), p)
        if not over.any():
            return p
        full |= over
        p[full] = 1.0


def uniform(id_col: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / float(1 << 48)


ADDED = ("__source", "__lang", "__topic", "__tokens", "__weight", "__probability", "__sampled")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` and those that :func:`mixed_rows` adds; a column of ``docs`` named like one of these gives way to it."""
    return mixed_rows(docs, **options).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def mixed_rows(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, steps: int = STEPS, id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None) -> DataFrame:
    """Every row as the struct row, with __source, __lang, __topic, __tokens, __weight (raked over actual share of its cell), __probability and __sampled.

    ``topic_of``: a column of ``docs``, such as a classifier's class; :func:`topic`, a rule on the text, in its absence.
    Without ``targets`` they are :func:`tempered` by ``POWERS``. The same id is always sampled alike, repeated rows too; an empty table gives none. More than a million
    combinations of source, language and topic are refused: the table of cells is held on the driver and sent to every task.
    """
    rows = cells_of(docs, text_col, topic_of)
    found = rows.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMS]).agg(F.sum("__tokens").alias("tokens")).limit(MOST_CELLS + 1).toPandas()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of source, language and topic")
    found = found.sort_values(list(DIMS), ignore_index=True)
    if len(found):
        raked = rake(found, targets or tempered(found, POWERS), steps)
        n = found["tokens"].to_numpy(float)
        found["weight"] = np.divide(raked, n, out=np.ones(len(n)), where=n > 0)
        found["probability"] = probabilities(n, raked, budget)
    spark = docs.sparkSession
    kinds = "__source string, __lang string, __topic string, __weight double, __probability double"
    cells = spark.createDataFrame([tuple(r) for r in found[[*DIMS, "weight", "probability"]].itertuples(index=False)] if len(found) else [], kinds)
    out = rows.join(F.broadcast(cells), ["__source", "__lang", "__topic"], "left")
    return out.withColumn("__sampled", uniform(F.col("row").getField(id_col)) < F.col("__probability"))


def select_mixed(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns."""
    return mixed_rows(docs, **options).where("__sampled").select("row.*")


def sql(steps: int = STEPS, budget: float = BUDGET) -> str:
    """The same over the table documents, as DuckDB SQL."""
    cases = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    out = [
        f"""WITH rows AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {cases} ELSE 'prose' END AS topic,
 len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM rows GROUP BY ALL)"""
    ]
    for d, p in POWERS.items():
        out.append(f"t_{d} AS (SELECT {d}, s / sum(s) OVER () AS goal FROM (SELECT {d}, pow(sum(n) / (SELECT sum(n) FROM c), {p}) AS s FROM c GROUP BY {d} HAVING sum(n) > 0))")
    goals = " ".join(f"LEFT JOIN t_{d} USING ({d})" for d in POWERS)
    out.append("w0 AS MATERIALIZED (SELECT c.*, " + ", ".join(f"coalesce(t_{d}.goal, 0) * (SELECT sum(n) FROM c) AS g_{d}" for d in POWERS) + f", n AS w FROM c {goals})")
    k = 0
    for _ in range(steps):
        for d in POWERS:
            out.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * g_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM w{k})")
            k += 1
    out.append(f"p0 AS (SELECT *, CASE WHEN n > 0 THEN w / n ELSE 1 END AS ratio, {budget} * sum(n) OVER () AS goal, false AS done FROM w{k})")
    for j in range(8):
        out.append(f"p{j + 1} AS MATERIALIZED (SELECT * REPLACE (done OR (n > 0 AND ratio * (goal - coalesce(sum(n) FILTER (done) OVER (), 0)) / nullif(sum(n * ratio) FILTER (NOT done) OVER (), 0) >= 1) AS done) FROM p{j})")
    out.append("p AS (SELECT *, CASE WHEN done OR n = 0 THEN 1 ELSE least(1, ratio * (goal - coalesce(sum(n) FILTER (done) OVER (), 0)) / nullif(sum(n * ratio) FILTER (NOT done) OVER (), 0)) END AS probability FROM p8)")
    return ",\n".join(out) + (
        "\nSELECT doc_id, source, lang, topic, n_tokens, round(ratio, 6) AS weight, round(probability, 6) AS probability,"
        " ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < probability AS sampled FROM rows JOIN p USING (source, lang, topic)"
    )
