"""Quality classifier: random Fourier features of document statistics, ridge regression and isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of the whole text. The normal equations are sums
over rows, so each partition adds up its own and only those sums meet. Isotonic regression over held-back rows turns the
ridge score into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from crosswalk.llm.common import blocks, column, with_row, written

_CLASS = np.full(256, 9)
for _k, _own in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 13), (10,), b".", b",;:", b"!?", b"|/\\<>=_~^`", range(128, 256))):
    for _b in _own:
        _CLASS[_b] = _k
for _b in b"#$%&*@+-":
    _CLASS[_b] = 10
for _b in b"'\"()[]{}":
    _CLASS[_b] = 11
N_STATS = 27


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text: its size, shares of kinds of bytes, and how its words and lines repeat. All finite, 0 without text."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    n = max(1, len(raw))
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=12) / n
    ws, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, ws), np.int32, len(ws))
    w, k = max(1, len(ws)), max(1, len(lines))
    counts = Counter(ws)
    distinct, often = len(counts), max(counts.values(), default=0)
    same = sum(a == b for a, b in zip(ws, ws[1:]))
    widths = np.fromiter(map(len, lines), np.int32, len(lines))
    letters = kinds[0] + kinds[1] + kinds[9]
    return [
        math.log1p(len(raw)), math.log1p(len(ws)), *kinds.tolist(),
        float(sizes.mean()) if len(ws) else 0.0, float(sizes.std()) if len(ws) else 0.0, distinct / w, math.log1p(w) - math.log1p(distinct), same / w, often / w,
        len(set(lines)) / k, math.log1p(len(lines)), math.log1p(float(widths.mean())) if len(lines) else 0.0, float(widths.std() / (1 + widths.mean())) if len(lines) else 0.0,
        float(kinds[1] / letters) if letters else 0.0, len(lines) / w, float((kinds[5] + kinds[6] + kinds[7]) * n / w),
    ]


@dataclass
class Model:
    """mean and scale standardise statistics; frequencies and phases make the features; weights score them; steps calibrate."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.cos(z @ self.frequencies + self.phases) * math.sqrt(2 / len(self.phases))
        return np.concatenate([f, z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rising values of the pooled means of sums ``y`` over ``n`` rows at ascending ``x``, each shrunk by half a row of either class."""
    done: list[list[float]] = []
    for a, s, m in zip(x, y, n, strict=True):
        done.append([a * m, s, m])
        while len(done) > 1 and done[-2][1] * done[-1][2] >= done[-1][1] * done[-2][2]:
            last = done.pop()
            done[-1] = [p + q for p, q in zip(done[-1], last, strict=True)]
    at = np.array([a / m for a, _, m in done])
    return at, np.maximum.accumulate(np.array([(s + 0.5) / (m + 1) for _, s, m in done]))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x (the statistics of the whole text) of every row."""
    cols, text = with_row(docs, id_col, text_col, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            x = pa.array([statistics(t) for t in batch.column(text).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], names=["doc_id", "x"])

    return cols.mapInArrow(run, StructType([cols.schema["doc_id"]]).add("x", ArrayType(DoubleType())))


def _summed(rows: DataFrame, sums, size: int, fans: tuple[int, ...] = (256, 16)) -> np.ndarray | None:
    """Adds up what ``sums(x, y)`` gives for blocks of rows: inside each partition, then in as many groups as each of ``fans`` says, then here."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x = np.array(b.column("x").to_pylist(), dtype=float).reshape(-1, N_STATS)
                s = sums(x, b.column("y").to_numpy(zero_copy_only=False).astype(float))
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]}, schema=pa.schema([("s", pa.binary())]))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["s"].iloc[0]) // 8)
        for s in pdf["s"]:
            total += np.frombuffer(s)
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "s": [total.tobytes()]})

    parts = rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(part, "s binary")
    parts = parts.withColumn("g", F.spark_partition_id())
    for fan in fans:
        parts = parts.withColumn("g", F.pmod("g", F.lit(fan)).cast("int")).groupBy("g").applyInPandas(group, "g int, s binary")
    got = parts.collect()
    return np.sum([np.frombuffer(r["s"]) for r in got], axis=0).reshape(size) if got else None


def fit(rows: DataFrame, features: int = 256, width: float = 6.0, ridge: float = 1e-3, seed: int = 5, bins: int = 2000) -> Model:
    """Fits to rows of x and y (0 or 1; others are left out) with doc_id, by which a fifth is held back for calibration.

    ``width``: of the Gaussian kernel, in standard deviations. Without usable rows every score is 0; with rows of one class only, their share.
    """
    rows = rows.where("y is not null and x is not null").select("doc_id", "x", (F.col("y") > 0).cast("int").alias("y"))
    back = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(5)) == 0
    m = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), (2 * N_STATS + 1,))
    rng = np.random.default_rng(seed)
    n = m[0] if m is not None else 0
    mean = m[1 : N_STATS + 1] / n if n else np.zeros(N_STATS)
    var = m[N_STATS + 1 :] / n - mean**2 if n else np.ones(N_STATS)
    model = Model(mean, np.where(var > 1e-12, np.sqrt(np.maximum(var, 1e-12)), 1.0), rng.normal(size=(N_STATS, features)) / width, rng.uniform(0, 2 * math.pi, features), np.zeros(features + N_STATS + 1), np.zeros(1), np.zeros(1))
    if not n:
        return model
    d = len(model.weights)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    s = _summed(rows.where(~back), normal, (d * d + d + 1,))
    if s is not None:
        model.weights = np.linalg.solve(s[: d * d].reshape(d, d) + ridge * s[-1] / d * np.eye(d), s[d * d : -1])
    lo, hi = -0.5, 1.5

    def counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        r = np.clip(model.raw(x), lo, hi)
        at = np.minimum(((r - lo) / (hi - lo) * bins).astype(int), bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, weights=y, minlength=bins), np.bincount(at, weights=r, minlength=bins)])

    s = _summed(rows.where(back), counts, (3, bins))
    s = _summed(rows, counts, (3, bins)) if s is None else s
    some = s[0] > 0
    model.knots, model.values = isotonic((s[2] / np.maximum(s[0], 1))[some], s[1][some], s[0][some])
    return model


def labelled(measured_rows: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Measured rows with y, the label of their id where ``usable`` (a condition on doc_id) holds. The highest of several labels counts; null ones don't."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").where(usable)
    return measured_rows.select("doc_id", "x").join(known.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id")


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on) in place of x."""
    schema = StructType([f for f in rows.schema.fields if f.name != "x"]).add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, N_STATS)
            p = np.concatenate([model.probability(model.raw(x[a : a + 4096])) for a in range(0, len(x), 4096)] or [np.zeros(0)])
            rest = batch.drop_columns(["x"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*rest.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def score_rows(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and the struct row of every row, whose statistics are taken in the same pass."""
    cols, text = with_row(docs, id_col, text_col, True)
    schema = StructType(list(cols.schema.fields)).add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            x = np.array([statistics(t) for t in column(batch, text).to_pylist()])
            p = model.probability(model.raw(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return cols.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, usable, carry: bool = False) -> DataFrame:
    """Scores of every document by a model fitted to its usable labels. Statistics are taken once and written; with ``carry``, taken
    again as the rows are scored, so that texts are not written beside them."""
    rows = written(measured(docs), "statistics")
    model = fit(labelled(rows, labels, usable))
    return score_rows(docs, model) if carry else score(rows, model)
