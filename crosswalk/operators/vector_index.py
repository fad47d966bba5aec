"""Exact vector search that skips what can't be among the best: targets lie in cells with bounds, and a query meets only the cells that its bounds leave.

A cell has a centre, the greatest distance and angle of its targets from that, and their least and greatest norm. These bound the inner product of a
query with any of its targets from above. A query first meets the cells of the highest bounds that hold ``k`` targets; its ``k``-th score there is a floor, and of
the other cells it meets those whose bound reaches the floor. Both times queries are joined with targets by cell, as blocks of rows, and scored as
matrix products. Results are those of scoring every pair, which :func:`crosswalk.operators.search.top_k` does with less to do besides: cells pay where vectors
come in clusters, as embeddings of text do; where they point everywhere, bounds leave all cells in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswalk.operators.lineage import cut

#: greatest number of cells, whose centres every task gets; targets of a pack, which is one row; queries of a block
CELLS, PACK, BLOCK = 4096, 8192, 2048


@dataclass
class Index:
    """Packs of targets (cell, ts) and, by cell, the centre, the number of targets and the bounds."""

    packs: DataFrame
    kind: str
    centres: np.ndarray
    n: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and cell a number that no inner product with a target of the cell exceeds, but for rounding."""
        norm = np.linalg.norm(q, axis=1)[:, None]
        by_centre = q @ self.centres.T
        by_distance = by_centre + norm * self.radius * (1 + 1e-9)
        with np.errstate(all="ignore"):
            cosine = np.clip(by_centre / (norm * np.linalg.norm(self.centres, axis=1)), -1, 1)
        least = np.cos(np.maximum(np.arccos(np.nan_to_num(cosine, nan=1.0)) - self.angle, 0))
        by_angle = norm * np.where(least > 0, self.high, self.low) * least
        return np.minimum(by_distance, by_angle)


def _matrix(v: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(v.flatten(), float).reshape(-1, dims)


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("vec is not null and id is not null").select("id", F.col("vec").cast("array<double>").alias("vec"))


def build(targets: DataFrame, cells: int | None = None) -> Index:
    """An index of ``targets`` (id, vec); rows with a null id or vector are left out. ``cells``: the root of their number, up to ``CELLS``.

    Centres are the targets that come first in the order of a hash; each target goes to the centre nearest in angle. All vectors must be of one length.
    """
    chosen = _usable(targets)
    kind = dict(chosen.dtypes)["id"]
    count = chosen.count()
    k = min(CELLS, max(1, cells or math.isqrt(count)))
    first = chosen.orderBy(F.xxhash64("id"), "id").limit(k).toArrow()
    centres = np.array(first["vec"].to_pylist(), float).reshape(len(first), -1) if len(first) else np.zeros((0, 1))
    dims = centres.shape[1]
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"), dims)
            own = (x @ unit.T).argmax(1)
            c, norm = centres[own], np.linalg.norm(x, axis=1)
            with np.errstate(all="ignore"):
                cosine = np.nan_to_num((x * unit[own]).sum(1) / norm, nan=1.0)
            # angles and distances are rounded up, so bounds hold in spite of rounding
            angle = np.arccos(np.clip(cosine, -1, 1)) + 1e-7
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(own.astype(np.int32)), pa.array(np.linalg.norm(x - c, axis=1) + 1e-9), pa.array(angle), pa.array(norm)], names=["t", "tv", "cell", "distance", "angle", "norm"])

    placed = chosen.mapInArrow(place, f"t {kind}, tv array<double>, cell int, distance double, angle double, norm double")
    # a cell of any size is many rows, so no task holds a whole one
    pack = F.pmod(F.xxhash64("t"), F.lit(max(1, -(-count // (PACK // 2)))))
    packs = cut(placed.groupBy("cell", pack.alias("pack")).agg(F.collect_list(F.struct("t", "tv")).alias("ts"), F.count("*").alias("n"), F.max("distance").alias("radius"), F.max("angle").alias("angle"), F.min("norm").alias("low"), F.max("norm").alias("high")))
    return _index(packs, kind, centres)


def _index(packs: DataFrame, kind: str, centres: np.ndarray) -> Index:
    stats = packs.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("angle").alias("angle"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    full = {c: np.zeros(len(centres)) for c in ("n", "radius", "angle", "low", "high")}
    for c, x in full.items():
        x[stats["cell"].to_numpy(int)] = stats[c].to_numpy(float)
    return Index(packs, kind, centres, **full)


def save(index: Index, path: str) -> None:
    """Writes an index to a folder: its packs, and its centres by cell."""
    spark = index.packs.sparkSession
    index.packs.write.mode("overwrite").parquet(f"{path}/packs")
    spark.createDataFrame([(k, c) for k, c in enumerate(index.centres.tolist())], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")


def load(spark: SparkSession, path: str) -> Index:
    packs = spark.read.parquet(f"{path}/packs")
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").limit(CELLS).toArrow()
    return _index(packs, packs.select(F.col("ts")[0]["t"].alias("t")).dtypes[0][1], np.array(centres["centre"].to_pylist(), float))


def _met(index: Index, bounds: np.ndarray, k: int) -> np.ndarray:
    """Which cells a query meets first: those of the highest bounds that hold ``k`` targets together."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    before = np.cumsum(index.n[order], axis=1) - index.n[order]
    met = np.zeros(bounds.shape, bool)
    np.put_along_axis(met, order, before < k, axis=1)
    return met & (index.n > 0)


def _blocks(index: Index, queries: DataFrame, k: int, margin: float, block: int = BLOCK) -> DataFrame:
    """(cell, qs): queries (q, qv) in blocks for each cell that they meet; first, or where they have a floor, next."""
    kind, dims, later = dict(queries.dtypes)["q"], index.centres.shape[1], "floor" in queries.columns
    bare = Index(None, index.kind, index.centres, index.n, index.radius, index.angle, index.low, index.high)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                b = batch.slice(at, block)
                bounds = bare.bounds(_matrix(b.column("qv"), dims))
                met = _met(bare, bounds, k)
                if later:
                    floor = b.column("floor").to_numpy(zero_copy_only=False).astype(float)
                    met = ~met & (bare.n > 0) & (bounds >= np.nan_to_num(floor, nan=-np.inf)[:, None] - margin)
                for cell in np.flatnonzero(met.any(0)).tolist():
                    rows = pa.array(np.flatnonzero(met[:, cell]))
                    qs = pa.StructArray.from_arrays([b.column("q").take(rows), b.column("qv").take(rows)], names=["q", "qv"])
                    yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), qs)], names=["cell", "qs"])

    return queries.mapInArrow(deal, f"cell int, qs array<struct<q {kind}, qv array<double>>>")


def _scored(index: Index, blocks: DataFrame, k: int, digits: int) -> DataFrame:
    """q, t and score: of each pack the ``k`` best of every query that meets it."""
    kind, dims = blocks.schema["qs"].dataType.elementType["q"].dataType.simpleString(), index.centres.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qs, ts in zip(batch.column("qs"), batch.column("ts"), strict=True):
                q, t = qs.values, ts.values
                ids = np.asarray(t.field("t"))
                by_id = np.argsort(ids, kind="stable")
                s = np.round((_matrix(q.field("qv"), dims) @ _matrix(t.field("tv"), dims).T)[:, by_id], digits)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                n = top.shape[1]
                yield pa.RecordBatch.from_arrays([q.field("q").take(pa.array(np.repeat(np.arange(len(q)), n))), t.field("t").take(pa.array(by_id[top].ravel())), pa.array(np.take_along_axis(s, top, 1).ravel())], names=["q", "t", "score"])

    return blocks.join(index.packs, "cell").select("qs", "ts").mapInArrow(best, f"q {kind}, t {index.kind}, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "t"))).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """q, t, score and rank of the ``k`` best targets of every query (id, vec) by inner product, ties by target id; scores are rounded to ``digits``."""
    asked = _usable(queries).select(F.col("id").alias("q"), F.col("vec").alias("qv"))
    if not len(index.centres):
        return asked.select("q", F.lit(None).cast(index.kind).alias("t"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("rank")).where("false")
    margin = 10.0**-digits
    first = cut(_ranked(_scored(index, _blocks(index, asked, k, margin, block), k, digits), k).drop("rank"))
    floor = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    more = _scored(index, _blocks(index, asked.join(floor, "q"), k, margin, block), k, digits)
    return _ranked(first.unionByName(more), k)


def share(index: Index, queries: DataFrame, k: int, digits: int = 6) -> float:
    """The part of all pairs of queries and targets that :func:`search` scores."""
    asked = cut(_usable(queries).select(F.col("id").alias("q"), F.col("vec").alias("qv")))
    margin = 10.0**-digits
    first = _ranked(_scored(index, _blocks(index, asked, k, margin), k, digits), k)
    floor = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    met = _blocks(index, asked, k, margin).unionByName(_blocks(index, asked.join(floor, "q"), k, margin))
    pairs = met.groupBy("cell").agg(F.sum(F.size("qs")).alias("asked")).toPandas()
    return float((pairs["asked"] * index.n[pairs["cell"]]).sum() / max(1.0, asked.count() * index.n.sum()))
