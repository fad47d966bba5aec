"""Exact k-means over integer vectors; the nearest centroid is found by annulus search.

A vector's distance to a centroid is at least the difference of their norms. Centroids are sorted by norm. The distance to the one whose
norm lies nearest is an upper bound for the nearest of all, so only centroids whose norm differs from the vector's by no more than that bound can be as
near: a ring around the origin, whose two ends binary search finds among the sorted norms. The bound is then lowered in turns: the
centroid next in difference of norms is compared exactly, and the ring shrinks to the best distance so far. Centroids on the ring's edge, which may tie,
are compared too. All sums and distances are 64-bit integers; norms are compared with a margin above their rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: components beyond this size are taken as this size, so that squared distances of up to 64 components fit 63 bits
LARGEST = 1 << 27
#: margin of a norm difference, above the rounding of two square roots and a sum
MARGIN = 1e-6
ROWS = 8192


def integers(embeddings: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have exactly ``dims`` components, none null or non-finite, and floor(scale * x) of those vectors' components."""
    c = pyarrow.compute
    whole = c.fill_null(c.equal(c.list_value_length(embeddings), dims), False).to_numpy(zero_copy_only=False)
    values = embeddings.filter(pa.array(whole)).flatten()
    # a null becomes a component that isn't finite
    x = c.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = np.isfinite(x).all(1)
    whole[whole] = fine
    return whole, np.clip(np.floor(np.clip(x[fine], -LARGEST, LARGEST) * scale), -LARGEST, LARGEST).astype(np.int64)


class Rings:
    """Centroids by ascending norm, and by ascending number where norms are equal."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(float) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.centroids, self.norms = centroids[self.order], norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of every vector, the smallest number of equally near ones; its squared distance; and how many pairs were compared."""
        n, k = len(x), len(self.norms)
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        at = np.searchsorted(self.norms, norm)
        low, high = np.maximum(at - 1, 0), np.minimum(at, k - 1)
        guess = np.where(norm - self.norms[low] <= self.norms[high] - norm, low, high)
        best = ((x - self.centroids[guess]) ** 2).sum(1)
        number, compared = self.order[guess], n
        # the ring of the first bound; then outward from the vector's own norm on either side, while the ring, which shrinks, holds the next one
        bound = np.sqrt(best.astype(float)) * (1 + 1e-12) + MARGIN
        ends = np.searchsorted(self.norms, norm - bound, "left"), np.searchsorted(self.norms, norm + bound, "right")
        for step, start, stop in ((-1, at - 1, ends[0] - 1), (1, at, ends[1])):
            rows, c, stop = np.arange(n), start.copy(), stop.copy()
            while True:
                open_ = c < stop if step > 0 else c > stop
                rows, c, stop = rows[open_], c[open_], stop[open_]
                if not len(rows):
                    break
                inside = np.abs(self.norms[c] - norm[rows]) <= np.sqrt(best[rows].astype(float)) * (1 + 1e-12) + MARGIN
                rows, c, stop = rows[inside], c[inside], stop[inside]
                d = ((x[rows] - self.centroids[c]) ** 2).sum(1)
                compared += len(rows)
                own = self.order[c]
                better = (d < best[rows]) | ((d == best[rows]) & (own < number[rows]))
                best[rows[better]], number[rows[better]] = d[better], own[better]
                c = c + step
        return number, best, compared


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            whole, x = integers(b.column("embedding"), dims, scale)
            yield b.filter(pa.array(whole)), x


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: int, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """The ``k`` kept vectors with the smallest sha256 of ``seed:id``, in ascending order; null ids come last, and rows that share an id by their components."""
    x, v = _rows(vectors, id_col, vector_col), F.col("embedding")
    kept = x.where((F.size(v) == dims) & F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf"))))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = kept.orderBy(hashed.asc_nulls_last(), v).limit(k).select("embedding").toArrow().column(0).combine_chunks()
    return integers(got, dims, scale)[1]


def partial_sums(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """cluster, j, total: sums of component ``j`` over each cluster's vectors; their number where j is -1, their distances where it is -2.

    A task adds up its own vectors, so at most clusters times components are shuffled for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings, k = Rings(centroids), len(centroids)
        sums = np.zeros((k, dims + 2), np.int64)
        for _, x in _blocks(batches, dims, scale):
            near, d, _ = rings.nearest(x)
            order = np.argsort(near, kind="stable")
            own, first = np.unique(near[order], return_index=True)
            if len(own):
                sums[own, 2:] += np.add.reduceat(x[order], first)
                sums[own, 1] += np.diff([*first, len(x)])
                sums[own, 0] += np.add.reduceat(d[order], first)
        c, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array((j - 2).astype(np.int32)), pa.array(sums[c, j])], names=["cluster", "j", "total"])

    parts = _rows(vectors, id_col, vector_col).mapInArrow(run, "cluster int, j int, total long")
    return parts.groupBy("cluster", "j").agg(F.sum("total").alias("total"))


def _sums(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: int, id_col: str, vector_col: str) -> np.ndarray:
    sums = np.zeros((len(centroids), dims + 2), np.int64)
    got = partial_sums(vectors, centroids, dims, scale, id_col, vector_col).toArrow()
    sums[got["cluster"].to_numpy(), got["j"].to_numpy() + 2] = got["total"].to_numpy()
    return sums


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Centroids after ``rounds`` rounds. Only clusters times components numbers reach the driver in each.

    A cluster without vectors keeps its centroid. Fewer than ``k`` kept vectors give as many centroids; none gives none.
    """
    if dims > 64:
        raise ValueError("squared distances fit 63 bits for up to 64 components")
    centroids = first_centroids(vectors, k, dims, scale, seed, id_col, vector_col)
    for _ in range(rounds if len(centroids) else 0):
        sums = _sums(vectors, centroids, dims, scale, id_col, vector_col)
        full = sums[:, 1] > 0
        centroids[full] = sums[full, 2:] // sums[full, 1:2]
    return centroids


def clustered(vectors: DataFrame, centroids: np.ndarray, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Vectors of another length and those with a null or non-finite component are left out. Repeated and null ids keep their rows;
    components beyond ``LARGEST`` count as that; other columns are not read, whatever their names. Without kept vectors there are no rows.
    """
    sums = _sums(vectors, centroids, dims, scale, id_col, vector_col) if len(centroids) else np.zeros((0, dims + 2), np.int64)
    inertia, total = sums[:, 0], int(sums[:, 0].sum())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = Rings(centroids)
        for b, x in _blocks(batches, dims, scale):
            if not len(centroids):
                continue
            near, d, _ = rings.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(d), pa.array(inertia[near]), pa.array(np.full(len(x), total)), pa.array(digests, pa.string()).take(pa.array(near))],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return _rows(vectors, id_col, vector_col).mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same by comparing every vector with every centroid, a common table for each round."""
    steps = [
        f"""v as materialized (select vec_id, embedding, list_transform(embedding, lambda a: floor({scale} * a::double)::bigint) as x from embeddings
 where len(embedding) = {dims} and len(list_filter(embedding, lambda a: a is not null and isfinite(a))) = {dims})""",
        f"""c0 as materialized (select (row_number() over (order by h, embedding) - 1)::int as c, x from (select sha256('{seed}:' || vec_id) as h, embedding, x from v order by h, embedding limit {k}))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select vec_id, x, arg_min(c, (d, c)) as c, min(d) as d from (
 select v.rowid_ as r, vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from (select *, row_number() over () as rowid_ from v) v, c{r}) group by r, vec_id, x)""")
        if r < rounds:
            steps.append(f"""m{r} as (select c, list(s order by j) as x from (select c, j, floor_div as s from (
 select c, j, (sum(e) - ((sum(e) % count(*) + count(*)) % count(*))) // count(*) as floor_div from (select c, unnest(x) as e, generate_subscripts(x, 1) as j from a{r}) group by c, j)) group by c)""")
            steps.append(f"c{r + 1} as materialized (select c{r}.c, coalesce(list_transform(m{r}.x, lambda e: e::bigint), c{r}.x) as x from c{r} left join m{r} on c{r}.c = m{r}.c)")
    return f"""with {", ".join(steps)}
select vec_id, a.c as cluster, d as distance, sum(d) over (partition by a.c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, sha256(array_to_string(f.x, ',')) as centroid_sha256
from a{rounds} a join c{rounds} f on a.c = f.c"""
