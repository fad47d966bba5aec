"""Near-duplicate documents: MinHash bands find candidates, odd sketches sift them, full shingle sets confirm links.

Documents with equal shingle sets form a class; one of each goes on. Classes that agree in a band of MinHash values meet,
and an odd sketch of each (its MinHash samples folded into a bitmap of parities) tells which of them may be alike: the bits
in which two sketches differ count the samples in which they do. What may be alike is joined to groups of candidates, whose
full sets are made again from the texts and compared. Neither step gives all pairs: each gives edges that span what it links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import KEPT, blocks, claim, words, written
from crosswalk.llm.components import components, in_blocks, map_groups

ROWS, BANDS = 4, 32
BITS = 1024
SIFT = 0.5
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        x = (x ^ (x >> np.uint64(28))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(32))


class Shingles:
    """Sorted distinct 64-bit hashes of the word shingles of texts; keeps the hashes of words it has met."""

    def __init__(self, size: int = 5, keep: int = 1_000_000):
        self.size, self.keep, self.known = size, keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        ws = words(text)
        if not ws:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


_SHINGLES: dict[int, Shingles] = {}


KEPT["shingles"] = _SHINGLES.clear


def shingles(size: int) -> Shingles:
    claim("shingles")
    return _SHINGLES.setdefault(size, Shingles(size))


def min_hashes(s: np.ndarray) -> np.ndarray:
    """The least value of the set under each hash function."""
    out = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            x = s[at : at + 2048, None] * _MULTIPLIERS
            out = np.minimum(out, (x ^ (x >> np.uint64(29))).min(0))
    return out


def bands(m: np.ndarray) -> np.ndarray:
    """One 64-bit key of each band."""
    x = m.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + x[:, k])
    return key


def odd_sketch(m: np.ndarray) -> bytes:
    """Parities of how many samples (function and value) fall on each of ``BITS`` bits."""
    with np.errstate(over="ignore"):
        at = _mixed(m + np.arange(1, len(m) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS) & 1).tobytes()


def likeness(differ: np.ndarray | float, k: int = ROWS * BANDS) -> np.ndarray:
    """Similarity estimated from the number of bits in which two odd sketches differ."""
    share = np.minimum(2 * np.asarray(differ, float) / BITS, 1 - 1e-9)
    return 1 + BITS / (4 * k) * np.log1p(-share)


def most_bits(similarity: float, k: int = ROWS * BANDS) -> int:
    """The number of differing bits from which an estimate is below ``similarity``."""
    return int(BITS / 2 * (1 - math.exp(-4 * k / BITS * (1 - similarity))))


def signatures(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: doc_id, n_shingles, digest of the set, keys of the bands and odd sketch (these null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shingles(size)
        for batch in blocks(batches):
            n, digest, keys, sketch = [], [], [], []
            for x in batch.column("text").to_pylist():
                s = make(x)
                n.append(len(s))
                m = min_hashes(s) if len(s) else None
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(bands(m).view(np.int64) if len(s) else None)
                sketch.append(odd_sketch(m) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n_shingles", "digest", "keys", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary")


def _spanning(ids: np.ndarray, near) -> list[tuple[int, int]]:
    """Edges that span the groups in which ``near(i, others)`` (a mask) links rows; each row is compared with what no link has reached yet."""
    left, edges = np.arange(len(ids)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit]
            edges += [(int(ids[i]), int(ids[j])) for j in found]
            queue += found.tolist()
            left = left[~hit]
    return edges


def _sift(group: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    x = np.frombuffer(b"".join(group["sketch"]), np.uint64).reshape(len(group["rep"]), -1)
    most = most_bits(SIFT)
    return _spanning(group["rep"], lambda i, o: np.bitwise_count(x[o] ^ x[i]).sum(1) <= most)


def _confirm(threshold: int):
    def run(group: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(s, np.uint64) for s in group["set"]]
        n = np.array([len(s) for s in sets])
        x = np.frombuffer(b"".join(group["sketch"]), np.uint64).reshape(len(sets), -1)
        most = most_bits(SIFT)

        def near(i: int, o: np.ndarray) -> np.ndarray:
            hit = (np.minimum(n[o], n[i]) * 100 >= threshold * np.maximum(n[o], n[i])) & (np.bitwise_count(x[o] ^ x[i]).sum(1) <= most)
            for k in np.flatnonzero(hit):
                both = len(np.intersect1d(sets[i], sets[o[k]], assume_unique=True))
                hit[k] = 100 * both >= threshold * (n[i] + n[o[k]] - both)
            return hit

        return _spanning(group["rep"], near)

    return run


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text", block: int = 4000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked if 100 * intersection >= ``threshold`` * union of their sets of ``size``-word shingles (a shorter
    text is one shingle). component_id is the smallest id that links lead to; kept says whether that is the document's own, so
    of rows that share an id all or none are kept. A text without words has an empty set and is linked with nothing. A row
    without id keeps null as component, is linked with nothing and kept.

    32 bands of 4 values miss a pair of similarity 0.75 five times in a million, and a pair of 0.8 three in a hundred million.
    The sketch passes over pairs that it estimates below 0.5, more than five standard deviations under the threshold. Groups of more than
    ``block`` rows are compared in pairs of blocks, each in a task of its own.
    """
    sig = written(signatures(docs, size, id_col, text_col), "signatures")
    usable = sig.where("doc_id is not null and digest is not null")
    classes = written(usable.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys"), F.min_by("sketch", "doc_id").alias("sketch")), "classes")
    # rows may share an id and differ in text: their classes are one component
    split = usable.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1")
    met = classes.select("rep", F.explode("keys").alias("key"))
    crowded = written(met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    met = met.join(crowded.select("key"), "key").join(classes.select("rep", "sketch"), "rep").select("key", "rep", "sketch")
    groups = components(map_groups(in_blocks(met, "key", "rep", crowded, block), ["key", "g1", "g2"], _sift))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shingles(size)
        for batch in blocks(batches):
            s = [make(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("component"), pa.array([odd_sketch(min_hashes(x)) for x in s], pa.binary()), pa.array([x.tobytes() for x in s], pa.binary())], names=["rep", "component", "sketch", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    full = texts.join(groups.withColumnRenamed("node", "rep"), "rep").mapInArrow(sets, "rep long, component long, sketch binary, set binary")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    links = map_groups(in_blocks(full, "component", "rep", sizes, block // 4), ["component", "g1", "g2"], _confirm(threshold))
    same = usable.join(split, "doc_id").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(same))
    of = classes.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "digest").join(of, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
