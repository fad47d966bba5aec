"""Token-ID output: shards of raw ids with a minimal perfect hash index for constant-time access by document key.

A shard is two files. ``.bin`` holds nothing but ids, one after the other, as little-endian unsigned integers. ``.idx``
holds a minimal perfect hash function over the shard's document keys and, in hash order, a 32-bit fingerprint of each key,
its first id and its number of ids; the keys themselves follow in file order, so that a shard can also be scanned.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import blocks, encoder, parts_for, read_file, shared_dir, write_file, written

MAGIC = b"MPHIDX01"
NULL_KEY = np.uint64(0x5BD1E9955BD1E995)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixing of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys in levels of bit arrays.

    At each level the remaining keys are hashed to ``gamma`` slots each; keys alone in their slot settle there and the rest
    go on. A settled key's number is the count of set bits before its own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("the keys of a perfect hash must be distinct")
        sizes, bits, left = [], [], keys.astype(np.uint64)
        while len(left):
            m = -(-max(64, int(gamma * len(left))) // 64) * 64
            slot = (mix(left, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(slot, minlength=m) == 1
            sizes.append(m)
            bits.append(alone)
            left = left[~alone[slot]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        packed = np.packbits(flat, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(flat.reshape(-1, 64).sum(1))]).astype(np.uint32) if len(flat) else np.zeros(1, np.uint32)
        return cls(np.array(sizes, np.int64), packed, ranks)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key from 0, or -1 for a key that settles nowhere (a foreign key may get any number)."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        words = self.bits.view(np.uint64) if len(self.bits) else np.zeros(0, np.uint64)
        for level, m in enumerate(self.sizes):
            if not len(rest):
                break
            at = (mix(keys[rest], level) % np.uint64(m)).astype(np.int64) + self.starts[level]
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = (self.ranks[at >> 6] + below)[hit]
            rest = rest[~hit]
        return out


def keys_of(ids: list[int | None]) -> np.ndarray:
    """Distinct 64-bit keys of document ids; a repeated id gets the key of its next occurrence, a null one of its own kind."""
    null = np.array([i is None for i in ids], bool)
    raw = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
    seen: dict[int | None, int] = {}
    nth = np.zeros(len(ids), np.uint64)
    if len(set(ids)) < len(ids):
        for k, i in enumerate(ids):
            nth[k] = seen.get(i, 0)
            seen[i] = int(nth[k]) + 1
    with np.errstate(over="ignore"):
        return mix(mix(raw, 11) + nth * np.uint64(0xD6E8FEB86659FD93) + np.where(null, NULL_KEY, np.uint64(0)), 12)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 77) >> np.uint64(32)).astype(np.uint32)


def pack_arrays(arrays: dict[str, np.ndarray], **head) -> bytes:
    """Arrays one after the other, behind a head that says where each begins."""
    named = json.dumps(head | {"arrays": [[k, a.dtype.str, len(a)] for k, a in arrays.items()]}).encode()
    return MAGIC + len(named).to_bytes(4, "little") + named + b"".join(a.tobytes() for a in arrays.values())


def pack_index(doc_ids: list[int | None], lengths: list[int], width: int) -> bytes:
    keys = keys_of(doc_ids)
    h = PerfectHash.build(keys)
    at = h(keys)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.uint64) if lengths else np.zeros(0, np.uint64)
    prints, starts, counts = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32)
    prints[at], starts[at], counts[at] = fingerprint(keys), first, np.array(lengths, np.uint32)
    null = np.array([i is None for i in doc_ids], np.uint8)
    ids = np.array([0 if i is None else i for i in doc_ids], np.int64)
    return pack_arrays({"sizes": h.sizes, "bits": h.bits, "ranks": h.ranks, "prints": prints, "starts": starts, "counts": counts, "ids": ids, "null": null}, width=width)


class Index:
    """An index file of which a lookup reads a few numbers each time: the head once, then a bit and a rank for each level tried, and a slot."""

    def __init__(self, path: str):
        self.path = path
        head = read_file(path, 0, 12)
        if head[:8] != MAGIC:
            raise ValueError("not an index file")
        n = int.from_bytes(head[8:12], "little")
        self.head, self.where, at = json.loads(read_file(path, 12, n)), {}, 12 + n
        for name, kind, size in self.head["arrays"]:
            self.where[name] = at, np.dtype(kind), size
            at += size * np.dtype(kind).itemsize
        self.sizes = self.values("sizes", 0, self.where["sizes"][2])

    def values(self, name: str, first: int, n: int = 1) -> np.ndarray:
        at, kind, _ = self.where[name]
        return np.frombuffer(read_file(self.path, at + first * kind.itemsize, n * kind.itemsize), kind)

    def slot(self, key: np.ndarray) -> int | None:
        """Where the values of a key (an array of one) are; None if its fingerprint isn't the one stored there."""
        start = 0
        for level, m in enumerate(self.sizes.tolist()):
            at = int(mix(key, level)[0] % np.uint64(m)) + start
            start += m
            word, bit = self.values("bits", (at >> 6) * 8, 8).view(np.uint64)[0], np.uint64(at & 63)
            if word >> bit & np.uint64(1):
                number = int(self.values("ranks", at >> 6)[0]) + int(np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))))
                return number if self.values("prints", number)[0] == fingerprint(key)[0] else None
        return None


class Corpus:
    """Keyed access to all shards: the directory names a document's shard, the shard's index the place of its ids, which alone are read.

    The number of reads doesn't grow with the corpus, a shard or a text's place in it. Of rows that share an id, :meth:`get` finds the first.
    """

    def __init__(self, folder: str):
        self.folder, self.open = folder, {}
        self.parts = int(json.loads(read_file(f"{folder}/directory.json"))["parts"])

    def _index(self, path: str) -> Index:
        if path not in self.open:
            self.open[path] = Index(path)
        return self.open[path]

    def get(self, doc_id: int | None) -> np.ndarray | None:
        key = keys_of([doc_id])
        part = self._index(f"{self.folder}/directory-{int(key[0] % np.uint64(self.parts))}.idx")
        if (k := part.slot(key)) is None:
            return None
        path = f"{self.folder}/{int(part.values('bucket', k)[0]):06d}-{int(part.values('seq', k)[0]):06d}"
        shard = self._index(f"{path}.idx")
        if (k := shard.slot(key)) is None:
            return None
        width = int(shard.head["width"])
        first, n = int(shard.values("starts", k)[0]), int(shard.values("counts", k)[0])
        return np.frombuffer(read_file(f"{path}.bin", first * width, n * width), f"<u{width}")


def write_directory(shards: DataFrame, rows_each: int = 1_000_000) -> str | None:
    """Writes, beside the shards of :func:`write_shards`, files that map every document key to its shard, and returns their folder (None without shards).

    A file has about ``rows_each`` keys, dealt by the key, and is made by one task. Repeated and null ids are found at their first occurrence.
    """
    n, path = shards.agg(F.sum("n_docs"), F.min("path")).first()
    if path is None:
        return None
    folder, parts = path.rsplit("/", 1)[0], max(1, -(-n // rows_each))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, b, s in zip(*(batch.column(c).to_pylist() for c in ("path", "bucket", "seq")), strict=True):
                index = Index(f"{path}.idx")
                size = index.where["ids"][2]
                ids = [None if z else int(i) for i, z in zip(index.values("ids", 0, size), index.values("null", 0, size), strict=True)]
                k = keys_of(ids)
                own = [pa.array((k % np.uint64(parts)).astype(np.int64)), pa.array(k.view(np.int64)), pa.array(np.full(size, b, np.int32)), pa.array(np.full(size, s, np.int32))]
                yield pa.RecordBatch.from_arrays(own, names=["part", "key", "bucket", "seq"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "bucket", "seq"]).drop_duplicates("key")
        k = pdf["key"].to_numpy(np.int64).view(np.uint64)
        h = PerfectHash.build(k)
        at = h(k)
        arrays = {"sizes": h.sizes, "bits": h.bits, "ranks": h.ranks, "prints": np.zeros(len(k), np.uint32), "bucket": np.zeros(len(k), np.uint32), "seq": np.zeros(len(k), np.uint32)}
        arrays["prints"][at], arrays["bucket"][at], arrays["seq"][at] = fingerprint(k), pdf["bucket"], pdf["seq"]
        write_file(f"{folder}/directory-{int(pdf['part'].iloc[0])}.idx", pack_arrays(arrays))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": [len(k)]})

    named = shards.select("path", "bucket", "seq").mapInArrow(keys, "part long, key long, bucket int, seq int")
    have = {r["part"] for r in named.groupBy("part").applyInPandas(build, "part long, n long").collect()}
    none = PerfectHash.build(np.zeros(0, np.uint64))
    for part in set(range(parts)) - have:  # a part that no key fell into
        write_file(f"{folder}/directory-{part}.idx", pack_arrays({"sizes": none.sizes, "bits": none.bits, "ranks": none.ranks, "prints": np.zeros(0, np.uint32)}))
    write_file(f"{folder}/directory.json", json.dumps({"parts": parts}).encode())
    return folder


class Shard:
    """A whole shard in memory, for looking up all its documents; :class:`Corpus` looks up single ones and reads no more than it needs."""

    def __init__(self, index: bytes, payload: bytes):
        if index[:8] != MAGIC:
            raise ValueError("not an index file")
        n = int.from_bytes(index[8:12], "little")
        head, at = json.loads(index[12 : 12 + n]), 12 + n
        self.arrays = {}
        for name, kind, size in head["arrays"]:
            self.arrays[name] = np.frombuffer(index[at : at + size * np.dtype(kind).itemsize], kind)
            at += size * np.dtype(kind).itemsize
        self.hash = PerfectHash(self.arrays["sizes"], self.arrays["bits"], self.arrays["ranks"])
        self.payload = np.frombuffer(payload, f"<u{head['width']}")
        self.ids = [None if z else int(i) for i, z in zip(self.arrays["ids"], self.arrays["null"], strict=True)]

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id and number of ids of each key, and whether the stored fingerprint is the key's own."""
        at = self.hash(keys)
        if not len(self.arrays["prints"]):
            return at, at, np.zeros(len(keys), bool)
        inside = np.clip(at, 0, None)
        found = (at >= 0) & (self.arrays["prints"][inside] == fingerprint(keys))
        return self.arrays["starts"][inside].astype(np.int64), self.arrays["counts"][inside].astype(np.int64), found

    def get(self, doc_id: int | None) -> np.ndarray | None:
        first, n, found = self.locate(keys_of([doc_id]))
        return self.payload[first[0] : first[0] + n[0]] if found[0] else None


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 1 << 23, rows_each: int = 6000) -> DataFrame:
    """Encodes every text and writes its ids in ascending ``id_col`` order as indexed shards to the shared folder.

    Returns one row per shard: bucket, seq, path (without ending), n_docs, n_ids, and start, the number of ids in all shards
    before it. A null text has only the end id. Rows with a null id come first; rows that share an id stay together in the
    order of their text's first 32 characters, then of a hash of it. No row is dropped; an empty table gives no shard. Other columns of ``docs`` are not read.

    Rows are dealt to even ranges of ids, and of the texts of one id, sorted inside them, and streamed: a task holds one
    shard (``shard_ids`` ids) at most, however many rows a range has, and one id may fill many ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = parts_for(rows, rows_each)
    folder = shared_dir(spark, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        bucket, seq, ids, lengths, held, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            nonlocal seq, ids, lengths, held, total
            path = f"{folder}/{bucket:06d}-{seq:06d}"
            payload = np.frombuffer(b"".join(held), "<u4").astype(f"<u{width}").tobytes()
            write_file(f"{path}.bin", payload)
            write_file(f"{path}.idx", pack_index(ids, lengths, width))
            out = pa.RecordBatch.from_pydict({"bucket": [bucket], "seq": [seq], "path": [path], "n_docs": [len(ids)], "n_ids": [total]}, schema=schema)
            seq, ids, lengths, held, total = seq + 1, [], [], [], 0
            return out

        for batch in blocks(batches):
            encoded = enc(batch.column("text"))
            for i, x in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                if ids and total >= shard_ids:
                    yield flush()
                ids.append(i)
                held.append(x + end)
                lengths.append(len(x) // 4 + 1)
                total += lengths[-1]
        if ids:
            yield flush()

    schema = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    begin = F.substring(F.coalesce("text", F.lit("")), 1, 32)
    dealt = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), begin, F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), begin, F.xxhash64("text"))
    shards = written(dealt.mapInArrow(run, "bucket int, seq int, path string, n_docs long, n_ids long"), "shard-list")
    # one short row per shard of up to shard_ids ids: the list is a millionth of the ids it describes
    start, listed = 0, []
    for r in shards.orderBy("bucket", "seq").toLocalIterator():
        listed.append((*r, start))
        start += r["n_ids"]
    return spark.createDataFrame(listed, "bucket int, seq int, path string, n_docs long, n_ids long, start long")


def read_shards(shards: DataFrame) -> DataFrame:
    """Looks up every document of the shards through their index: doc_id, start, n_tokens, ids_crc32, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(read_file(f"{path}.idx"), read_file(f"{path}.bin"))
                first, n, found = shard.locate(keys_of(shard.ids))
                if not found.all():
                    raise ValueError(f"{path}: a fingerprint differs from its key's")
                crc = [zlib.crc32(shard.payload[a : a + k].astype("<u4").tobytes()) for a, k in zip(first, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids, pa.int64()), pa.array(first + base, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = shards.select("path", "start", "bucket", "seq")
    n = shards.count()
    return listed.repartition(max(1, n)).select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
