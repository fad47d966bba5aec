"""Best-fit packing of token sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import blocks, encoder, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text and then ``end_id``, cut into pieces of ``capacity`` only where there are more.

    Returns doc_id, piece (from 0), start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and at, a number that no
    other piece has: its partition's and its own in there, so it stays within 63 bits. A null text has the end id alone; null and repeated ids keep their rows; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in blocks(batches):
            out: list[tuple] = []
            for doc, x in zip(batch.column("doc_id").to_pylist(), enc(batch.column("text")), strict=True):
                x += end
                for k, at in enumerate(range(0, len(x), 4 * capacity)):
                    part = x[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32()] + [pa.int64()] * 3
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES).withColumn("at", F.monotonically_increasing_id())


class _Bins:
    """Bins by free space, and the items that lie in them; a bit of ``open_`` is set where some bin has that much free.

    ``ones`` and ``twos`` have, by free space, a bit for each length of an item, and of two items together, of some bin with that much free.
    """

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free = capacity, [], []
        self.by_free: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.open_ = 0
        self.sums: dict[int, tuple[int, int]] = {}
        self.ones: dict[int, int] = {}
        self.twos: dict[int, int] = {}

    def _link(self, b: int) -> None:
        f = self.free[b]
        self.by_free[f].add(b)
        self.open_ |= 1 << f

    def _unlink(self, b: int) -> None:
        f = self.free[b]
        self.by_free[f].discard(b)
        if not self.by_free[f]:
            self.open_ &= ~(1 << f)

    def _changed(self, b: int, *free: int) -> None:
        self.sums.pop(b, None)
        for f in free:
            self.ones.pop(f, None)
            self.twos.pop(f, None)

    def best(self, n: int) -> int | None:
        """A free space of ``n`` or the least above it that some bin has."""
        rest = self.open_ >> n
        return n + (rest & -rest).bit_length() - 1 if rest else None

    def new(self) -> int:
        self.items.append([])
        self.free.append(self.capacity)
        self._link(len(self.free) - 1)
        return len(self.free) - 1

    def put(self, b: int, item: int, n: int) -> None:
        self._unlink(b)
        self.items[b].append(item)
        self.free[b] -= n
        self._link(b)
        self._changed(b, self.free[b], self.free[b] + n)

    def take(self, b: int, item: int, n: int) -> None:
        self._unlink(b)
        self.items[b].remove(item)
        self.free[b] += n
        self._link(b)
        self._changed(b, self.free[b], self.free[b] - n)

    def lengths_at(self, f: int, lengths: list[int]) -> tuple[int, int]:
        if f not in self.ones:
            one = two = 0
            for b in self.by_free[f]:
                if b not in self.sums:
                    own, pairs = 0, 0
                    for y in self.items[b]:
                        pairs |= own << lengths[y]
                        own |= 1 << lengths[y]
                    self.sums[b] = own, pairs
                one |= self.sums[b][0]
                two |= self.sums[b][1]
            self.ones[f], self.twos[f] = one, two
        return self.ones[f], self.twos[f]


def _fill(bins: _Bins, lengths: list[int]) -> None:
    """Best fit, longest first."""
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        f = bins.best(lengths[i])
        b = bins.new() if f is None else min(bins.by_free[f])
        bins.put(b, i, lengths[i])


def _exchange(bins: _Bins, lengths: list[int], n: int, most: int) -> tuple[int, int, bool] | None:
    """The exchange that fills up a bin most when an item of ``n`` comes for one or two shorter ones: its gain, that bin's free space and whether it is two.

    All bins with less than ``most`` free are looked at, by the lengths they hold.
    """
    found, rest = None, bins.open_ & ((1 << most) - 1) & ~1
    while rest:
        f = rest.bit_length() - 1  # the most room first, as it allows the largest gain
        rest &= ~(1 << f)
        if found and f <= found[0]:
            break
        low = max(n - f, 1)
        for two, lies in enumerate(bins.lengths_at(f, lengths)):
            window = (lies >> low) & ((1 << (n - low)) - 1) if n > low else 0
            if window:
                gain = n - (low + (window & -window).bit_length() - 1)
                if not found or gain > found[0]:
                    found = gain, f, bool(two)
    return found


def _partners(bins: _Bins, lengths: list[int], f: int, total: int, two: bool) -> tuple[int, list[int]]:
    """The bin with ``f`` free, and one or two of its items, of ``total`` length together."""
    for b in sorted(bins.by_free[f]):
        at: dict[int, int] = {}
        for y in bins.items[b]:
            if not two and lengths[y] == total:
                return b, [y]
            if two and total - lengths[y] in at:
                return b, [at[total - lengths[y]], y]
            at.setdefault(lengths[y], y)
    raise AssertionError("no such items")


def _improve(bins: _Bins, lengths: list[int]) -> bool:
    """One round of exchanges into underfull bins; each makes the sum of squared fills larger. True if any was made.

    Bins are taken from the emptiest on. A document of such a bin moves to a fuller bin with room; or takes the place of one
    shorter document there, or of two: the fuller bin fills up, the emptier one gets emptier, and a bin that runs empty is gone.
    """
    changed = False
    for a in sorted((b for b in range(len(bins.free)) if bins.items[b] and bins.free[b]), key=lambda b: -bins.free[b]):
        for x in sorted(bins.items[a], key=lambda i: -lengths[i]):
            n = lengths[x]
            f = bins.best(n)
            if f is not None and f < bins.free[a]:
                b = min(bins.by_free[f])
                bins.take(a, x, n)
                bins.put(b, x, n)
                changed = True
            elif found := _exchange(bins, lengths, n, bins.free[a]):
                gain, f, two = found
                b, pick = _partners(bins, lengths, f, n - gain, two)
                bins.take(a, x, n)
                for y in pick:
                    bins.take(b, y, lengths[y])
                bins.put(b, x, n)
                for y in pick:
                    bins.put(a, y, lengths[y])
                changed = True
    return changed


def pack(lengths: list[int], capacity: int, rounds: int | None = None) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, none longer than ``capacity``: best fit, then local search until no exchange helps.

    Where the bins are as few as the total length allows, none can run empty and no exchange is sought. ``rounds``: stop after so many. Bins are numbered from the emptiest.
    """
    bins = _Bins(capacity)
    _fill(bins, lengths)
    least = -(-sum(lengths) // capacity)
    done = 0
    while done != rounds and sum(map(bool, bins.items)) > least and _improve(bins, lengths):
        done += 1
    where, offset = [0] * len(lengths), [0] * len(lengths)
    used = sorted((b for b, x in enumerate(bins.items) if x), key=lambda b: -bins.free[b])
    for k, b in enumerate(used):
        at = 0
        for i in sorted(bins.items[b]):
            where[i], offset[i], at = k, at, at + lengths[i]
    return where, offset


def pack_pieces(pieces: DataFrame, capacity: int, group_rows: int = 20_000, rounds: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces of ``capacity`` tokens at most (columns of :func:`pieces_of`).

    A piece of full length is a sequence of its own and is not moved. The others are dealt evenly, by a hash of their
    number, into groups of about ``group_rows`` that are packed apart, so no task grows with the table. The emptiest sequences of each group, with a quarter
    of its pieces, are given up and packed again with those of other groups, until one group is left. An empty table gives no row.
    """
    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -F.col("at") - 1, "offset": F.lit(0).cast("long")}).drop("at")
    names, done, base = full.columns, [full], 0
    rest, n = pieces.where(F.col("length") < capacity), None

    def run_from(first: int, loose: bool):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at", ignore_index=True)
            where, offset = pack(rows["length"].tolist(), capacity, rounds)
            where = np.array(where, np.int64)
            held = np.bincount(where, minlength=1)
            again = np.maximum(np.searchsorted(np.cumsum(held), len(rows) // 4, "right"), 1) if loose else 0
            return rows.drop(columns=["part"]).assign(sequence_id=where + ((first + key[0]) << 32), offset=offset, loose=where < again)

        return run

    while True:
        n = rest.count()
        groups = max(1, -(-n // group_rows))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("at", F.lit(base)), F.lit(groups)))
        packed = dealt.groupBy("part").applyInPandas(run_from(base, groups > 1), "doc_id long, piece int, start long, length long, ids_crc32 long, at long, sequence_id long, offset long, loose boolean")
        base += groups
        if groups == 1:
            done.append(packed.select(*names))
            break
        packed = written(packed, "packed")
        done.append(packed.where("not loose").select(*names))
        rest = packed.where("loose").drop("sequence_id", "offset", "loose")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, cuts and packs whole documents; see :func:`pieces_of` and :func:`pack_pieces`. Columns other than the two named are not read."""
    return pack_pieces(written(pieces_of(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)
