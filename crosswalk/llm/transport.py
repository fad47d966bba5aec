"""Media columns: MPEG transport streams that carry a payload losslessly, and a reader that takes them apart again.

The writer makes one programme with one elementary stream: tables of programmes and streams before every random-access
point, then access units in packetized form with presentation times. The reader takes any such stream: it follows the
tables, checks the continuity counters of every packet identifier, joins the elementary packets, and lists access units with times.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import blocks

SIZE, BODY = 188, 184
PMT_PID, ES_PID, STREAM_ID, STREAM_TYPE = 0x1000, 0x0100, 0xBD, 0x06
UNIT, TICKS, EVERY = 8192, 3600, 4  # bytes of payload in an access unit, 90 kHz ticks between units, units between random-access points


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


@lru_cache(256)
def section_crc(data: bytes) -> int:
    """CRC-32 of table sections (most significant bit first, not inverted); 0 over a section with its own."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return b"\x00" + head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10]) + section.ljust(BODY, b"\xff")


_PAT = _table_packet(0, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([0x21 | (t >> 29) & 14, (t >> 22) & 255, 1 | (t >> 14) & 254, (t >> 7) & 255, 1 | (t << 1) & 254])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream. An empty one gives the tables alone."""
    out, es, tables = [], 0, 0
    for k in range(max(1, -(-len(payload) // UNIT))):
        data, point, time = payload[k * UNIT : (k + 1) * UNIT], k % EVERY == 0, k * TICKS
        if point:
            for p in (_PAT, _PMT):
                p = bytearray(p)
                p[3] |= tables & 15
                out.append(bytes(p))
            tables += 1
        if not data:
            break
        unit = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(time) + data
        clock = b"\x07\x50" + (time << 15 | 0x7E00).to_bytes(6, "big") if point else b""
        first = BODY - len(clock)
        n = 1 + max(0, -(-(len(unit) - first) // BODY))
        packets = np.full((n, SIZE), 255, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (es + np.arange(n)) & 15
        es += n
        body = np.frombuffer(unit, np.uint8)
        used = min(first, len(unit))
        spare = BODY - (len(body) - used - (n - 2) * BODY) if n > 1 else 0
        if clock or used < first:  # the clock and, in a unit of one packet, what fills it up
            field = np.full(BODY - used, 255, np.uint8)
            field[0] = len(field) - 1
            if clock:
                field[1 : len(clock)] = np.frombuffer(clock[1:], np.uint8)
            elif len(field) > 1:
                field[1] = 0
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + len(field)] = field
        packets[0, SIZE - used :] = body[:used]
        if n > 1:
            full = (n - 2) * BODY
            packets[1 : n - 1, 4:] = body[used : used + full].reshape(n - 2, BODY)
            last = body[used + full :]
            if spare:
                packets[-1, 3] |= 0x20
                packets[-1, 4] = spare - 1
                if spare > 1:
                    packets[-1, 5] = 0
            packets[-1, SIZE - len(last) :] = last
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. units: (time, first byte in data, bytes, random access) of each access unit."""

    data: bytes
    units: list[tuple[int | None, int, int, bool]]
    packets: int
    programs: dict[int, int]
    streams: dict[int, int]
    breaks: int
    bad_tables: int


def _sections(packets: np.ndarray, bodies: np.ndarray) -> tuple[list[bytes], int]:
    """Whole sections that begin in these packets and end in the same one, and how many are damaged."""
    good, bad = [], 0
    for p, at in zip(packets, bodies, strict=True):
        if not p[1] & 0x40 or at >= SIZE:
            continue
        raw = p[at:].tobytes()
        raw = raw[1 + raw[0] :]
        if len(raw) < 3 or (n := 3 + ((raw[1] & 15) << 8 | raw[2])) > len(raw) or n < 12 or section_crc(raw[:n]):
            bad += 1
        else:
            good.append(raw[: n - 4])
    return good, bad


def demux(media: bytes) -> Stream:
    """Takes a transport stream apart. Bytes before the first and after the last whole packet and packets out of step are passed over.

    A packet that repeats the one before it is dropped; a counter that skips is a break, and what follows is kept.
    """
    raw = np.frombuffer(media, np.uint8)
    start = next((i for i in range(min(SIZE, len(raw))) if raw[i] == 0x47 and (i + SIZE >= len(raw) or raw[i + SIZE] == 0x47)), 0)
    all_ = raw[start : start + (len(raw) - start) // SIZE * SIZE].reshape(-1, SIZE)
    all_ = all_[all_[:, 0] == 0x47]
    pid = (all_[:, 1].astype(np.int32) & 31) << 8 | all_[:, 2]
    has_body, has_field = all_[:, 3] & 0x10 > 0, all_[:, 3] & 0x20 > 0
    body = np.where(has_field, 5 + all_[:, 4].astype(np.int32), 4)
    body = np.where(has_body, np.minimum(body, SIZE), SIZE)
    breaks, keep = 0, np.ones(len(all_), bool)
    for p in np.unique(pid):
        at = np.flatnonzero((pid == p) & has_body)
        if p == 0x1FFF or len(at) < 2:
            continue
        step = (all_[at[1:], 3].astype(np.int32) - all_[at[:-1], 3]) & 15
        again = step == 0
        same = again & (all_[at[1:], 4:] == all_[at[:-1], 4:]).all(1) if again.any() else again
        keep[at[1:][same]] = False
        told = has_field[at[1:]] & (all_[at[1:], 4] > 0) & (all_[at[1:], 5] & 0x80 > 0)
        breaks += int(((step != 1) & ~same & ~told).sum())
    all_, pid, body, has_field = all_[keep], pid[keep], body[keep], has_field[keep]
    found, bad = _sections(all_[pid == 0], body[pid == 0])
    programs, streams = {}, {}
    for s in found:
        if s[0] == 0:
            programs |= {int.from_bytes(s[i : i + 2], "big"): int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(s) - 3, 4) if s[i] or s[i + 1]}
    for p in sorted(set(programs.values())):
        found, worse = _sections(all_[pid == p], body[pid == p])
        bad += worse
        for s in found:
            at = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while s[0] == 2 and at + 5 <= len(s):
                streams[int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF] = s[at]
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF)
    parts, units, end = [], [], 0
    for es in sorted(streams):
        own, at = all_[pid == es], body[pid == es]
        if not len(own):
            continue
        point = has_field[pid == es] & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
        flat = own[np.arange(SIZE) >= at[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(SIZE - at)])
        begins = np.flatnonzero(own[:, 1] & 0x40)
        for k, i in enumerate(begins):
            unit = flat[ends[i] : ends[begins[k + 1]] if k + 1 < len(begins) else len(flat)]
            if unit[:3] != b"\x00\x00\x01" or len(unit) < 9:
                continue
            size = int.from_bytes(unit[4:6], "big")
            head = 9 + unit[8]
            data = unit[head : 6 + size] if size else unit[head:]
            t = None
            if unit[7] & 0x80 and len(unit) >= 14:
                x = unit[9:14]
                t = (x[0] & 14) << 29 | x[1] << 22 | (x[2] & 254) << 14 | x[3] << 7 | x[4] >> 1
            units.append((t, end, len(data), bool(point[i])))
            parts.append(data)
            end += len(data)
    return Stream(b"".join(parts), units, len(all_), programs, streams, breaks, bad)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text with zero bytes up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def feature(s: Stream) -> str:
    """Packets, access units, random-access points, first and last time, breaks and damaged tables, and mean and spread of the bytes."""
    times = [u[0] for u in s.units if u[0] is not None]
    x = np.bincount(np.frombuffer(s.data, np.uint8), minlength=256) if s.data else np.zeros(256, int)
    n = max(1, int(x.sum()))
    total, squares = int((x * np.arange(256)).sum()), int((x * np.arange(256) ** 2).sum())
    return f"packets={s.packets};units={len(s.units)};points={sum(u[3] for u in s.units)};first={min(times, default=-1)};last={max(times, default=-1)};breaks={s.breaks};bad={s.bad_tables};mean={total / n:.6f};square={squares / n:.6f}"


MEDIA = "doc_id long, n_bytes long, media binary"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: every whole text, padded, as a transport stream. A null text is empty; every row stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            both = [padded(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in both], pa.int64()), pa.array([mux(p) for _, p in both], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MEDIA)


READ = "doc_id long, n_bytes long, payload binary, media binary, units array<struct<time:long,first:long,bytes:long,random_access:boolean>>, breaks int, feature string"


def read(media: DataFrame) -> DataFrame:
    """Takes the stored streams of :func:`store` apart: payload, access units with times and random-access points, breaks and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("time", pa.int64()), ("first", pa.int64()), ("bytes", pa.int64()), ("random_access", pa.bool_())]))
        for batch in blocks(batches, "media"):
            s = [demux(x or b"") for x in batch.column("media").to_pylist()]
            units = [[dict(zip(("time", "first", "bytes", "random_access"), u, strict=True)) for u in x.units] for x in s]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array([x.data for x in s], pa.binary()), batch.column("media"), pa.array(units, kind), pa.array([x.breaks for x in s], pa.int32()), pa.array([feature(x) for x in s])],
                names=["doc_id", "n_bytes", "payload", "media", "units", "breaks", "feature"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_units long, n_random_access long, breaks int"


def digests(media: DataFrame) -> DataFrame:
    """What :func:`read` finds, as digests: the payload's and the stream's size and SHA-256, and CRC-32 of the payload's last 64 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "media"):
            rows = []
            for doc, n, x in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
                s = demux(x)
                rows.append((doc, n, len(s.data), hashlib.sha256(s.data).hexdigest(), zlib.crc32(s.data[-64:]), len(x), hashlib.sha256(x).hexdigest(), feature(s), len(s.units), sum(u[3] for u in s.units), s.breaks))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in DIGEST.split(", ")]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)
