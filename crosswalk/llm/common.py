"""What the operators of this subpackage share: written stages, shared files, tokens and row blocks."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
#: the folder of a local session that names none
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name, with its scheme, below the cluster's ``spark.checkpoint.dir``. Where that is unset, a folder of this session's own in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="crosswalk-"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base.rstrip("/"))
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and returns what is read back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def used_up(*tables: DataFrame) -> None:
    """Deletes what :func:`written` wrote, once nothing will read it again."""
    for t in tables:
        discard(t.sparkSession, t._written_at)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that :func:`shared_dir` named, through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _WRITTEN:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001 - the session is over; its owner cleans the shared folder
            return


def _store(path: str):
    """File system and path of a qualified name. ``s3a`` and ``s3n`` are what Spark calls ``s3``."""
    from pyarrow import fs

    u = urlparse(path)
    if u.scheme in ("", "file"):
        return None, u.path
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def write_file(path: str, data: bytes) -> None:
    """Writes a whole file to shared storage so that a task run twice leaves one complete copy."""
    store, at = _store(path)
    part = f"{at}.{uuid.uuid4().hex}"
    if store is None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, at)
        return
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, at)


def read_file(path: str, start: int = 0, length: int | None = None) -> bytes:
    """A file, or ``length`` bytes of it from ``start`` on, of which nothing else is read."""
    store, at = _store(path)
    with open(at, "rb") if store is None else store.open_input_file(at) as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 (``bytes.split`` cuts at exactly these six bytes)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def train_rows(col: str, modulus: int, held: int):
    """Column: whether crc32 of the id as text leaves another remainder than the held-out one. A null id is held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % modulus != held, F.lit(False))


#: what a Python worker keeps between tasks, by operator: how to forget it
KEPT: dict[str, Callable[[], None]] = {}
_OWNER: list[str] = [""]


def release() -> None:
    """Gives unused memory back to the machine, which the pools of Arrow and the C library would otherwise keep."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def claim(name: str) -> None:
    """Called as an operator's task begins: a worker that kept words for another operator forgets them, as workers serve one after the other."""
    if _OWNER[0] != name:
        for other, forget in KEPT.items():
            if other != name:
                forget()
        _OWNER[0] = name
        release()


#: a word between others while they are encoded together
MARK = "~"


class Encoder:
    """Encodes whole texts with a public tokenizer file, keeping the ids of white-space separated pieces.

    The tokenizer cuts at white space before its merges, so pieces can be encoded alone and joined. Pieces are cut only at
    space, tab, line feed and carriage return; any other character stays in its piece and is left to the tokenizer.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {"": b""}

    def __call__(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        import numpy as np

        cut = pa.compute.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        for c in "\n\t\r":
            cut = pa.compute.replace_substring(cut, c, " ")
        cut = pa.compute.split_pattern(cut, " ")
        sizes = pa.compute.list_value_length(cut).to_numpy(zero_copy_only=False)
        flat = cut.flatten().dictionary_encode()
        codes, names = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
        del cut, flat
        if len(self.known) > self.keep:
            self.known = {w: x for w, x in self.known.items() if len(w) <= 8}
            if len(self.known) > self.keep // 2:
                self.known = {"": b""}
        self._learn([w for w in names if w not in self.known])
        pieces = [self.known[w] for w in names]
        long_ = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        starts, whole = np.cumsum(long_) - long_, np.frombuffer(b"".join(pieces), "<u4")
        del pieces, names
        n = long_[codes]
        ends = np.cumsum(n)
        ids = whole[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[codes] - (ends - n), n)].tobytes()
        at = [0, *(4 * ends[np.cumsum(sizes) - 1]).tolist()] if len(ends) else [0]
        return [ids[x:y] for x, y in zip(at, at[1:])]

    def _learn(self, new: list[str]) -> None:
        """Ids of words, many of them in one text, with a mark between them; where a word has the mark's id too, of each alone."""
        import numpy as np

        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        for at in range(0, len(new), 256):
            part = new[at : at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else ids
            if len(mark) != 1 or len(cut) != len(part) - 1:
                for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.known[w] = np.array(e.ids, "<u4").tobytes()
                continue
            raw, cut = ids.tobytes(), (4 * cut).tolist()
            for w, x, y in zip(part, [0, *(c + 4 for c in cut)], [*cut, len(raw)], strict=True):
                self.known[w] = raw[x:y]


_ENCODERS: dict[str, Encoder] = {}
KEPT["tokens"] = _ENCODERS.clear


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    claim("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or with a dot in ``name`` a field of a struct column."""
    outer, _, inner = name.partition(".")
    return batch.column(outer).field(inner) if inner else batch.column(outer)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``max_bytes`` of text at most; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(column(batch, text)), 0).to_pylist()
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if i > at and total + n > max_bytes:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def with_row(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> tuple[DataFrame, str]:
    """doc_id and the text, or with ``carry`` the whole row as the struct row, and the name of the text for :func:`column`. A text goes to Python once."""
    if not carry:
        return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text")), "__text"
    return docs.withColumn(text_col, F.col(text_col).cast("string")).select(F.col(id_col).alias("doc_id"), F.struct("*").alias("row")), f"row.{text_col}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_starts(df: DataFrame, order, parts: int) -> DataFrame:
    """One row with the ascending array starts: the least value of ``order`` in each of about ``parts`` even ranges.

    Only that column is dealt to ranges, and a value of each range comes back as data: a row a range, whatever the size of the table.
    """
    dealt = df.select(order.alias("o")).repartitionByRange(parts, "o")
    return dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o")).agg(F.sort_array(F.collect_list("o")).alias("starts"))


def range_of(starts, value):
    """Column: the range, from 0, that ``value`` lies in, by binary search of the ascending array ``starts``."""
    steps = F.transform(F.reverse(F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int"))), lambda k: F.pow(F.lit(2), k).cast("int"))
    at = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= F.size(starts)) & (F.get(starts, p + s - 1) <= value), p + s).otherwise(p))
    return F.greatest(at - 1, F.lit(0))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in an order: sorted in ranges and written, counted by range, and moved up by the rows of the ranges before: a row a range."""
    at = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    held = at.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = held.select("__part", before.alias("__before"))
    return at.withColumn("__part", part).join(first, "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__part", "__before")


def parts_for(df: DataFrame, rows_each: int = 6000, n: int | None = None, most: int | None = None) -> int:
    """How many partitions hold about ``rows_each`` rows each, ``most`` at most."""
    n = df.count() if n is None else n
    return min(max(1, -(-n // rows_each)), most or n + 1)


def plain(name: str) -> str:
    return re.sub(r"\W+", "_", name)
