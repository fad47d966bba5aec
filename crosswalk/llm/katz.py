"""Language-model scores: a Katz backoff model of up to three words.

Runs of words seen in training have their Good-Turing discounted share of what follows their first words; what the discounts free goes to the
words that did not follow, in proportion to their probability after one word less, and so on down to single words, which in turn leave the Good-Turing
share to unseen ones. The backoff weight of each context is computed from all words seen after it, so that its probabilities add up to 1 exactly.

Counts lie in partitioned tables in the shared folder. Texts are cut into chunks of whole documents; a chunk keeps its tokens as numbers
of its own words in one file. It asks once for each distinct word, which gives words a global rank by falling count, and once for each
distinct run: what moves between machines are sorted arrays of distinct runs and as many probabilities, not tokens. A run goes to the bucket
of its word before last, which so has the counts of its pairs as well, as sums over the word before these. A word more frequent than a bucket
holds is spread by the word before it, and its pairs' counts are added up in tables of their own, which its buckets read.
"""

from __future__ import annotations

import gc
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosswalk.llm.common import blocks, discard, read_file, release, shared_dir, write_file

#: counts up to K are discounted
K = 5
CHUNK_BYTES, BUCKET_TOKENS = 14 << 20, 2_500_000
START, UNKNOWN = 0, np.uint32(0xFFFFFFFF)
#: hash of the end of a text, and the parts of 1 in which log10 probabilities travel
END, PARTS = 1, 1e10


def discounts(of_counts: dict[int, int], k: int = K) -> np.ndarray:
    """Good-Turing factors of counts 0 to ``k`` in Katz's form, all below 1 and above 0.

    The numbers of counts are used as they are if they give such factors, else as a line through their logarithms has them (copied
    text makes some even counts more frequent than odd ones), falling by the power -1.1 at least. 1 if nothing was counted.
    """
    n = np.array([of_counts.get(r, 0) for r in range(1, k + 2)], float)
    if not n.any():
        return np.ones(k + 1)
    r = np.arange(1, k + 2)

    def factors(n: np.ndarray) -> np.ndarray:
        tail = (k + 1) * n[k] / n[0]
        return (r[1:] * n[1:] / (r[:-1] * n[:-1]) - tail) / (1 - tail)

    if n.min() > 0 and (k + 1) * n[k] < n[0] and ((d := factors(n)) > 0).all() and (d < 1).all():
        return np.concatenate([[1.0], d])
    some = n > 0
    slope = np.polyfit(np.log(r[some]), np.log(n[some]), 1)[0] if some.sum() > 1 else -2.0
    return np.concatenate([[1.0], factors(r ** min(slope, -1.1))])


@dataclass
class Words:
    """Single-word statistics. Words are ranked by falling count from 1 on (0 is the start of a text); ``ends`` are the last
    ranks of words with each of the falling ``counts``. There are as many of these as distinct counts, at most about the square root of twice the tokens."""

    counts: np.ndarray
    ends: np.ndarray
    tokens: int

    @property
    def size(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __post_init__(self):
        n = np.diff(self.ends, prepend=0)
        d = discounts(dict(zip(self.counts.tolist(), n.tolist(), strict=True)))
        factor = np.where(self.counts <= K, d[np.minimum(self.counts, K)], 1.0) if len(self.counts) else np.zeros(0)
        p = factor * self.counts / max(1, self.tokens)
        left = 1 - float((p * n).sum())
        if left <= 1e-12:  # nothing is freed: one more of each word, and one of the unseen
            p, left = (self.counts + 1) / (self.tokens + self.size + 1), 1 / (self.tokens + self.size + 1)
        self._p, self._left = p, left

    def _at(self, rank: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.ends, rank), max(0, len(self.ends) - 1))

    def count(self, rank: np.ndarray) -> np.ndarray:
        known = rank != UNKNOWN
        return np.where(known, self.counts[self._at(rank)], 0) if len(self.counts) else np.zeros(len(rank), np.int64)

    def probability(self, rank: np.ndarray) -> np.ndarray:
        known = rank != UNKNOWN
        return np.where(known, self._p[self._at(rank)], self._left) if len(self.counts) else np.full(len(rank), self._left)


def _packed(x: np.ndarray) -> bytes:
    """An array of unsigned integers as zstandard data, byte by byte of equal weight."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def _unpacked(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Numbers of the tokens of all texts, each followed by its end, tokens of each text, and the distinct words. The end is the last number."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    flat = cut.flatten().dictionary_encode()
    sizes, codes, names = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if "" in names:  # white space at either end of a text
        empty = names.index("")
        keep = codes != empty
        doc, codes = doc[keep], codes[keep]
        codes = codes - (codes > empty)
        del names[empty]
        sizes = np.bincount(doc, minlength=len(sizes))
    out = np.full(len(codes) + len(sizes), len(names), np.int64)
    out[np.arange(len(codes)) + doc] = codes
    return out, sizes + 1, names


class Chunk:
    """The tokens of some whole documents, kept in one file of the shared folder. Words are numbered by their hashes."""

    def __init__(self, docs: list[int | None], train: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        self.docs, self.train, self.sizes, self.ids = docs, train, sizes, ids

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        null = np.array([d is None for d in self.docs], bool)
        np.savez(f, docs=np.array([d or 0 for d in self.docs], np.int64), null=null, train=self.train, sizes=self.sizes.astype(np.uint32), ids=np.frombuffer(_packed(self.ids.astype(np.uint32)), np.uint8))
        return f.getvalue()

    @classmethod
    def of(cls, data: bytes) -> Chunk:
        z = np.load(io.BytesIO(data))
        docs = [None if n else int(d) for d, n in zip(z["docs"], z["null"], strict=True)]
        return cls(docs, z["train"], z["sizes"].astype(np.int64), _unpacked(z["ids"].tobytes(), "<u4"))

    def runs(self, rank: np.ndarray, order: int, part) -> Runs:
        """The distinct runs of the chunk; ``part`` gives the bucket of each."""
        names, code = np.unique(np.concatenate([np.array([START], np.uint32), rank]), return_inverse=True)  # in rank order, unknown words last and one
        w = code[1:][self.ids].astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        h2 = np.empty_like(w)
        h2[1:] = w[:-1]
        h2[first] = code[0]
        asked = names[h2] != UNKNOWN
        m = len(names)
        if order > 2:
            h1 = np.empty_like(w)
            h1[1:] = h2[:-1]
            h1[first] = code[0]
            pairs, at = np.unique((h2 * m + h1)[asked], return_inverse=True)
        else:
            pairs, at = np.unique((h2 * m + code[0])[asked], return_inverse=True)
        del h2
        keys, where = np.unique(at * m + w[asked], return_inverse=True)
        del at
        times = np.bincount(where, weights=np.repeat(self.train, self.sizes)[asked], minlength=len(keys)).astype(np.uint32)
        pair = pairs[keys // m]
        out = names[pair // m], names[pair % m], names[keys % m]
        bucket = part(*out)
        turn = np.argsort(bucket, kind="stable")
        back = np.empty(len(turn), np.int64)
        back[turn] = np.arange(len(turn))
        return Runs(*(x[turn] for x in (*out, times, bucket)), asked, back[where])


@dataclass
class Runs:
    """Distinct runs by bucket, and in each by h2, h1 (the words before) and w; which tokens ask, and the number of each of these tokens' run."""

    h2: np.ndarray
    h1: np.ndarray
    w: np.ndarray
    times: np.ndarray
    bucket: np.ndarray
    asked: np.ndarray
    where: np.ndarray


def _steps(x: np.ndarray, same: np.ndarray) -> bytes:
    """Values that rise while ``same`` holds, as differences."""
    d = x.astype(np.int64)
    d[1:] -= np.where(same[1:], d[:-1], 0)
    return _packed(d.astype(np.uint32))


def _from_steps(b: bytes, same: np.ndarray) -> np.ndarray:
    d = _unpacked(b, "<u4").astype(np.int64)
    total = np.cumsum(d)
    start = np.flatnonzero(~same)
    return (total - np.repeat(total[start] - d[start], np.diff(np.append(start, len(d))))).astype(np.uint32)


def _same(*cols: np.ndarray) -> np.ndarray:
    """Whether each row agrees with the one before in all columns."""
    out = np.ones(len(cols[0]), bool)
    out[:1] = False
    for c in cols:
        out[1:] &= c[1:] == c[:-1]
    return out


def _pack_runs(h2: np.ndarray, h1: np.ndarray, w: np.ndarray) -> list[bytes]:
    return [_steps(h2, _same(np.zeros(len(h2)))), _steps(h1, _same(h2)), _steps(w, _same(h2, h1))]


def _unpack_runs(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(_unpacked(a, "<u4"))
    h2 = _from_steps(a, _same(np.zeros(n)))
    h1 = _from_steps(b, _same(h2))
    return h2, h1, _from_steps(c, _same(h2, h1))


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Deal:
    """Which bucket a run goes to: that of h2, and of a part of h1 (with ``order`` 2, of w) where h2 has more tokens than a bucket."""

    def __init__(self, buckets: int, splits: np.ndarray, order: int):
        self.buckets, self.splits, self.order = buckets, splits, order

    def parts(self, h2: np.ndarray) -> np.ndarray:
        """In how many parts the words are spread; 1 for all but the most frequent, which have the first ranks."""
        out = np.ones(len(h2), np.uint64)
        hot = (h2 > START) & (h2 <= len(self.splits))
        out[hot] = self.splits[h2[hot].astype(np.int64) - 1]
        return out

    def __call__(self, h2: np.ndarray, h1: np.ndarray, w: np.ndarray) -> np.ndarray:
        own = _spread(h1 if self.order > 2 else w) % self.parts(h2)
        return (_spread(h2.astype(np.uint64) << np.uint64(24) | own) % np.uint64(self.buckets)).astype(np.int32)


def _few(c: np.ndarray) -> list[int]:
    """How many counts are 0, 1, ... K + 1."""
    return np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)[: K + 2].tolist()


def _sums(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of what each has."""
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, weights=c, minlength=len(keys)).astype(np.int64)


class Level:
    """Discounted shares and backoff weights of contexts: ``key`` has context << 32 | word, ``c`` counts (0 where nothing was seen), ``lower`` the probability after one word less."""

    def __init__(self, context: np.ndarray, c: np.ndarray, lower: np.ndarray, factor: np.ndarray):
        kept = np.where(c <= K, factor[np.minimum(c, K)], 1.0) * c
        n = int(context.max()) + 1 if len(context) else 0
        seen = c > 0
        total, free, low = (np.bincount(context, weights=x, minlength=n) for x in (c, kept, np.where(seen, lower, 0.0)))
        # a context none of whose counts is discounted gives one more than its count to what did not follow
        self.of = np.where(total - free < 1e-9, total + 1, total)
        self.weight = np.where(total > 0, (1 - free / self.of) / (1 - low), 1.0)
        self.probability = np.where(seen, kept / self.of[context], self.weight[context] * lower)


def scores(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", order: int = 2, chunk_bytes: int = CHUNK_BYTES, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, trained_on, n_tokens, n_known, train_tokens, base_score and score of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; each text has one end after them, a token too. ``train``: a condition on ``docs``;
    rows that meet it are learned from (a null counts as false). base_score adds log10((c+1)/(N+V+1)) over the tokens, score log10 of the model's
    probability, of each token to 10 decimals. ``order``: words of the longest runs, 2 or 3. A null text is empty; rows count each time, whether they repeat or have null ids; without
    rows to learn from every token has probability 1. Columns other than the two named and those of ``train`` are not read, whatever their names; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    folder = shared_dir(spark, "tokens")
    columns = lambda kinds, out: pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = shared_dir(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in blocks(batches, "text", chunk_bytes):
            ids, sizes, names = _tokens(batch.column("text"))
            hashes = np.append(pd.util.hash_array(np.array([*names, ""], object)[:-1], categorize=False), np.uint64(END))
            turn = np.argsort(hashes, kind="stable")
            back = np.empty(len(turn), np.int64)
            back[turn] = np.arange(len(turn))
            ids = back[ids]
            learn = batch.column("train").to_numpy(zero_copy_only=False)
            counts = np.bincount(ids[np.repeat(learn, sizes)], minlength=len(turn)).astype(np.uint32)
            number, seq = part << 24 | seq, seq + 1
            write_file(f"{folder}/{number}", Chunk(batch.column("doc_id").to_pylist(), learn, sizes, ids).to_bytes())
            yield columns(CUT, [(number, int(sizes.sum()), _packed(np.diff(hashes[turn], prepend=np.uint64(0))), _packed(counts))])
            del ids, sizes, names, counts, hashes, turn, back
            release()

    chunks, chunk_path = kept(rows.mapInArrow(cut, "chunk long, n long, words binary, counts binary"), "chunk-words")
    n_chunks, n_tokens = chunks.agg(F.count("*"), F.sum("n")).first()
    if not n_chunks:
        return spark.createDataFrame([], SCORES)
    buckets = max(8, -(-n_tokens // bucket_tokens))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys = np.cumsum(_unpacked(batch.column("words")[k].as_py(), "<u8"), dtype=np.uint64)
                counts = _unpacked(batch.column("counts")[k].as_py(), "<u4")
                ends = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1)).tolist()
                out = [(b, batch.column("chunk")[k].as_py(), _packed(np.diff(keys[x:y], prepend=np.uint64(0))), _packed(counts[x:y])) for b, (x, y) in enumerate(zip(ends, ends[1:])) if y > x]
                yield columns(ASKED_WORDS, out)

    def merged(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Keys of each chunk, in one; where each is among the distinct ones, and the count of these."""
        keys = [np.cumsum(_unpacked(b, "<u8"), dtype=np.uint64) for b in pdf["keys"]]
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, where, np.bincount(where, weights=np.concatenate([_unpacked(b, "<u4") for b in pdf["counts"]])).astype(np.int64)

    def histogram(pdf: pd.DataFrame) -> pd.DataFrame:
        c = merged(pdf)[2]
        values, n = np.unique(c[c > 0], return_counts=True)
        return pd.DataFrame({"bucket": np.full(len(values), pdf["bucket"].iloc[0]), "c": values, "n": n})

    asked_words = chunks.mapInArrow(ask_words, "bucket int, chunk long, keys binary, counts binary")
    held, held_path = kept(asked_words.groupBy("bucket").applyInPandas(histogram, "bucket int, c long, n long"), "word-counts")
    # one row a distinct count, at most about the square root of twice the tokens
    by_count = sorted(((r["c"], r["n"]) for r in held.groupBy("c").agg(F.sum("n").alias("n")).collect()), reverse=True)
    words = Words(np.array([c for c, _ in by_count], np.int64), np.cumsum([n for _, n in by_count], dtype=np.int64), sum(c * n for c, n in by_count))
    # words are known by their rank in 32 bits, the last of which stands for unknown ones
    if by_count and words.ends[-1] >= int(UNKNOWN):
        raise OverflowError(f"{words.ends[-1]} distinct words are more than ranks of 32 bits can name")
    say = (words.counts, words.ends, words.tokens)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def rank_words(key: tuple, pdf: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"chunk": [], "bucket": [], "ranks": []})
        stat = Words(*say)
        pdf = pdf.sort_values("chunk")
        keys, where, c = merged(pdf)
        rank = np.full(len(c), UNKNOWN, np.uint32)
        turn = np.argsort(c, kind="stable")
        begins = dict(zip(first["c"].tolist(), first["before"].tolist(), strict=True))
        values, at = np.unique(c[turn], return_index=True)
        for v, x, y in zip(values.tolist(), at.tolist(), [*at[1:].tolist(), len(c)], strict=True):
            if v:
                spot = int(np.searchsorted(-stat.counts, -v))
                base = (int(stat.ends[spot - 1]) if spot else 0) + begins[v]
                rank[turn[x:y]] = np.arange(base + 1, base + 1 + y - x)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "ranks": [_packed(x) for x in np.split(rank[where], cuts)]})

    told = asked_words.groupBy("bucket").cogroup(held.withColumn("before", before).groupBy("bucket")).applyInPandas(rank_words, "chunk long, bucket int, ranks binary")
    known, _ = kept(told.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "ranks"))).alias("ranks")), "chunk-ranks")
    discard(spark, chunk_path)
    discard(spark, held_path)
    often = words.counts[np.searchsorted(words.ends, np.arange(1, min(words.size, buckets) + 1))] if words.size else np.zeros(0, np.int64)
    deal = Deal(buckets, -(-often[often > bucket_tokens] // bucket_tokens).astype(np.uint64), order)
    del asked_words, told, chunks
    _free(spark)

    def ranks(x) -> np.ndarray:
        return np.concatenate([_unpacked(y["ranks"].as_py(), "<u4") for y in x.values])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column("chunk")[k].as_py()
                r = Chunk.of(read_file(f"{folder}/{number}")).runs(ranks(batch.column("ranks")[k]), order, deal)
                ends = np.searchsorted(r.bucket, np.arange(buckets + 1)).tolist()
                yield columns(ASKED, [(b, number, *_pack_runs(r.h2[x:y], r.h1[x:y], r.w[x:y]), _packed(r.times[x:y])) for b, (x, y) in enumerate(zip(ends, ends[1:])) if y > x])
                del r
                release()

    tables = shared_dir(spark, "runs")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Stores a bucket's runs with their counts, and which of them each chunk asked for; says what is counted in more than one bucket."""
        b = int(pdf["bucket"].iloc[0])
        pdf = pdf.sort_values("chunk")
        parts = [_unpack_runs(*x) for x in zip(pdf["h2"], pdf["h1"], pdf["w"], strict=True)]
        h2, h1, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
        sizes = [len(p[0]) for p in parts]
        del parts
        contexts, at = np.unique(h2.astype(np.uint64) << np.uint64(32) | h1, return_inverse=True)
        del h2, h1
        keys, where = np.unique(at.astype(np.uint64) << np.uint64(32) | w, return_inverse=True)
        del at, w
        c = np.bincount(where, weights=np.concatenate([_unpacked(x, "<u4") for x in pdf["times"]]), minlength=len(keys)).astype(np.int64)
        context, w = contexts[(keys >> np.uint64(32)).astype(np.int64)], (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        h2, h1 = (context >> np.uint64(32)).astype(np.uint32), (context & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        f = io.BytesIO()
        pq.write_table(pa.table({"h2": h2, "h1": h1, "w": w, "count": c}), f, compression="zstd", use_dictionary=False, column_encoding={k: "DELTA_BINARY_PACKED" for k in ("h2", "h1", "w", "count")})
        write_file(f"{tables}/runs/bucket={b}/runs.parquet", f.getvalue())
        asked = io.BytesIO()
        np.savez(asked, chunks=pdf["chunk"].to_numpy(), sizes=np.array(sizes), where=np.frombuffer(_packed(where.astype(np.uint32)), np.uint8))
        write_file(f"{tables}/asked/{b}", asked.getvalue())
        seen = c > 0
        parts_of = deal.parts(h2)
        alone = seen & (parts_of == 1)
        out = [(b, -1, -1, None, None, _few(_sums(h2[alone].astype(np.uint64) << np.uint64(32) | w[alone], c[alone])[1]), _few(c[seen]))]
        spread = seen & (parts_of > 1)
        for h in np.unique(h2[spread]).tolist():
            own = spread & (h2 == h)
            names, n = _sums(w[own], c[own])
            s = _spread(names) % deal.parts(np.array([h], np.uint32))[0]
            for k in np.unique(s).tolist():
                x = s == k
                out.append((b, h, int(k), _packed(names[x]), _packed(n[x].astype(np.uint64)), None, None))
        return pd.DataFrame({name: pd.Series([o[j] for o in out], dtype=kind) for j, (name, kind) in enumerate((("bucket", "int32"), ("h", "int64"), ("s", "int64"), ("w", object), ("c", object), ("few2", object), ("few3", object)))})

    def add_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Stores the counts of the pairs of a spread word, for a part of the words after it."""
        names, c = _sums(np.concatenate([_unpacked(x, "<u4") for x in pdf["w"]]), np.concatenate([_unpacked(x, "<u8") for x in pdf["c"]]))
        f = io.BytesIO()
        pq.write_table(pa.table({"w": names, "count": c}), f, compression="zstd")
        write_file(f"{tables}/pairs/h={key[0]}/{key[1]}.parquet", f.getvalue())
        return pd.DataFrame({"few2": [_few(c)]})

    found, _ = kept(known.mapInArrow(ask, "bucket int, chunk long, h2 binary, h1 binary, w binary, times binary").groupBy("bucket").applyInPandas(merge, "bucket int, h long, s long, w binary, c binary, few2 array<long>, few3 array<long>"), "run-counts")
    spread, _ = kept(found.where("h >= 0").groupBy("h", "s").applyInPandas(add_up, "few2 array<long>"), "pair-counts")
    total = lambda df, col: df.agg(*[F.sum(F.element_at(col, r + 1)).alias(f"n{r}") for r in range(1, K + 2)]).first()
    of = [total(found.where("h < 0"), "few2"), total(spread, "few2"), total(found.where("h < 0"), "few3")]
    of2, of3 = {r: (of[0][f"n{r}"] or 0) + (of[1][f"n{r}"] or 0) for r in range(1, K + 2)}, {r: of[2][f"n{r}"] or 0 for r in range(1, K + 2)}
    factor2, factor3 = discounts(of2), discounts(of3)
    _free(spark)

    def pair_level(h2: np.ndarray, w: np.ndarray, c: np.ndarray, stat: Words) -> np.ndarray:
        """The probability of each w after h2, from the counts of a bucket's runs, and of a spread word from its tables."""
        keys, at = np.unique(h2.astype(np.uint64) << np.uint64(32) | w, return_inverse=True)
        counts = np.bincount(at, weights=c, minlength=len(keys)).astype(np.int64)
        first, names = (keys >> np.uint64(32)).astype(np.uint32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out = np.empty(len(keys))
        parts_of = deal.parts(first)
        alone = parts_of == 1
        if alone.any():
            _, context = np.unique(first[alone], return_inverse=True)
            out[alone] = Level(context, counts[alone], stat.probability(names[alone]), factor2).probability
        for h in np.unique(first[~alone]).tolist():
            own = np.flatnonzero(first == h)
            tables_of = []
            for s in range(int(deal.parts(np.array([h], np.uint32))[0])):
                try:
                    tables_of.append(pq.read_table(io.BytesIO(read_file(f"{tables}/pairs/h={h}/{s}.parquet"))))
                except FileNotFoundError:  # no word of this part follows
                    continue
            after, n = (np.concatenate([t.column(x).to_numpy() for t in tables_of] or [np.zeros(0, np.int64)]) for x in ("w", "count"))
            all_, spot = np.unique(np.concatenate([after.astype(np.uint32), names[own]]), return_inverse=True)
            c_all = np.bincount(spot[: len(n)], weights=n, minlength=len(all_)).astype(np.int64)
            level = Level(np.zeros(len(all_), np.int64), c_all, stat.probability(all_), factor2)
            out[own] = level.probability[spot[len(n) :]]
        return out[at]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stat = Words(*say)
        for batch in batches:
            for b in batch.column("bucket").to_pylist():
                t = pq.read_table(io.BytesIO(read_file(f"{tables}/runs/bucket={b}/runs.parquet")), partitioning=None)
                h2, h1, w, c = (t.column(x).to_numpy() for x in ("h2", "h1", "w", "count"))
                del t
                p = pair_level(h2, w, c, stat)
                if order > 2:
                    context = np.cumsum(~_same(h2, h1)) - 1
                    p = Level(context, c.astype(np.int64), p, factor3).probability
                said = np.round(-np.log10(p) * PARTS).astype(np.uint64)
                z = np.load(io.BytesIO(read_file(f"{tables}/asked/{b}")))
                where = _unpacked(z["where"].tobytes(), "<u4")
                cuts = np.cumsum(z["sizes"])[:-1]
                for number, own in zip(z["chunks"].tolist(), np.split(where, cuts), strict=True):
                    yield columns(ANSWERED, [(number, b, _packed(said[own]), None)])
                del h2, h1, w, c, p, said, where
                release()

    numbers = found.where("h < 0").select("bucket").repartition(buckets, "bucket")
    answers = numbers.mapInArrow(answer, "chunk long, bucket int, said binary, ranks array<struct<bucket:int,ranks:binary>>")
    facts = known.select("chunk", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("said"), "ranks").unionByName(answers)

    def finish(number: int, x: np.ndarray, replies: list[bytes]) -> pa.RecordBatch:
        stat = Words(*say)
        chunk = Chunk.of(read_file(f"{folder}/{number}"))
        r = chunk.runs(x, order, deal)
        asked, where = r.asked, r.where
        del r
        w = x[chunk.ids]
        lp = np.log10(stat.probability(w))
        if replies:
            lp[asked] = -(np.concatenate([_unpacked(b, "<u8") for b in replies]) / PARTS)[where]
        del asked, where
        starts = np.cumsum(chunk.sizes) - chunk.sizes
        add = lambda values: np.add.reduceat(values, starts)
        score, known_, base = add(lp), add((w != UNKNOWN).astype(np.int64)), add(np.log10((stat.count(w) + 1) / (stat.tokens + stat.size + 1)))
        return pa.RecordBatch.from_arrays(
            [pa.array(chunk.docs, pa.int64()), pa.array(chunk.train), pa.array(chunk.sizes), pa.array(known_), pa.array(np.full(len(starts), stat.tokens)), pa.array(base), pa.array(score)],
            names=["doc_id", "trained_on", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, x, replies = None, None, []
        for batch in batches:
            for k in range(batch.num_rows):
                if (own := batch.column("chunk")[k].as_py()) != number:
                    if number is not None:
                        yield finish(number, x, replies)
                        release()
                    number, x, replies = own, ranks(batch.column("ranks")[k]), []
                else:
                    replies.append(batch.column("said")[k].as_py())
        if number is not None:
            yield finish(number, x, replies)

    return facts.repartition(n_chunks, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(score, SCORES)


def _free(spark) -> None:
    """Lets Spark delete the shuffle files of what is no longer used, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


CUT = [("chunk", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]
ASKED_WORDS = [("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
ASKED = [("bucket", pa.int32()), ("chunk", pa.int64()), ("h2", pa.binary()), ("h1", pa.binary()), ("w", pa.binary()), ("times", pa.binary())]
ANSWERED = [("chunk", pa.int64()), ("bucket", pa.int32()), ("said", pa.binary()), ("ranks", pa.list_(pa.struct([("bucket", pa.int32()), ("ranks", pa.binary())])))]
SCORES = "doc_id long, trained_on boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
