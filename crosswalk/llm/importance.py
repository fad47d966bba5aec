"""Importance resampling towards a target: documents whose hashed word runs look like the target's are drawn more often.

Each partition counts its texts in an own in-process DuckDB: SQL takes words out of blocks of texts, unnests them with their places, windows them to
runs of up to ``order`` words and hashes these with zlib's CRC, which is registered as a function over Arrow arrays. The counts of each text's buckets
are spilled to Parquet in the shared folder; Spark adds them up, works out each bucket's gain, scores the texts and ranks them.

A text of any length is cut for DuckDB into pieces of whole words that overlap by ``order - 1`` words, of which each run is counted in the piece where it
begins, so counts are those of the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import blocks, numbered, release, used_up, written

BUCKETS, DIGITS, ORDER = 10_000, 4_294_967_296, 1
#: characters of a word, once A-Z are lower-case
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: bytes of text that DuckDB gets at once, which bounds what a worker holds, and characters of a piece of a longer text
BLOCK, PIECE = 1 << 20, 1 << 21
_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(65, 91)}


def count_sql(order: int, buckets: int) -> str:
    """Over the relation texts (k, own, text): each text's words, features and counts by bucket. ``own``: only runs that begin in the first so many words count; null: all."""
    grams = ["w"] + [f"case when w{n} is not null then " + " || ' ' || ".join(["w", *(f"w{j}" for j in range(1, n + 1))]) + " end" for n in range(1, order)]
    named = "".join(f", lead(w, {n}) over (partition by k, piece order by i) as w{n}" for n in range(1, order))
    return f"""
with words as (select k, piece, own, unnest(ws) as w, generate_subscripts(ws, 1) as i from (
  select k, piece, own, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from texts)),
runs as (select k, own, i, w{named} from words),
features as ({" union all ".join(f"select k, {g} as f{', true as single' if n == 0 else ', false'} from runs where own is null or i <= own" for n, g in enumerate(grams))}),
grouped as materialized (select k, f, count(*) as n, count(*) filter (single) as words from features where f is not null group by k, f),
hashed as (select f, crc32(f) % {buckets} as b from (select distinct f from grouped)),
counted as (select k, b, sum(n)::bigint as n, sum(words) as words from grouped join hashed using (f) group by k, b)
select k, sum(words)::bigint as n_words, sum(n)::bigint as n_features, list(b::int order by b) as b, list(n order by b) as n from counted group by k order by k"""


def _pieces(text: str, order: int) -> Iterator[tuple[int | None, str]]:
    """Pieces of a long text: how many words are its own, and the text with ``order - 1`` words more."""
    at = 0
    while at < len(text):
        cut = at + PIECE
        # a word stays whole
        while cut < len(text) and _WORD.match(text[cut - 1].translate(_LOWER)) and _WORD.match(text[cut].translate(_LOWER)):
            cut += 1
        end = cut
        if order > 1 and cut < len(text):
            more = re.compile(rf"(?:[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+){{0,{order - 1}}}").match(text, cut)
            end = more.end()
        own = len(_WORD.findall(text[at:cut].translate(_LOWER))) if end > cut else None
        yield own, text[at:end]
        at = cut


def counter(order: int = ORDER, buckets: int = BUCKETS):
    """A function from an Arrow array of texts to a table k (place in the array), n_words, n_features, b and n, for texts with words; it holds a DuckDB connection of its own."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "preserve_insertion_order": False})

    def crc(texts: pa.ChunkedArray) -> pa.Array:
        return pa.array([zlib.crc32(x) for x in texts.cast(pa.binary()).to_pylist()], pa.int64())

    con.create_function("crc32", crc, ["VARCHAR"], "BIGINT", type="arrow")
    query = count_sql(order, buckets)

    def count(texts: pa.Array) -> pa.Table:
        k, piece, own, text = [], [], [], []
        for at, x in enumerate(texts.to_pylist()):
            if not x:
                continue
            for j, (o, part) in enumerate(_pieces(x, order) if len(x) > PIECE else [(None, x)]):
                k.append(at), piece.append(j), own.append(o), text.append(part)
        rows = pa.table({"k": pa.array(k, pa.int64()), "piece": pa.array(piece, pa.int64()), "own": pa.array(own, pa.int64()), "text": pa.array(text, pa.string())})
        con.register("texts", rows)
        got = con.sql(query).to_arrow_table()
        con.unregister("texts")
        return got

    return count


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])


def counted(batches: Iterator[pa.RecordBatch], order: int = ORDER, buckets: int = BUCKETS) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and text as doc_id, n_words, n_features, b and n, a block of texts after the other."""
    count = counter(order, buckets)
    for batch in blocks(batches, max_bytes=BLOCK):
        got = count(batch.column("text"))
        at = [None] * batch.num_rows
        for row, k in enumerate(got["k"].to_pylist()):
            at[k] = row
        got = got.take(pa.array(at, pa.int64()))
        zero = [pyarrow.compute.fill_null(got[c], 0) for c in ("n_words", "n_features")]
        yield from pa.table([batch.column("doc_id"), *zero, got["b"], got["n"]], schema=_COUNTED).to_batches()
    # the worker stays for other tasks, its connection does not
    del count
    release()


def bucket_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the buckets ``b`` with their counts ``n`` of every row, from the whole text. A null text has no words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: counted(batches, order, buckets), "doc_id long, n_words long, n_features long, b array<int>, n array<long>")


def totals(counts: DataFrame) -> DataFrame:
    """b and total over all texts: at most one row a bucket from each task is shuffled."""
    return counts.select(F.explode(F.arrays_zip("b", "n")).alias("x")).groupBy(F.col("x.b").alias("b")).agg(F.sum("x.n").alias("total"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """b and gain of every bucket, from the totals of the texts and of the target's: ``buckets`` rows."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    both = every.join(docs.withColumnRenamed("total", "s"), "b", "left").join(target.withColumnRenamed("total", "t"), "b", "left").fillna(0)
    own = both.crossJoin(F.broadcast(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))))
    d = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    return own.select("b", F.floor(1000 * F.log((d["t"] + 1) * (d["all_s"] + buckets) / ((d["s"] + 1) * (d["all_t"] + buckets)))).alias("gain"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, order: int = ORDER, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``.

    weight is the floored mean gain of the text's features, 0 without any; score adds a Gumbel number made from the id and ``seed``, so the highest
    scores are a draw without replacement in proportion to the weights' exponentials. rank numbers the drawn ``percent`` of those with ``least_words`` words,
    by falling score and rising id; it is null for all others. Repeated ids keep their rows and are drawn each for itself, those of equal score in any order; a null id is
    hashed as empty text and comes last among equal scores. Other columns are not read; empty tables count nothing.
    """
    counted = written(bucket_counts(docs, id_col, text_col, order, buckets), "bucket-counts")
    aim = written(bucket_counts(target, target.columns[0], text_col, order, buckets), "bucket-counts-target")
    gain = gains(totals(counted), totals(aim), buckets).agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "gain"))), lambda x: x["gain"]).alias("gains"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / DIGITS)))
    summed = F.aggregate(F.zip_with("b", "n", lambda b, n: n * F.get("gains", b)), F.lit(0).cast("long"), lambda a, x: a + x)
    weight = F.when(F.col("n_features") > 0, F.floor(summed / F.col("n_features"))).otherwise(0).cast("long")
    # one row of ``buckets`` numbers
    rows = counted.crossJoin(F.broadcast(gain)).select("doc_id", "n_features", (F.col("n_words") >= least_words).alias("fit"), weight.alias("weight"), (weight + gumbel).alias("score"))
    scored = written(rows, "importance-scores")
    used_up(counted, aim)
    drawn = scored.where("fit").count() * percent // 100
    ranked = numbered(scored, [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "n")
    used_up(scored)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("n") <= drawn, F.col("n")).alias("rank"))


def sql(percent: int = 10, least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS) -> str:
    """The same in SQL for runs of one word, with the CRC worked out byte by byte."""
    words = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    step = "case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end"
    return f"""with recursive table_(i, c, k) as (
  select i, i::bigint, 0 from range(256) t(i) union all select i, {step}, k + 1 from table_ where k < 8),
crcs as materialized (select list(c order by i) as cs from table_ where k = 8),
d as materialized (select row_number() over () as r, doc_id, {words} as ws from documents),
w as materialized (select r, unnest(ws) as w from d),
t as materialized (select unnest({words}) as w from benchmark),
hashed as materialized (select w, xor(4294967295, list_reduce(list_concat([4294967295::bigint], bytes), lambda c, b: xor(c // 256, cs[xor(c % 256, b) + 1]))) % {buckets} as b
  from (select w, list_transform(range(0, length(x), 2), lambda j: ((instr('0123456789ABCDEF', x[j + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[j + 2]) - 1)::bigint) as bytes
    from (select w, hex(encode(w)) as x from (select w from w union select w from t))), crcs),
s as (select b, count(*) as s from w join hashed using (w) group by b),
tt as (select b, count(*) as t from t join hashed using (w) group by b),
both_ as (select b::bigint as b, coalesce(s, 0)::double as s, coalesce(t, 0)::double as t from range({buckets}) x(b) left join s using (b) left join tt using (b)),
g as (select b, floor(1000 * ln((t + 1) * (sum(s) over () + {buckets}) / ((s + 1) * (sum(t) over () + {buckets}))))::bigint as gain from both_),
f as (select r, count(*) as n, floor(sum(gain) / count(*))::bigint as weight from w join hashed using (w) join g using (b) group by r),
z as (select r, doc_id, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::bigint::double as h from d left join f using (r)),
p as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / {DIGITS})))::bigint as score, n_features >= {least_words} as fit from z),
q as (select *, row_number() over (order by fit desc, score desc, doc_id) as n, count(*) filter (fit) over () as fits from p)
select doc_id, n_features, weight, score, case when n <= fits * {percent} // 100 then n end::bigint as rank from q"""
