"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions alone.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the text's, and, with ``least``, the
smallest ``least`` hashes whatever they are, so that a short text keeps all. Sketches of parts merge to the whole's by union (without ``least``),
and of two documents of any sizes the share of one's kept hashes that the other keeps estimates how much of it the other contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import parts_for, range_of, range_starts

#: words in a shingle; one in SCALE hashes is kept
SIZE, SCALE = 5, 4
#: hashes that a text of any length keeps, if it has as many
LEAST = 64
LONGEST = (1 << 63) - 1


def _below(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale


def _once(a: Column, f) -> Column:
    """``f`` of a value that is bound once, as the only element of an array, and not made anew for each element of another."""
    return F.element_at(F.transform(F.array(a), f), 1)


def sketch(text: Column, size: int = SIZE, scale: int = SCALE, least: int = 0) -> Column:
    """Ascending distinct hashes below 1/``scale`` of the range, of the lower-cased text's shingles of ``size`` words; the ``least`` smallest at least.

    Words are ``[^\\x20\\x09-\\x0D]+``. Fewer words are one shingle; a text without words, or null, has none. A shingle's hash is that of its words' hashes.
    """
    hashes = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    whole = lambda h: F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    each = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(size)]))
    made = _once(hashes, lambda h: F.when(F.size(h) >= size, each(h)).otherwise(whole(h)))
    if not least:
        return F.array_sort(F.array_distinct(F.filter(made, lambda h: h < F.lit(_below(scale)))))
    return _once(F.array_sort(F.array_distinct(made)), lambda a: F.when(F.size(a) <= least, a).otherwise(F.filter(a, lambda h, k: (k < least) | (h < F.lit(_below(scale))))))


def bound(a: Column, scale: int = SCALE, least: int = 0) -> Column:
    """The largest value up to which a sketch has every hash of its text. One of fewer than ``least`` hashes has all."""
    return F.when(F.size(a) < least, F.lit(LONGEST)).otherwise(F.greatest(F.lit(_below(scale) - 1), F.array_max(a)))


def _common(a: Column, b: Column, scale: int, least: int) -> tuple[Column, Column]:
    """Two sketches up to where both have every hash."""
    if not least:
        return a, b
    upto = F.least(bound(a, scale, least), bound(b, scale, least))
    part = lambda x: F.when(F.array_max(x) <= upto, x).otherwise(_once(upto, lambda u: F.filter(x, lambda h: h <= u)))
    return part(a), part(b)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column, scale: int = SCALE, least: int = 0) -> Column:
    """Estimated share of common shingles among all of both (0 to 1). Two empty sketches are alike: with ``least``, only texts without words have such."""
    x, y = _common(a, b, scale, least)
    both = F.size(F.array_intersect(x, y))
    all_ = F.size(x) + F.size(y) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def contained(a: Column, b: Column, scale: int = SCALE, least: int = 0) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 if the first has none.

    Null if the first is so short, and the second so long, that none of the first's hashes is in the part of the range that both keep.
    """
    x, y = _common(a, b, scale, least)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))


def as_string(a: Column) -> Column:
    """A sketch as text: its hashes, with all their 64 bits, in base 64."""
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), ""))), r"\s", "")


#: ranges at most, so that their starts (some 60 bytes each, a few MB) may be sent to every task; beyond, ranges get more rows
MOST_RANGES = 50_000


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 3000, before=None) -> DataFrame:
    """doc_id and text of every row, and each further column made by ``before`` from them, each with the next row's (next_...).

    Rows follow each other by ascending id, null ids at the end, equal ids by their text's first 32 characters, then by a hash of it; the first row
    follows the last. Rows are dealt to even ranges of that order, whose starts are a column, and the first row of a range goes to the range before it too,
    so no task sees more than a range, one id may fill many of them and texts move once. Rows alike in id and text lie in one range.
    Other columns are not read; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LONGEST)).alias("key"), F.substring("text", 1, 32).alias("begin"), F.xxhash64("text").alias("hash"))
    parts = parts_for(rows, rows_each, most=MOST_RANGES)
    starts = range_starts(rows, order, parts).withColumn("__one", F.lit(1))
    # a single row, of MOST_RANGES starts at most
    rows = rows.withColumns({"__order": order, "__one": F.lit(1)}).join(F.broadcast(starts), "__one")
    rows = rows.withColumn("__own", range_of(F.col("starts"), F.col("__order")))
    here = F.array(F.struct(F.col("__own").alias("b"), F.lit(0).alias("g")))
    first = F.get("starts", F.col("__own")) == F.col("__order")
    ahead = F.when(first & (F.col("__own") > 0), F.array(F.struct((F.col("__own") - 1).alias("b"), F.lit(1).alias("g"))))
    round_ = F.when(first & (F.col("__own") == 0), F.array(F.struct((F.size("starts") - 1).alias("b"), F.lit(2).alias("g"))))
    none = F.array().cast("array<struct<b:int,g:int>>")
    places = F.concat(here, F.coalesce(ahead, round_, none))
    dealt = rows.withColumn("__place", F.explode(places)).select("doc_id", "text", "__order", F.col("__place.b").alias("__b"), F.col("__place.g").alias("__g")).repartition(parts, "__b")
    made = dealt.withColumns(before(F.col("text"))) if before else dealt
    from pyspark.sql import Window

    w = Window.partitionBy("__b").orderBy("__g", "__order")
    kept = [c for c in made.columns if not c.startswith("__")]
    return made.select(*kept, "__g", *[F.lead(c).over(w).alias(f"next_{c}") for c in kept if c != "doc_id"]).where("__g = 0").drop("__g")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 0) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and how alike they and the next row's are; see :func:`with_next` for the order.

    The edited text has the next row's first code points, as many as there are, in place of its own last half.
    ``least`` is as in :func:`sketch`; with 0, short texts may have empty sketches, which count as alike.
    """
    rows = with_next(docs, id_col, text_col, before=lambda text: {"sketch": sketch(text, least=least)})
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited"), least=least).alias("edited_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), least=least).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch"), least=least).alias("near_next"),
        contained(F.col("sketch"), F.col("edited_sketch"), least=least).alias("contained_edited"), F.size("sketch").alias("n_hashes"),
    )
