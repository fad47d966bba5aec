"""Main text of web pages: markup names the parts that are no text, a suffix array over each host's pages finds what all pages share.

A page becomes a stream of words: those of its article where it has one, else all words outside menus, footers, forms and
the like. The streams of a host's pages are concatenated, their suffixes sorted, and suffixes whose first ``DEPTH`` words are equal
stand together; where they come from enough distinct pages, those words are covered. A longer string on so many pages is made of such runs, so
the union of all long repeated strings is the union of these. Covered words are boilerplate and go; the unique runs stay.
Blocks that begin or end articles go on fewer pages already, as long as the articles beside them are different ones.

A host too large for one task is cut into blocks with a suffix array each. What enough of all pages hold, as large a share of some block's
pages holds: so the blocks name candidates, these are counted over all pages, and the result is that of one array over the whole host.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import KEPT, blocks, claim, written

#: words that suffixes share at least
DEPTH = 8
#: share of a host's pages, and number of pages at least, that hold what is boilerplate inside an article, and outside one
INSIDE, OUTSIDE = (0.6, 8), (0.1, 3)
#: the same for whole blocks that begin or end an article
EDGE = (0.4, 3)
#: articles are told apart by the least hashes of their runs under SIGNS functions; AGREE of these have to tell enough apart
SIGNS, AGREE = 32, 20
#: pages and bytes of html in a block
BLOCK_PAGES, BLOCK_BYTES = 1000, 16 << 20
#: rows of a table that is sent to every task
MOST_BROADCAST = 100_000

#: elements whose text no reader sees, or that are forms: fixed names of the markup language
_RAW = "script|style|noscript|template|iframe|object|canvas|textarea|select|title|head"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*)>|<[!?/][^>]*>", re.S | re.I)
_DROP = frozenset("nav header footer aside form button dialog menu label fieldset".split())
_MAIN = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot munder mover semantics annotation svg g text tspan".split()
)
_ATTR = re.compile(r"""\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: a class or id is unwanted if its first or its last part, or the whole of it, names a menu, header, footer, sidebar, notice, advert, form or comments
_FIRST = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comments disqus newsletter popup modal".split())
_LAST = frozenset("ad ads advert adverts advertisement sponsor nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead banner notice consent comments popup modal form".split())
_WHOLE = frozenset("header site-header page-header banner notice overlay comment comment-list comment-body replies respond subscribe signup login skip-link".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


def _named(value: str) -> bool:
    for name in value.lower().split():
        parts = re.split(r"[_-]+", name)
        if name in _WHOLE or parts[0] in _FIRST or parts[-1] in _LAST:
            return True
    return False


def _unwanted(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _DROP and not (inside and tag in ("header", "label")):
        return True
    for name, a, b, c in _ATTR.findall(attrs) if attrs and not attrs.isspace() else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in _ROLES):
            return True
        if name in ("class", "id") and _named(value) and tag not in ("html", "body"):
            return True
    return False


def streams(page: str | None) -> tuple[list[str], bool]:
    """The words that may be a page's main text, in page order, and whether they stand in an article."""
    parts, article = page_blocks(page)
    return [w for b in parts for w in b], article


def page_blocks(page: str | None) -> tuple[list[list[str]], bool]:
    """The words of each block (paragraph, heading and the like) that may be a page's main text, and whether they stand in an article.

    Broken markup is read as far as it goes: an end tag closes the last element of its name, one without a start is passed over.
    """
    page = page or ""
    inside: list[list[str]] = [[]]
    outside: list[list[str]] = [[]]
    open_: list[tuple[str, bool, bool]] = []  # name, unwanted, main
    bad = main = at = 0

    def text(s: str) -> None:
        if s and not bad:
            (inside if main else outside)[-1].append(s)

    def gap() -> None:
        if not bad and (parts := inside if main else outside)[-1]:
            parts.append([])

    def close(k: int) -> None:
        nonlocal bad, main
        for _, b, m in open_[k:]:
            bad -= b
            main -= m
        del open_[k:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag not in _INLINE:
            gap()
        if m[2]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    close(k)
                    break
                if open_[k][2] and tag not in _MAIN and tag not in ("body", "html"):
                    break  # a stray end tag doesn't leave the article
        elif tag not in _VOID:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and open_ and open_[-1][0] == tag:
                close(len(open_) - 1)
            unwanted, is_main = _unwanted(tag, m[4], main > 0), tag in _MAIN
            if unwanted or is_main or tag not in _INLINE and tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
                if not m[4].rstrip().endswith("/") or not unwanted:
                    open_.append((tag, unwanted, is_main and not unwanted))
                    bad += unwanted
                    main += is_main and not unwanted
        if tag not in _INLINE:
            gap()
    if at < len(page):
        text(page[at:])
    for parts, article in ((inside, True), (outside, False)):
        if found := [ws for b in parts if (ws := _html.unescape("".join(b)).split())]:
            return found, article
    return [], False


def suffix_groups(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a stream to ``depth`` symbols (a power of two), and for each rank whether it begins a new group of equal suffixes.

    Prefixes double each round: a suffix is ranked by the ranks of its first and second half. Suffixes that end before are shorter and differ.
    """
    n, rank = len(stream), stream.astype(np.int64)
    order, new = np.zeros(0, np.int64), np.zeros(0, bool)
    k = 0
    while True:
        half = 1 << (k - 1) if k else 0
        second = np.full(n, -1, np.int64)
        if half and half < n:
            second[:-half] = rank[half:]
        key = rank * (n + 2) + second + 1 if half else rank
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if 1 << k >= depth:
            return order, new
        k += 1


def _page_counts(pages: list[list[str]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The streams of all pages in one, and for each position its page and on how many pages the ``depth`` symbols from there on are. A symbol of its own ends each page, so that no run crosses into the next."""
    sizes, ends = np.array([len(p) for p in pages], np.int64), len(pages)
    known: dict[str, int] = {}
    flat = np.empty(int(sizes.sum()) + ends, np.int64)
    page = np.repeat(np.arange(ends), sizes + 1)
    at = 0
    for k, p in enumerate(pages):
        flat[at : at + len(p)] = [known.setdefault(w, len(known) + ends) for w in p]
        flat[at + len(p)] = k
        at += len(p) + 1
    order, new = suffix_groups(flat, depth)
    group = np.cumsum(new) - 1
    pair = np.unique(group * ends + page[order])
    held = np.bincount(pair // ends, minlength=int(group[-1]) + 1 if len(group) else 0)
    n_pages = np.empty(len(flat), np.int64)
    n_pages[order] = held[group]
    n_pages[flat < ends] = 0
    return flat, page, n_pages


def _need(rule: tuple[float, int], n: int) -> float:
    return max(rule[1], rule[0] * n)


def _covered_from(starts: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Which of ``n`` words lie in a run of ``depth`` words that begins where ``starts`` says."""
    reach = np.zeros(n + depth, np.int64)
    reach[: len(starts)] += starts
    reach[depth : depth + len(starts)] -= starts
    return np.cumsum(reach)[:n] > 0


def covered(pages: list[list[str]], article: list[bool], depth: int = DEPTH) -> list[np.ndarray]:
    """For each page, which of its words lie in a string of ``depth`` words or more that enough pages of the host hold."""
    if len(pages) < 2 or not any(pages):
        return [np.zeros(len(p), bool) for p in pages]
    flat, page, n_pages = _page_counts(pages, depth)
    inside = np.array(article, bool)[page]
    hit = _covered_from((n_pages >= np.where(inside, _need(INSIDE, len(pages)), _need(OUTSIDE, len(pages)))).astype(np.int64), len(flat), depth)
    out, at = [], 0
    for p in pages:
        out.append(hit[at : at + len(p)])
        at += len(p) + 1
    return out


_HASHES: dict[str, int] = {}
KEPT["page-words"] = _HASHES.clear
_MIX, _MOD = 0x9E3779B97F4A7C15, (1 << 64) - 1
_SIGNS = np.random.default_rng(4).integers(1, 1 << 63, SIGNS, dtype=np.uint64) | np.uint64(1)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def runs(words: list[str], depth: int = DEPTH) -> np.ndarray:
    """A hash of each run of ``depth`` words that is the same in every process."""
    claim("page-words")
    if len(_HASHES) > 400_000:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = _hash(w)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    out = np.zeros(max(0, len(h) - depth + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(depth):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(_MIX) + h[k : k + len(out)]
    return out


def signature(body: list[str], depth: int = DEPTH) -> np.ndarray:
    """The least hash of the runs of a body under each function; near copies agree in most. A shorter body is one run."""
    h = runs(body, depth)
    if not len(h):
        h = np.array([_hash(" ".join(body))], np.uint64)
    out = np.full(SIGNS, _MOD, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 4096):
            x = h[at : at + 4096, None] * _SIGNS
            out = np.minimum(out, (x ^ (x >> np.uint64(31))).min(0))
    return out


def page_edges(page: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
    """Sequences of blocks that begin a page (1), follow its first block (2) or end it (3), shorter ones first; never all blocks. Of each: which, its hash, and the words from and to which it goes."""
    hashes, ends = [_hash(" ".join(b)) for b in page], np.cumsum([0, *map(len, page)]).tolist()
    n = len(page)
    for mode in (1, 2, 3):
        x = mode
        for t in range(1, n if mode != 2 else n - 1):
            k = t - 1 if mode == 1 else t if mode == 2 else n - t
            x = ((x ^ (x >> 29)) * _MIX + hashes[k]) & _MOD
            yield mode, x, *((ends[0], ends[t]) if mode == 1 else (ends[1], ends[t + 1]) if mode == 2 else (ends[k], ends[n]))


def enough_apart(distinct: list[int]) -> int:
    """How many bodies are told apart by ``AGREE`` of the functions at least, from the number of distinct values under each."""
    return sorted(distinct, reverse=True)[AGREE - 1]


def edges(pages: list[list[list[str]]], article: list[bool]) -> set[int]:
    """Hashes of the sequences of first or last blocks (:func:`page_edges`) that enough articles of the host share, whose other blocks differ.

    First blocks may follow one block of the page's own, such as a title.
    """
    need, holders = _need(EDGE, len(pages)), defaultdict(list)
    for k, (p, a) in enumerate(zip(pages, article, strict=True)):
        for _, h, start, stop in page_edges(p) if a else ():
            holders[h].append((k, start, stop))
    found = set()
    for h, where in holders.items():
        if len(where) >= need:
            signs = np.array([signature(_rest(pages[k], start, stop)) for k, start, stop in where])
            if enough_apart([len(np.unique(signs[:, f])) for f in range(SIGNS)]) >= need:
                found.add(h)
    return found


def _rest(page: list[list[str]], start: int, stop: int) -> list[str]:
    words = [w for b in page for w in b]
    return words[:start] + words[stop:]


def edge_words(page: list[list[str]], found: set[int], depth: int = DEPTH) -> np.ndarray:
    """Which words of an article lie in one of the sequences ``found``, if it has ``depth`` words or more and the shorter ones in it are found too. An article never goes whole."""
    hit, over = np.zeros(sum(map(len, page)), bool), set()
    for mode, h, start, stop in page_edges(page) if found else ():
        if h not in found:
            over.add(mode)
        elif mode not in over and stop - start >= depth:
            hit[start:stop] = True
    return np.zeros_like(hit) if hit.all() else hit


def _split(words: str) -> list[list[str]]:
    return [b.split(" ") for b in words.split("\n")] if words else []


def _unique(page: list[list[str]], hit: np.ndarray) -> str:
    words = [w for b in page for w in b]
    return " ".join(w for w, h in zip(words, hit.tolist(), strict=True) if not h) if hit.any() else " ".join(words)


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a block's pages hold so often that the host's may: runs that may go from articles (kind 0) or from pages without one (2), and
    sequences of first and last blocks (1). Kind 3 says that the block has pages without an article."""
    pages, article = [_split(w) for w in pdf["words"]], pdf["article"].tolist()
    found, flat_pages = set(), [[w for b in p for w in b] for p in pages]
    if any(flat_pages):
        flat, page, n_pages = _page_counts(flat_pages, DEPTH)
        at = np.flatnonzero(n_pages >= OUTSIDE[0] * len(pages) - 1e-6)
        starts = np.cumsum([0, *(len(p) + 1 for p in flat_pages)])
        seen = set()
        for i in at.tolist():  # runs by their words' numbers, each named once
            if (run := flat[i : i + DEPTH].tobytes()) not in seen:
                seen.add(run)
                k = int(page[i])
                if len(some := flat_pages[k][i - int(starts[k]) :][:DEPTH]) == DEPTH:
                    found.add((0 if n_pages[i] >= INSIDE[0] * len(pages) - 1e-6 else 2, int(runs(some)[0])))
    often = Counter(h for p, a in zip(pages, article, strict=True) if a for h in {e[1] for e in page_edges(p)})
    found |= {(1, h) for h, n in often.items() if n >= EDGE[0] * len(pages) - 1e-6}
    if not all(article):
        found.add((3, 0))
    host = pdf["host"].iloc[0]
    rows = sorted(found)
    return pd.DataFrame({"host": pd.Series([host] * len(rows), dtype=object), "kind": [k for k, _ in rows], "hash": np.array([h for _, h in rows], np.uint64).view(np.int64)})


def _longs(value) -> np.ndarray:
    return np.array(value or [], np.int64).view(np.uint64)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block_pages: int = BLOCK_PAGES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row; text is '' where nothing is left. Null html is empty.

    White space counts as one space. Pages with a null url, or one without a host, are one host. A host of more than
    ``block_pages`` pages or ``block_bytes`` of html is worked on in blocks, with the same result. Repeated ids and pages keep their rows, null ids too;
    other columns are not read, whatever their names; an empty table gives none.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    kind = rows.schema["page_id"].dataType.simpleString()
    result = f"page_id {kind}, url string, text string, n_chars long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            got = [page_blocks(x) for x in batch.column("html").to_pylist()]
            own = {"words": pa.array(["\n".join(map(" ".join, b)) for b, _ in got], pa.string()), "article": pa.array([a for _, a in got], pa.bool_())}
            rest = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *own.values()], names=[*rest, *own])

    def parsed(df: DataFrame, more: str = "") -> DataFrame:
        return df.mapInArrow(parse, f"page_id {kind}, url string, host string{more}, words string, article boolean")

    def clean(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, article = [_split(w) for w in pdf["words"]], pdf["article"].tolist()
        first_last = edges(parts, article)
        hits = covered([[w for b in p for w in b] for p in parts], article)
        text = [_unique(p, h | edge_words(p, first_last) if a else h) for p, a, h in zip(parts, article, hits, strict=True)]
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(x) for x in text]})

    sizes = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / block_pages), F.ceil(F.coalesce(F.col("bytes"), F.lit(0)) / block_bytes)).cast("int")
    big = written(sizes.select("host", "n", parts.alias("parts")).where("parts > 1"), "large-hosts")
    n_big = big.count()
    if not n_big:
        return parsed(rows).repartition("host").groupBy("host").applyInPandas(clean, result)
    # a row for each large host, a few per million pages; sent to every task only if they are few
    near = F.broadcast(big) if n_big <= MOST_BROADCAST else big
    small = parsed(rows.join(near.select("host"), "host", "left_anti").select(*rows.columns)).repartition("host").groupBy("host").applyInPandas(clean, result)
    mine = rows.join(near, "host").select(*rows.columns, "n", F.pmod(F.xxhash64("page_id", "url", "html"), F.col("parts")).alias("part"))
    block = parsed(mine.drop("n"), ", part long").repartition("host", "part").groupBy("host", "part")
    named = written(block.applyInPandas(_candidates, "host string, kind int, hash long").distinct(), "page-candidates")
    bare = named.where("kind = 3").select("host")
    named = written(named.where("kind < 2").unionByName(named.where("kind = 2").join(bare, "host", "left_semi").withColumn("kind", F.lit(0))).distinct(), "page-candidates")

    def listed(found: DataFrame, *kinds: tuple[str, object]) -> DataFrame:
        """One row a host with a list of each kind; sent to every task only if the hashes are few. A host has ten times the runs of a page at most."""
        few = found.count() <= 10 * MOST_BROADCAST
        by = found.groupBy("host").agg(*[F.collect_list(F.when(c, F.col("hash"))).alias(name) for name, c in kinds])
        return F.broadcast(by) if few else by

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: Counter = Counter()
            for host, words, article, grams, ends in zip(*(batch.column(c).to_pylist() for c in ("host", "words", "article", "runs", "edges")), strict=True):
                page = _split(words)
                held, wanted = runs([w for b in page for w in b]), set(_longs(ends).tolist())
                out.update((host, 0, int(h), -1, 0) for h in np.intersect1d(held, _longs(grams)))
                for _, h, start, stop in page_edges(page) if article and wanted else ():
                    if h in wanted:
                        out.update((host, 1, h, f, int(v)) for f, v in enumerate(signature(_rest(page, start, stop))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), signed(cols[2]), pa.array(cols[3], pa.int32()), signed(cols[4]), pa.array(list(out.values()), pa.int64())], names=["host", "kind", "hash", "f", "value", "pages"])

    if named.isEmpty():
        rules = None
    else:
        asked = listed(named, ("runs", F.col("kind") == 0), ("edges", F.col("kind") == 1))
        pages_of = parsed(mine.select(*rows.columns).join(asked, "host").select(*rows.columns, "runs", "edges"), ", runs array<long>, edges array<long>")
        counted = pages_of.mapInArrow(count, "host string, kind int, hash long, f int, value long, pages long").groupBy("host", "kind", "hash", "f", "value").agg(F.sum("pages").alias("pages"))
        each = counted.groupBy("host", "kind", "hash", "f").agg(F.sum("pages").alias("pages"), F.count("*").alias("distinct"))
        total = each.groupBy("host", "kind", "hash").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list("distinct"), False).alias("distinct"))
        held = F.when(F.col("kind") == 0, F.col("pages")).otherwise(F.get("distinct", F.lit(AGREE - 1)))
        of = lambda rule: F.greatest(F.lit(float(rule[1])), F.lit(rule[0]) * F.col("n"))
        sure = total.withColumn("held", held).join(near.select("host", "n"), "host")
        sure = sure.select("host", "kind", "hash", (F.col("held") >= of(INSIDE)).alias("inside"), F.when(F.col("kind") == 0, F.col("held") >= of(OUTSIDE)).otherwise(F.col("held") >= of(EDGE)).alias("sure"))
        rules = written(sure.where("sure"), "page-rules")
        rules = None if rules.isEmpty() else listed(rules, ("inside", (F.col("kind") == 0) & F.col("inside")), ("outside", F.col("kind") == 0), ("edges", F.col("kind") == 1))
    lists = ("inside", "outside", "edges")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for words, article, *rule in zip(*(batch.column(c).to_pylist() for c in ("words", "article", *lists)), strict=True):
                page = _split(words)
                flat = [w for b in page for w in b]
                inside, outside, ends = map(_longs, rule)
                grams = inside if article else outside
                hit = np.zeros(len(flat), bool)
                if len(grams):
                    hit = _covered_from(np.isin(runs(flat), grams).astype(np.int64), len(flat), DEPTH)
                if article and len(ends):
                    hit = hit | edge_words(page, set(ends.tolist()))
                text.append(_unique(page, hit))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    none = F.lit(None).cast("array<long>")
    ruled = mine.select(*rows.columns).join(rules, "host", "left").select(*rows.columns, *lists) if rules is not None else mine.select(*rows.columns, *[none.alias(c) for c in lists])
    large = parsed(ruled, "".join(f", {c} array<long>" for c in lists)).mapInArrow(strip, result)
    return small.unionByName(large)
