"""Language identification by unigrams of pieces, summed over every segmentation of a word.

The vocabulary is fixed and public: the letter pieces of a tokenizer file, and its 256 bytes for characters that are no piece. Each
language has a probability for every piece. A word's probability is the sum, over all ways to cut it into pieces, of the product of their
probabilities, which a forward pass over the word's lattice gives. Training is expectation maximisation of the same sum: a backward pass
gives how often each piece is expected in the words of a language, and these expectations are the next round's counts.

Words are runs of letters and marks in lower case (``\\pL`` and ``\\pM``), each after the mark that begins a word in the vocabulary; all else
separates words. A word has no greatest length.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from crosswalk.llm.common import KEPT, blocks, claim, column, used_up, with_row, written

#: rounds of expectation maximisation, the count that every piece has besides, and the greatest number of languages, which bounds the model
ROUNDS, SMALL, LANGUAGES = 3, 0.1, 500
UNDETERMINED = "und"
#: words of a lattice block, and words whose values a worker keeps
BLOCK, KEEP = 40_000, 1_000_000
START = "▁"


class Vocabulary:
    """Pieces of letters as a trie in sorted arrays, so that all positions of many words walk it together."""

    def __init__(self, pieces: list[str]):
        """``pieces`` by id; ``<0x00>`` to ``<0xFF>`` stand for bytes. Other pieces with anything but lower-case letters and marks are left out."""
        self.size, self.bytes = len(pieces), np.full(256, -1)
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, p in enumerate(pieces):
            if len(p) == 6 and p.startswith("<0x"):
                self.bytes[int(p[3:5], 16)] = i
                continue
            letters = p.removeprefix(START)
            if not p or p != p.lower() or any(unicodedata.category(c)[0] not in "LM" for c in letters):
                continue
            at = 0
            for c in p:
                key = (at, ord(c))
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                at = nodes[key]
            ends[at] = i
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.next, self.ends = keys[order], np.array(list(nodes.values()), np.int64)[order], np.array(ends, np.int64)
        self.used = np.array(sorted({*self.ends[self.ends >= 0].tolist(), *self.bytes.tolist()}))
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary must have the 256 bytes, or some characters have no piece")

    def lattice(self, words: list[str]) -> Lattice:
        text = np.frombuffer("".join(f"{START}{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.flatnonzero(text == 0)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        at = np.flatnonzero(text)
        node, depth, found = np.zeros(len(at), np.int64), 0, []
        begin = at
        while len(begin):
            key = (node << 21) | text[begin + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            begin, node = begin[hit], self.next[k[hit]]
            depth += 1
            whole = self.ends[node] >= 0
            found.append((begin[whole], begin[whole] + depth, self.ends[node[whole]]))
        alone = np.zeros(len(text), bool)
        if found:
            alone[found[0][0]] = True
        bare = at[~alone[at]]
        chars, which = np.unique(text[bare], return_inverse=True)
        spelled = [[int(self.bytes[b]) for b in chr(c).encode("utf-8", "surrogatepass")] for c in chars.tolist()]
        parts = [*found, (bare, bare + 1, self.size + which)]
        a, b, piece = (np.concatenate([p[k] for p in parts]) for k in range(3))
        word = np.repeat(np.arange(len(words)), np.diff(np.concatenate([starts, [len(text)]]))) if len(words) else np.zeros(0, np.int64)
        step = b - starts[word[a]]
        order = np.lexsort((b, step))
        return Lattice(self.size, starts, ends, word, a[order], b[order], piece[order], step[order], spelled)


@dataclass
class Lattice:
    """Words one after the other, a node before each character and one at a word's end; edges are pieces, by the characters before their end."""

    size: int
    starts: np.ndarray
    ends: np.ndarray
    word: np.ndarray
    a: np.ndarray
    b: np.ndarray
    piece: np.ndarray
    step: np.ndarray
    spelled: list[list[int]]

    def edge_values(self, logs: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each edge's piece in every language, or in the language ``own`` of its word. ``logs``: piece by language."""
        if self.spelled:
            logs = np.concatenate([logs, [logs[s].sum(0) for s in self.spelled]])
        return logs[self.piece] if own is None else logs[self.piece, own[self.word[self.a]]][:, None]

    def forward(self, values: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each node's prefix over all segmentations; ``share`` gets that of every edge in its end's."""
        at = np.full((len(self.word), values.shape[1]), -np.inf)
        at[self.starts] = 0.0
        for x, y in self.steps():
            v = at[self.a[x:y]] + values[x:y]
            b = self.b[x:y]
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            n = np.diff(np.concatenate([first, [y - x]]))
            top = np.maximum.reduceat(v, first)
            e = np.exp(v - np.repeat(top, n, axis=0))
            total = np.add.reduceat(e, first)
            at[b[first]] = top + np.log(total)
            if share is not None:
                share[x:y] = e / np.repeat(total, n, axis=0)
        return at

    def steps(self) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.concatenate([[True], self.step[1:] != self.step[:-1], [True]])) if len(self.step) else [0]
        return list(zip(cuts[:-1], cuts[1:]))

    def scores(self, logs: np.ndarray) -> np.ndarray:
        """Log probability of every word in every language."""
        return self.forward(self.edge_values(logs))[self.ends] if len(self.ends) else np.zeros((0, logs.shape[1]))

    def expect(self, logs: np.ndarray, own: np.ndarray, times: np.ndarray, counts: np.ndarray) -> None:
        """Adds to ``counts`` (piece by language) how often each piece is expected in the words, each ``times`` its number, of language ``own``."""
        values = self.edge_values(logs, own)
        share = np.empty_like(values)
        self.forward(values, share)
        share = share[:, 0]
        through = np.zeros(len(self.word))
        through[self.ends] = times
        for x, y in reversed(self.steps()):
            share[x:y] *= through[self.b[x:y]]
            # a node begins one edge of a word at most for each end
            through[self.a[x:y]] += share[x:y]
        n, lang = counts.shape[1], own[self.word[self.a]]
        known = self.piece < self.size
        counts += np.bincount(self.piece[known] * n + lang[known], share[known], counts.size).reshape(counts.shape)
        for i in np.flatnonzero(~known):
            np.add.at(counts, (self.spelled[self.piece[i] - self.size], lang[i]), share[i])


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python worker and file."""
    claim("languages")
    if path not in _VOCABULARIES:
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        _VOCABULARIES[path] = Vocabulary([s.id_to_piece(i) for i in range(s.vocab_size())])
    return _VOCABULARIES[path]


def split_words(texts: pa.Array) -> pa.ListArray:
    """Words of each text, a null one having none; the empty words at either end stay and are to be skipped."""
    c = pyarrow.compute
    # a few letters' lower case has a mark that isn't part of the letter; marks stay in words
    return c.split_pattern(c.replace_substring_regex(c.utf8_lower(c.fill_null(texts, "")), r"[^\pL\pM]+", " "), " ")


@dataclass
class Model:
    """Ascending languages, log probabilities (piece by language) and the languages' log shares of the documents."""

    languages: list[str]
    logs: np.ndarray
    prior: np.ndarray

    def choose(self, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Of summed log probabilities of texts, the likeliest language (the first of equal ones) and its posterior probability."""
        x = sums + self.prior
        best = x.argmax(1)
        return [self.languages[k] for k in best.tolist()], 1 / np.exp(x - x.max(1, keepdims=True)).sum(1)


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, word and n: how often each word is in the texts of each language. Added up within blocks of texts before it is shuffled."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("languages")
        for batch in blocks(batches):
            ws = split_words(batch.column("text"))
            lang = batch.column("lang").take(pyarrow.compute.list_parent_indices(ws))
            got = pa.table({"lang": lang, "word": ws.flatten()}).group_by(["lang", "word"], use_threads=False).aggregate([([], "count_all")])
            got = pa.table({"lang": got["lang"], "word": got["word"], "n": got["count_all"]}, schema=schema)
            yield from got.filter(pyarrow.compute.not_equal(got["word"], "")).to_batches(max_chunksize=100_000)

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, usable, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS) -> Model:
    """Learns from the rows of ``docs`` that ``usable``, a condition on ``id_col``, admits and whose language and text aren't null.

    Words are counted once; each round reads the counted words and adds up expectations in its partitions, at most a number for each
    piece and language from each, then over all. Only these sums, bounded by the vocabulary and ``LANGUAGES``, reach the driver; more languages
    than that are refused. Without any row the model has no language. Repeated rows count as often as they are there; other columns aren't read.
    """
    rows = docs.where(usable)
    known = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().limit(LANGUAGES + 1).collect()
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    shares = {r["lang"]: r["count"] for r in sorted(known, key=lambda r: r["lang"].encode())}
    names, n = list(shares), len(shares)
    vocab = vocabulary(path)
    if not n:
        return Model([], np.zeros((vocab.size, 0)), np.zeros(0))
    counted = written(word_counts(rows, lang_col, text_col), "language-words")
    prior = np.log(np.array(list(shares.values()), float) / sum(shares.values()))
    logs = np.full((vocab.size, n), -np.inf)
    logs[vocab.used] = -np.log(len(vocab.used))
    index, spark = {x: k for k, x in enumerate(names)}, docs.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(logs)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            v, logs, counts = vocabulary(path), sent.value, None
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    b = batch.slice(at, BLOCK)
                    if counts is None:
                        counts = np.zeros(logs.shape)
                    own = np.array([index[x] for x in b.column("lang").to_pylist()])
                    v.lattice(b.column("word").to_pylist()).expect(logs, own, b.column("n").to_numpy().astype(float), counts)
            if counts is not None:
                flat = counts.ravel()
                k = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(flat[k])], names=["k", "x"])

        got = counted.mapInArrow(expect, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros(logs.size)
        flat[got["k"].to_numpy(dtype=np.int64)] = got["x"].to_numpy(dtype=float)
        found = flat.reshape(logs.shape)[vocab.used] + SMALL
        logs = np.full(logs.shape, -np.inf)
        logs[vocab.used] = np.log(found / found.sum(0))
        sent.destroy()
    used_up(counted)
    return Model(names, logs, prior)


class Known:
    """Words' log probabilities in every language, kept between texts and worked out together for new words."""

    def __init__(self, vocab: Vocabulary, logs: np.ndarray):
        self.vocab, self.logs = vocab, logs
        self.at: dict[str, int] = {}
        self.values = np.zeros((0, logs.shape[1]))

    def __call__(self, words: list[str]) -> np.ndarray:
        """``words`` are distinct; an empty one counts nothing."""
        if len(self.at) + len(words) > KEEP:
            self.at, self.values = {}, self.values[:0]
        new = [w for w in words if w not in self.at]
        parts = [self.values]
        # words of like length together, so that a long one has few beside it
        new.sort(key=len)
        for k in range(0, len(new), BLOCK):
            part = new[k : k + BLOCK]
            got = self.vocab.lattice(part).scores(self.logs)
            if not part[0]:
                got[: sum(not w for w in part)] = 0.0
            parts.append(got)
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.values = np.concatenate(parts)
        return self.values[[self.at[w] for w in words]]


def _forget() -> None:
    _VOCABULARIES.clear()
    _KNOWN.clear()


_KNOWN: dict[str, Known] = {}
KEPT["languages"] = _forget


def identify(docs: DataFrame, model: Model, path: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (the posterior probability of the language, from the whole text) of every row.

    Null texts and those without a letter are ``und`` with score 0, as is every text where the model has no language. With ``carry`` each
    row of ``docs`` comes back too as the struct row, whatever its columns' names. Repeated and null ids keep their rows; an empty table gives none.
    """
    cols, text = with_row(docs, id_col, text_col, carry)
    schema = StructType([f for f in cols.schema.fields if f.name != "__text"]).add("lang_pred", StringType()).add("score", DoubleType())
    names, prior = model.languages, model.prior
    sent, key = docs.sparkSession.sparkContext.broadcast(model.logs), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, v, m = pyarrow.compute, vocabulary(path), Model(names, sent.value, prior)
        if key not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[key] = Known(v, m.logs)
        known = _KNOWN[key]
        for batch in blocks(batches, text):
            texts = column(batch, text)
            lettered = c.fill_null(c.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            pred, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if names and lettered.any():
                ws = split_words(texts)
                of = c.list_parent_indices(ws).to_numpy()
                flat = ws.flatten().dictionary_encode()
                values, codes = known(flat.dictionary.to_pylist()), flat.indices.to_numpy()
                # words of a text one after the other: sums by text
                sums = np.stack([np.bincount(of, values[codes, k], batch.num_rows) for k in range(len(names))], 1)
                best, sure = m.choose(sums)
                pred = [x if ok else UNDETERMINED for x, ok in zip(best, lettered.tolist(), strict=True)]
                score = np.where(lettered, np.minimum(sure, 1.0), 0.0)
            rest = batch if carry else batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*rest.schema.names, "lang_pred", "score"])

    return cols.mapInArrow(run, schema)
