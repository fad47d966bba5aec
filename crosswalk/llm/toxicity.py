"""Toxicity by compression distance: windows are compressed with dictionaries of toxic and of ordinary text.

Labelled texts are first put in groups by which raw dictionary shortens them most, so that texts of one language come together without any
column of theirs being looked at. In each group zstandard trains an ordinary dictionary, small enough to hold only what is frequent, and windows of toxic
documents, letters as they stand (A-Z lower-cased), are cut to the pieces that shorten windows of other toxic documents far more often than windows of ordinary ones
beside that dictionary. The pieces of all groups are the toxic dictionary, which lies before a group's ordinary one in its toxic compressor, so a window gets shorter there only by
what tells. A text goes to the group that shortens it most. A window's distance is its length under the ordinary dictionary less that under both, in bytes, both without frame; distances
have a log odds each in every group, learned with the labels, and a document's evidence is their sum over its overlapping windows by the root of their number. Isotonic
regression turns evidence into a probability.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswalk.llm.common import blocks, claim, column, used_up, with_row, words, written

#: words of a window, words from one to the next, and bytes from which a word is cut
WORDS, STEP, LONGEST = 8, 5, 64
#: bytes of a group's ordinary dictionary, which also tells groups apart
NEAR_BYTES = 1 << 13
#: bytes of the pieces that toxic windows are cut to
PIECES = (6, 8, 10, 14)
#: a piece tells if it shortens windows of so many toxic documents, of so many times the share of ordinary ones, and the shares differ by so many
#: deviations; groups so alike in cost become one
LEAST_DOCS, APART, SURE, ALIKE = 3, 4, 6.0, 1.2
#: one in so many windows of a text, from all of it, chooses its group; rows of either class that a group needs for odds of its own
SPREAD, ENOUGH = 12, 10
#: distances are clipped to these for their log odds
LOW, HIGH = -3, 15


def windows(text: str | None, step: int = STEP) -> list[bytes]:
    """Windows of ``WORDS`` words, one every ``step`` words; a text of fewer words has one, a text without words none."""
    ws = words(text)
    if ws and max(map(len, ws)) > LONGEST:
        ws = [w[a : a + LONGEST] for w in ws for a in range(0, len(w), LONGEST)]
    return [b" " + b" ".join(ws[a : a + WORDS]) + b" " for a in range(0, max(len(ws) - WORDS + step, min(1, len(ws))), step)]


def _compressor(raw: bytes):
    """Compresses a window with the dictionary ``raw``; nothing but the blocks themselves is written."""
    import zstandard as z

    log = max(10, (len(raw) + 4096).bit_length())
    params = z.ZstdCompressionParameters(
        window_log=log, chain_log=log, hash_log=log + 1, search_log=6, min_match=3, target_length=64, strategy=z.STRATEGY_LAZY2,
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    if len(raw) < 8:
        return z.ZstdCompressor(compression_params=params).compress
    known = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=known, compression_params=params).compress


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains; the samples' own last bytes where they are too few to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except z.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def group(docs: list[list[bytes]], groups: int = 8, rounds: int = 3, first: int = 800, each: int = 12, seed: int = 3) -> list[int]:
    """A group for every document, given by its windows: those that one dictionary shortens alike, such as those of one language.

    Dictionaries are moved as means are: a document goes to the one that shortens it most, then each is trained anew on its
    documents. They are moved on ``first`` documents, ``each`` windows of a document drawn from all of it; all documents are then dealt to them. Groups whose
    dictionaries serve each other's documents nearly as well (``ALIKE``) become one; those of fewer than twice ``ENOUGH`` documents end, and theirs go to others.
    """
    rng = random.Random(seed)
    some = [rng.sample(ws, min(len(ws), each)) for ws in docs]
    sizes = [max(1, sum(map(len, s))) for s in some]
    moved = [i for i in rng.sample(range(len(docs)), len(docs)) if some[i]][:first]
    if not moved:
        return [0] * len(docs)

    def costs(raw: bytes, of: list[int]) -> list[float]:
        f = _compressor(raw)
        return [sum(len(f(w)) for w in some[i]) / sizes[i] for i in of]

    raws = [b"".join(some[moved[0]])]
    cost = [costs(raws[0], moved)]
    while len(raws) < min(groups, len(moved)):
        # the next dictionary begins with a document that those so far shorten badly, but not with the oddest of all
        order = sorted(range(len(moved)), key=lambda j: min(c[j] for c in cost))
        raws.append(b"".join(some[moved[order[int(len(order) * 0.9)]]]))
        cost.append(costs(raws[-1], moved))
    for _ in range(rounds):
        own = [min(range(len(cost)), key=lambda k: cost[k][j]) for j in range(len(moved))]
        filled = [[w for j, o in enumerate(own) if o == k for w in some[moved[j]]] for k in range(len(cost))]
        raws = [_trained(rng.sample(ws, len(ws)), NEAR_BYTES) for ws in filled if ws]
        cost = [costs(r, moved) for r in raws]
    own = [min(range(len(cost)), key=lambda k: cost[k][j]) for j in range(len(moved))]
    into = list(range(len(raws)))
    mean = [[sum(cost[k][j] for j in range(len(moved)) if own[j] == g) / max(1, own.count(g)) for k in range(len(raws))] for g in range(len(raws))]
    for g in range(len(raws)):
        for k in range(g):
            if mean[g][k] < ALIKE * mean[g][g] and mean[k][g] < ALIKE * mean[k][k]:
                into = [into[k] if x == into[g] else x for x in into]
    held = Counter(into[o] for o in own)
    kept = [k for k in range(len(raws)) if held[into[k]] >= min(2 * ENOUGH, max(held.values()))]
    every = list(range(len(docs)))
    cost = {k: costs(raws[k], every) for k in kept}
    return [into[min(kept, key=lambda k: cost[k][i])] for i in every]


def _drawn(ws: list[bytes], n: int, rng: random.Random) -> list[bytes]:
    """At most ``n`` windows, drawn from the whole text."""
    return ws if len(ws) <= n else rng.sample(ws, n)


class Judges:
    """Windows of toxic and of ordinary documents that say whether bytes tell toxic text: if they shorten windows of far more toxic documents.

    Documents count, not windows, so that one that repeats itself has one vote.
    """

    def __init__(self, near: bytes, toxic: list[list[bytes]], ordinary: list[list[bytes]]):
        self.near, self.told, self.sizes = near, b"", (max(1, len(toxic) - 1), max(1, len(ordinary)))
        plain = _compressor(near)
        self.windows = [(y, i, w, len(plain(w))) for y, docs in ((1, toxic), (0, ordinary)) for i, ws in enumerate(docs) for w in ws]

    def hits(self, raw: bytes, among: list) -> list:
        """The windows that ``raw`` shortens beside the ordinary dictionary and what was told before."""
        f = _compressor(raw + self.told + self.near)
        return [x for x in among if len(f(x[2])) < x[3]]

    def worth(self, hits: list, source: int) -> float:
        """Share of toxic documents but the one that the bytes are from, less ``APART`` times that of ordinary ones; below 0 if the shares may differ by chance."""
        toxic, ordinary = len({x[1] for x in hits if x[0]} - {source}), len({x[1] for x in hits if not x[0]})
        n1, n0 = self.sizes
        both = (toxic + ordinary) / (n1 + n0)
        if toxic < LEAST_DOCS or toxic / n1 - ordinary / n0 < SURE * math.sqrt(both * (1 - both) * (1 / n1 + 1 / n0)):
            return -1.0
        return toxic / n1 - APART * (ordinary + 1) / n0

    def tell(self, parts: list[tuple[int, bytes]]) -> list[bytes]:
        """Pieces of ``parts``, each with the toxic document that it is from, that tell, the best first; each is judged beside those before it, so no two tell by the same windows."""
        some, found = self.hits(b"".join(p for _, p in parts), self.windows), []
        for a in range(0, len(parts), 8):
            near = self.hits(b"".join(p for _, p in parts[a : a + 8]), some)
            for k, (i, p) in enumerate(parts[a : a + 8], a):
                h = self.hits(p, near)
                if (w := self.worth(h, i)) > 0:
                    found.append((w, -k, i, p, h))
        found.sort()
        out: list[bytes] = []
        while found:
            _, k, i, part, own = found.pop()
            if self.told:
                f = _compressor(self.told + self.near)
                own = self.hits(part, [(y, i, w, len(f(w))) for y, i, w, _ in own])
                worth = self.worth(own, i)
                if worth <= 0:
                    continue
                if found and worth < found[-1][0] * 0.7:
                    insort(found, (worth, k, i, part, own))
                    continue
            best, piece = 0.0, b""
            for n in PIECES:  # a longer piece must be worth more
                for a in range(max(1, len(part) - n + 1)):
                    x = self.worth(self.hits(part[a : a + n], own), i)
                    if x > best * 1.1:
                        best, piece = x, part[a : a + n]
            if piece:
                self.told = piece + self.told
                out.append(piece)
                insort(found, (best, k, i, part, own))
        return out


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], judged: int = 150, each: int = 40, parts: int = 1500, seed: int = 7) -> tuple[bytes, bytes]:
    """The told pieces of toxic windows and the ordinary dictionary of one group of documents, given by their windows.

    One half of the ordinary documents trains the dictionary, ``2 * judged`` of the other half judge. Of ``judged`` toxic
    documents at most, ``parts`` windows at most are judged by the other documents. ``each`` windows of a document judge, drawn from all of it.
    """
    rng = random.Random(seed)
    toxic, ordinary = rng.sample(toxic, min(len(toxic), judged)), rng.sample(ordinary, len(ordinary))
    flat = [w for ws in ordinary[::2] for w in ws]
    rng.shuffle(flat)
    near = _trained(flat, NEAR_BYTES)
    judges = [[_drawn(ws, each, rng) for ws in side] for side in (toxic, ordinary[1::2][: 2 * judged])]
    of = [(i, w) for i, ws in enumerate(judges[0]) for w in ws]
    return b"".join(Judges(near, *judges).tell(rng.sample(of, min(len(of), parts)))), near


@dataclass
class Group:
    """The ordinary dictionary of a group, the log odds of distances from ``LOW`` to ``HIGH``, and the probability of toxic text from each of ascending evidences on."""

    ordinary: bytes = b""
    odds: list[float] = field(default_factory=list)
    steps: list[tuple[float, float]] = field(default_factory=list)

    def evidence(self, distances: list[int]) -> float:
        """The windows' log odds by the root of their number; without windows less than any other, as no words are no toxic ones."""
        if not distances or not self.odds:
            return -math.inf
        return sum(n * self.odds[min(max(d, LOW), HIGH) - LOW] for d, n in Counter(distances).items()) / math.sqrt(len(distances))

    def probability(self, evidence: float) -> float:
        at = bisect_right([e for e, _ in self.steps], evidence)
        return self.steps[max(at, 1) - 1][1] if self.steps else 0.0


@dataclass
class Model:
    """The toxic dictionary and groups with an ordinary one each."""

    toxic: bytes = b""
    groups: list[Group] = field(default_factory=lambda: [Group()])

    def __post_init__(self):
        self._pairs = None

    def distances(self, text: str | None) -> tuple[int, list[int]]:
        """The group whose ordinary dictionary shortens every ``SPREAD``-th window of the text most, and the distance of each window beside it."""
        if self._pairs is None:
            self._pairs = [(_compressor(g.ordinary), _compressor(self.toxic + g.ordinary)) for g in self.groups]
        ws = windows(text)
        own = min(range(len(self._pairs)), key=lambda k: sum(len(self._pairs[k][0](w)) for w in ws[::SPREAD])) if len(self._pairs) > 1 else 0
        ordinary, both = self._pairs[own]
        return own, [len(ordinary(w)) - len(both(w)) for w in ws]

    def judge(self, text: str | None) -> tuple[int, float]:
        """The largest distance of a window, 0 without any, and the probability that the text is toxic."""
        own, d = self.distances(text)
        return max(d, default=0), self.groups[own].probability(self.groups[own].evidence(d))


def log_odds(toxic: Counter, ordinary: Counter) -> list[float]:
    """Log odds of each clipped distance, with half a window added to each; never falling above 0, as saving more can't speak for ordinary text."""
    n1, n0 = sum(toxic.values()) + 1, sum(ordinary.values()) + 1
    out = [math.log((toxic[d] + 0.5) / n1) - math.log((ordinary[d] + 0.5) / n0) for d in range(LOW, HIGH + 1)]
    for k in range(1 - LOW, len(out)):
        out[k] = max(out[k], out[k - 1])
    return out


def _steps(points: list[tuple[float, int]], times: tuple[float, float] = (1, 1)) -> list[tuple[float, float]]:
    """Isotonic regression of the label on the evidence: blocks of rising means, each shrunk by half a row of either class. ``times``: how many rows an ordinary and a toxic one stand for."""
    by: dict[float, list[float]] = {}
    for d, y in points:
        s = by.setdefault(d, [0, 0])
        s[0] += y * times[1]
        s[1] += times[y]
    done: list[list[float]] = []
    for d in sorted(by):
        done.append([d, *by[d]])
        while len(done) > 1 and done[-2][1] * done[-1][2] >= done[-1][1] * done[-2][2]:
            last = done.pop()
            done[-1][1] += last[1]
            done[-1][2] += last[2]
    return [(float(d), (y + 0.5) / (n + 1)) for d, y, n in done]


def _sides(rows: list[tuple[str | None, int]]) -> tuple[list, list]:
    """Windows of the toxic and of the ordinary rows, in the order of a seeded draw that doesn't look at how rows came."""
    return tuple([windows(x, WORDS) for x, y in rows if int(y) == side] for side in (1, 0))


def calibrated(rows: list[tuple[str | None, int]], toxic: bytes, ordinary: list[bytes], times: tuple[float, float] = (1, 1)) -> Model:
    """The model of these dictionaries, with log odds and probabilities of each group's ``rows``, or of all where a group has fewer than ``ENOUGH`` of either class.

    ``times``: how many labelled rows an ordinary and a toxic one of ``rows`` stand for, where one class is drawn more thinly.
    """
    model = Model(toxic, [Group(x) for x in ordinary])
    found = [(*model.distances(x), int(y)) for x, y in rows]
    for k, g in enumerate(model.groups):
        own = [(d, y) for o, d, y in found if o == k]
        if min(sum(y for _, y in own), sum(not y for _, y in own)) < ENOUGH:
            own = [(d, y) for _, d, y in found]
        g.odds = log_odds(*[Counter(min(max(v, LOW), HIGH) for d, y in own if y == side for v in d) for side in (1, 0)])
        g.steps = _steps([(g.evidence(d), y) for d, y in own], times)
    return model


def one_class(rows: list[int]) -> Model | None:
    """Without rows of both classes, every text gets the share of toxic rows (0 without rows)."""
    n1 = sum(map(int, rows))
    return Model(groups=[Group(steps=[(0.0, n1 / max(1, len(rows)))])]) if not n1 or n1 == len(rows) else None


def fit_texts(rows: list[tuple[str | None, int]]) -> Model:
    """Fits a model to (text, toxic) rows in this process, as :func:`fit` does in tasks; a null text is empty."""
    if model := one_class([y for _, y in rows]):
        return model
    of = group([windows(x, WORDS) for x, _ in rows])
    pairs = [dictionaries(*_sides([r for r, o in zip(rows, of, strict=True) if o == g])) for g in sorted(set(of))]
    return calibrated(rows, b"".join(t for t, _ in pairs), [n for _, n in pairs])


def fit(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 4000) -> Model:
    """Fits on about ``sample`` labelled rows of either class at most, picked by a hash of their id: groups and calibration in one task each, the groups' dictionaries in a task for each group.

    ``usable``: a condition on ``id_col``; other rows are not looked at. Of several labels of a document, the highest counts; null ones
    don't, nor do null ids. Rows that share an id are rows of their own with one label. Other columns of either table are not read, whatever
    their names; empty tables give a model that scores 0.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").where(usable)
    known = known.groupBy("doc_id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.when(F.col("y") == 1, sample / max(sample, n.get(1, 0))).otherwise(sample / max(sample, n.get(0, 0)))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))
    times = tuple(max(1.0, n.get(y, 0) / sample) for y in (0, 1))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the picked ids number about twice ``sample``, whatever the size of the tables
    rows = written(texts.join(F.broadcast(picked), "doc_id"), "toxic-sample")
    if model := one_class([r["y"] for r in rows.select("y").collect()]):
        used_up(rows)
        return model

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("toxic")
        pdf = pdf.sort_values(["doc_id", "text"])
        return pdf[["doc_id", "text", "y"]].assign(of=group([windows(x, WORDS) for x in pdf["text"]]))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("toxic")
        pdf = pdf.sort_values(["doc_id", "text"])
        toxic, ordinary = dictionaries(*_sides(list(zip(pdf["text"], pdf["y"], strict=True))))
        return pd.DataFrame({"of": pdf["of"].iloc[:1].astype("int32"), "toxic": [toxic], "ordinary": [ordinary]})

    def calibrate(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("toxic")
        pdf = pdf.sort_values(["doc_id", "text"])
        m = calibrated(list(zip(pdf["text"], pdf["y"], strict=True)), toxic, ordinary, times)
        return pd.DataFrame({"k": range(len(m.groups)), "odds": [g.odds for g in m.groups], "steps": [[{"e": e, "p": p} for e, p in g.steps] for g in m.groups]})

    once = rows.withColumn("one", F.lit(1))
    dealt = written(once.groupBy("one").applyInPandas(deal, "doc_id long, text string, y int, of int"), "toxic-groups")
    pairs = sorted(dealt.groupBy("of").applyInPandas(learn, "of int, toxic binary, ordinary binary").collect())
    toxic, ordinary = b"".join(bytes(r["toxic"]) for r in pairs), [bytes(r["ordinary"]) for r in pairs]
    got = once.groupBy("one").applyInPandas(calibrate, "k int, odds array<double>, steps array<struct<e double, p double>>").orderBy("k").collect()
    used_up(rows, dealt)
    return Model(toxic, [Group(o, list(r["odds"]), [(x["e"], x["p"]) for x in r["steps"]]) for o, r in zip(ordinary, got, strict=True)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, distance (the largest of a window, in bytes), score and predicted (1 from a score of 0.5 on) of every row.

    Null and empty texts, and those without words, have distance 0 and the lowest score. ``carry``: return each row of ``docs`` too, as the struct row, whatever
    its columns' names. Repeated and null ids keep their rows; an empty table gives none.
    """
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    toxic, groups = model.toxic, model.groups
    cols, text = with_row(docs, id_col, text_col, carry)
    schema = StructType([f for f in cols.schema.fields if f.name != "__text"]).add("distance", IntegerType()).add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxic")
        m = Model(toxic, groups)
        for batch in blocks(batches, text):
            d, p = zip(*map(m.judge, column(batch, text).to_pylist()), strict=True)
            rest = batch if carry else batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(d, pa.int32()), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], names=[*rest.schema.names, "distance", "score", "predicted"])

    return cols.mapInArrow(run, schema)
