"""Languages by all segmentations, centroids by annulus search and importance resampling, against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crosswalk.llm import centroids, importance, language
from crosswalk.llm.common import train_rows

BYTES = [f"<0x{b:02X}>" for b in range(256)]


def segmentations(word, pieces):
    """All ways to cut ``word`` into pieces; a character that no piece is by itself may be its bytes."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [(word[:n],), *rest]
    if word and word[0] not in pieces:
        for rest in segmentations(word[1:], pieces):
            yield [tuple(f"<0x{b:02X}>" for b in word[0].encode()), *rest]


def test_forward_sums_all_segmentations_and_backward_gives_expectations():
    pieces = ["<s>", *BYTES, "▁", "a", "b", "▁a", "ab", "ba", "bab", "▁ba", "é", "Ab", "a1"]
    v = language.Vocabulary(pieces)
    assert "Ab" not in [pieces[i] for i in v.used] and "a1" not in [pieces[i] for i in v.used]
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(len(pieces)), 3)).T
    usable, at = {pieces[i] for i in v.used} - set(BYTES), {p: i for i, p in enumerate(pieces)}
    words = ["a", "abab", "babba", "cab", "éa", "zz", "b" * 9, "", "ab"]
    lattice = v.lattice(words)
    got = lattice.scores(logs)
    for w, x in zip(words, got, strict=True):
        for lang in range(3):
            ways = [math.prod(math.exp(logs[at[p], lang]) for part in s for p in part) for s in segmentations("▁" + w, usable)]
            assert x[lang] == pytest.approx(math.log(sum(ways)))
    own, times = np.array([0, 1, 2] * 3), np.arange(9) + 1.0
    counts = np.zeros(logs.shape)
    lattice.expect(logs, own, times, counts)
    want = np.zeros(logs.shape)
    for w, lang, n in zip(words, own, times, strict=True):
        ways = [(math.prod(math.exp(logs[at[p], lang]) for part in s for p in part), s) for s in segmentations("▁" + w, usable)]
        for q, s in ways:
            for p in itertools.chain(*s):
                want[at[p], lang] += n * q / sum(x for x, _ in ways)
    assert np.allclose(counts, want)
    # a word of any length, whose probability is far below the least double
    long = v.lattice(["ab" * 30_000, "a"]).scores(logs)
    assert np.isfinite(long).all() and long[1] == pytest.approx(got[0]) and (long[0] < -10_000).all()
    with pytest.raises(ValueError):
        language.Vocabulary(["a", "<0x00>"])


def _spoken(n, seed=5):
    rng = random.Random(seed)
    syllables = {"aa": "ka to mi re su na".split(), "bb": "schl ung ker tz oft pf".split(), "cc": "é eau oi ière ç ou".split()}
    out = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        out.append((i, " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 40))).capitalize(), lang))
    return out


def test_languages_held_out_and_edges(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = _spoken(240) + [(900, None, "aa"), (901, "", "aa"), (902, "12 -- 34", "bb"), (903, "katona", None), (None, "schlung kertz", "bb"), (904, "katomi " * 60_000 + "x" * 20_000, "aa"), (3, "katomi", "aa"), (905, "ウ", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("row", F.lit("mine")).withColumn("score", F.lit("own"))
    model = language.fit(docs, train_rows("doc_id", 3, 1), path)
    assert model.languages == ["aa", "bb", "cc"] and np.allclose(np.exp(model.logs).sum(0), 1) and math.isclose(np.exp(model.prior).sum(), 1)
    got = language.identify(docs, model, path).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    held = [(by[i][0]["lang_pred"], lang) for i, _, lang in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (900, 901, 902))
    assert by[903][0]["lang_pred"] == by[904][0]["lang_pred"] == "aa" and by[None][0]["lang_pred"] == "bb" and len(by[3]) == 2 and by[905][0]["lang_pred"] in model.languages
    # the whole of it in plain Python for a few words
    v = language.vocabulary(path)
    for i in (0, 1, 2):
        _, text, _ = rows[i]
        x = sum(v.lattice([w]).scores(model.logs)[0] for w in text.lower().split()) + model.prior
        assert by[i][0]["score"] == pytest.approx(float(np.exp(x.max() - np.logaddexp.reduce(x)))) and by[i][0]["lang_pred"] == model.languages[int(x.argmax())]
    carried = language.identify(docs, model, path, carry=True)
    assert carried.columns == ["doc_id", "row", "lang_pred", "score"] and carried.where("row.row = 'mine' and row.score = 'own'").count() == len(rows)
    # ids and languages say nothing
    other = language.identify(docs.withColumn("doc_id", F.col("doc_id") + 7).withColumn("lang", F.lit("cc")), model, path)
    assert sorted(r["score"] for r in other.collect()) == sorted(r["score"] for r in got)
    none = language.fit(docs.where("false"), train_rows("doc_id", 3, 1), path)
    assert not none.languages and {(r["lang_pred"], r["score"]) for r in language.identify(docs, none, path).collect()} == {("und", 0.0)}
    assert language.identify(docs.where("false"), model, path).count() == 0
    with pytest.raises(ValueError):
        language.fit(docs.withColumn("lang", F.concat("lang", F.col("doc_id").cast("string"))).unionByName(spark.range(600).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").cast("string").alias("lang"), F.lit("").alias("row"), F.lit("").alias("score"))), F.lit(True), path)


def test_words_are_counted_whole(spark):
    docs = spark.createDataFrame([("aa", "Ab ab, x1y"), ("aa", "ab"), ("bb", "ab É"), (None, "ab"), ("aa", None), ("bb", "")], "lang string, text string")
    assert {tuple(r) for r in language.word_counts(docs).collect()} == {("aa", "ab", 3), ("aa", "x", 1), ("aa", "y", 1), ("bb", "ab", 1), ("bb", "é", 1)}


def test_rings_compare_as_few_and_find_the_same():
    rng = np.random.default_rng(2)
    far = (rng.normal(size=(64, 8)) * rng.uniform(1, 40, size=(64, 1)) * 100).astype(np.int64)
    cases = [
        (rng.integers(-3, 4, (3000, 2)), np.array([[0, 1], [1, 0], [0, -1], [0, 1], [-1, 0], [2, 2], [0, 0]])),  # ties everywhere, norms too, and a repeated centroid
        (rng.integers(-9, 9, (500, 3)), np.zeros((1, 3), np.int64)),
        ((rng.normal(size=(4000, 8)) * rng.uniform(1, 40, size=(4000, 1)) * 100).astype(np.int64), far),
        (np.full((2, 64), centroids.LARGEST), np.stack([np.full(64, -centroids.LARGEST), np.full(64, centroids.LARGEST)])),
    ]
    for x, c in cases:
        number, best, compared = centroids.Rings(c).nearest(x)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (number == d.argmin(1)).all() and (best == d.min(1)).all()
    number, best, compared = centroids.Rings(far).nearest(cases[2][0])
    assert compared < 0.6 * 4000 * 64


def _means(vectors, k, rounds, dims, seed):
    kept = []
    for i, v in vectors:
        if v is not None and len(v) == dims and all(a is not None and math.isfinite(a) for a in v):
            kept.append((i, [math.floor(1024 * float(np.float32(a))) for a in v]))
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cs = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cs = [[sum(col) // len(own[n]) for col in zip(*own[n])] if own[n] else c for n, c in enumerate(cs)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, n, d in out:
        inertia[n] += d
    return sorted((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, n, d in out)


def test_centroids_against_plain_python(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(a) for a in rng.normal(size=4).astype(np.float32)]) for i in range(150)] + [(200 + i, [0.5, -0.25, 0.0, -1e-9]) for i in range(60)]
    bad = [(300, None), (301, []), (302, [1.0, 2.0, 3.0]), (303, [1.0, None, 3.0, 4.0]), (304, [1.0, float("nan"), 3.0, 4.0]), (305, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("mine")).repartition(5)
    for k, rounds in ((8, 10), (1, 2), (500, 1)):
        got = centroids.clustered(df, centroids.fit(df, k, rounds, dims=4), dims=4)
        assert sorted(map(tuple, got.collect())) == _means(vectors + bad, k, rounds, 4, 3)
    none = df.where("vec_id > 299")
    assert centroids.clustered(none, centroids.fit(none, dims=4), dims=4).collect() == [] == centroids.clustered(df.where("false"), centroids.fit(df.where("false"), dims=4), dims=4).collect()
    twice = df.where("vec_id < 5").unionByName(df.where("vec_id < 5")).unionByName(df.where("vec_id = 7").withColumn("vec_id", F.lit(None).cast("long")))
    assert centroids.clustered(twice, centroids.fit(twice, dims=4), dims=4).count() == 11
    large = spark.createDataFrame([(1, [3e38] * 4), (2, [-3e38] * 4)], "vec_id long, embedding array<float>")
    assert {r["distance"] for r in centroids.clustered(large, centroids.fit(large, 2, dims=4), dims=4).collect()} == {0}


def _counts(text, order, buckets):
    ws = re.findall(importance.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[a : a + n]) for n in range(1, order + 1) for a in range(len(ws) - n + 1)]
    return len(ws), len(grams), sorted(collections.Counter(zlib.crc32(g.encode()) % buckets for g in grams).items())


@pytest.mark.parametrize("order", [1, 3])
def test_bucket_counts_of_whole_texts(spark, monkeypatch, order):
    monkeypatch.setattr(importance, "PIECE", 40)
    texts = ["Ab ab. C3PO;née ÉÉ ", None, "", "?!", "x", "a\0b\tc\nÀ-d", "word " * 300 + "the End", "y" * 500, "Ab ab. C3PO;née ÉÉ ", "a b", "漢字 と kana", "a'b" * 70]
    got = importance.counter(order, 97)(pa.array(texts)).to_pylist()
    assert {r["k"]: (r["n_words"], r["n_features"], list(zip(r["b"], r["n"]))) for r in got} == {k: c for k, t in enumerate(texts) if (c := _counts(t, order, 97))[1]}
    docs = spark.createDataFrame([*enumerate(texts), (None, "a a"), (0, "again")], "doc_id long, text string").withColumn("b", F.lit("clash"))
    rows = importance.bucket_counts(docs, order=order, buckets=97).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_features"], list(zip(r["b"] or [], r["n"] or []))) for r in rows) == sorted((-1 if i is None else i, *_counts(t, order, 97)) for i, t in [*enumerate(texts), (None, "a a"), (0, "again")])


def test_resampling_against_plain_python(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("aa bb cc dd ee ff gg".split()) + str(rng.randrange(9)) for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(200, None), (201, ""), (202, "aa1 " * 5000)]
    target = [(1, "aa1 bb2 aa3 aa4"), (2, None), (3, "Aa1 zz")]
    buckets, least = 50, 20
    s, t = collections.Counter(), collections.Counter()
    for out, rows in ((s, docs), (t, target)):
        for _, x in rows:
            for b, n in _counts(x, 1, buckets)[2]:
                out[b] += n
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    want = []
    for i, x in docs:
        words, n, counts = _counts(x, 1, buckets)
        weight = sum(gain[b] * c for b, c in counts) // n if n else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    fit = sorted((r for r in want if r[4] >= least), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(fit[: len(fit) * 10 // 100])}
    frames = [spark.createDataFrame(rows, f"{c} long, text string").withColumn("rank", F.lit("clash")).repartition(4) for c, rows in (("doc_id", docs), ("item_id", target))]
    got = importance.resampled(*frames, buckets=buckets)
    assert sorted(map(tuple, got.collect())) == sorted((*r[:4], rank.get(r[0])) for r in want)
    assert [d for _, d in got.dtypes] == ["bigint"] * 5
    empty = frames[0].where("false")
    assert importance.resampled(empty, frames[1]).collect() == [] and importance.resampled(frames[0], frames[1].where("false"), buckets=buckets).count() == len(docs)
    odd = frames[0].where("doc_id = 202").withColumn("doc_id", F.lit(None).cast("long")).unionByName(frames[0].where("doc_id = 202")).unionByName(frames[0].where("doc_id = 202"))
    assert [r["rank"] for r in importance.resampled(odd, frames[1], percent=100).orderBy("rank").collect()] == [1, 2, 3]
