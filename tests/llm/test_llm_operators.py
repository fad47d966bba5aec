"""Each operator against brute force on small tables with nulls, empty and long texts, repeated rows, no rows and columns that clash."""

import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosswalk.llm import boilerplate, common, fingerprint, katz, mixing, near_dup, packing, quality, queries, token_index, toxicity, transport
from crosswalk.llm.components import components
from crosswalk.llm.queries import tokenizer_path

#: clashing names: columns that operators make themselves
KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, row string, component_id long, rep long, sketch string, piece int, bucket int, words string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    (5, "The cat sat on the mat and ran"), (3, None), (9, ""), (7, "  \t\n "), (2, "The cat sat on the mat and ran"), (11, LONG), (None, "no id here at all today"), (4, "one two"),
    (4, "one two"), (4, "another text with the same id as others have"), (13, "Ünï cödé 😀 text\x0bwith\x0codd\x1cspace  it's 3.5%"), (12, LONG + " more"),
]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en" if i != 5 else None, f"s{(i or 0) % 3}", len(t or ""), 0.5, 7, "r", 1, 2, "s", 3, 4, "w") for i, t in texts], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, TEXTS).limit(0)


def test_katz(docs, none):
    got = katz.scores(docs, F.col("doc_id") != 2).collect()
    assert len(got) == len(TEXTS) and katz.scores(none, F.lit(True)).count() == 0
    tk = [(i, [*common.words(t), None], i is not None and i != 2) for i, t in TEXTS]
    c1 = collections.Counter(w for _, t, l in tk if l for w in t)
    c2 = collections.Counter(x for _, t, l in tk if l for x in zip(["<s>", *t], t))
    n, v = sum(c1.values()), len(c1)
    d1, d2 = katz.discounts(collections.Counter(c1.values())), katz.discounts(collections.Counter(c2.values()))
    kept = lambda d, c: c * (d[c] if c <= katz.K else 1)
    left = 1 - sum(kept(d1, c) for c in c1.values()) / n
    p1 = lambda w: kept(d1, c1[w]) / n if w in c1 else left
    after = collections.defaultdict(dict)
    for (h, w), c in c2.items():
        after[h][w] = c
    weights = {}
    for h, x in after.items():
        m, k = sum(x.values()), sum(kept(d2, c) for c in x.values())
        m += m - k < 1e-9
        weights[h] = m, (1 - k / m) / (1 - sum(map(p1, x)))

    def p(h, w):
        if h not in after:
            return p1(w)
        c = after[h].get(w)
        return kept(d2, c) / weights[h][0] if c else weights[h][1] * p1(w)

    for h in list(after)[:50]:  # exactly normalised, with one share for all unseen words
        assert sum(p(h, w) for w in c1) + weights[h][1] * left == pytest.approx(1, abs=1e-9)
    want = sorted((i if i is not None else -1, len(t), sum(w in c1 for w in t), n, round(sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in t), 4), round(sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t)), 4)) for i, t, _ in tk)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in got) == want


def test_katz_without_training_rows(docs):
    got = katz.scores(docs, F.lit(False)).collect()
    assert len(got) == len(TEXTS) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(0) for r in got)


@pytest.mark.parametrize("counts", [{}, {1: 5}, {1: 100, 2: 40, 3: 20, 4: 11, 5: 7, 6: 5}, {1: 3, 2: 50, 6: 1}, {4: 9}])
def test_discounts_lie_between_0_and_1(counts):
    d = katz.discounts(counts)
    assert len(d) == katz.K + 1 and ((d > 0) & (d <= 1)).all()


def sketch_of(text):
    xxhash = pytest.importorskip("xxhash")
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in __import__("re").split(r"[\x20\x09-\x0d]+", (text or "").lower()) if w]
    out = set()
    for k in range(max(1 if h else 0, len(h) - 4)):
        v = 42
        for x in h[k : k + 5]:
            v = xxhash.xxh64_intdigest(struct.pack("<Q", x), v)
        v -= (v >> 63) << 64
        if v < -(1 << 63) + (1 << 64) // fingerprint.SCALE:
            out.add(v)
    return out


def test_fingerprints(docs, none):
    assert fingerprint.fingerprints(none).count() == 0
    order = sorted(((i if i is not None else 1 << 62, t or "") for i, t in TEXTS))
    want = []
    for k, (i, t) in enumerate(order):
        nxt, h = order[(k + 1) % len(order)][1], len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        a, b, c = sketch_of(t), sketch_of(e), sketch_of(nxt)
        like = lambda x, y: round(len(x & y) / len(x | y), 9) if x | y else 1.0
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), like(a, b), like(a, c), len(a)))
    got = fingerprint.fingerprints(docs).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), r["n_hashes"]) for r in got) == sorted(want)
    by = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in got}
    assert by[5, 30] == by[2, 30]


def test_fingerprints_over_many_ranges(spark):
    rows = [(i * 7, f"text {i} " + " ".join(str((i * k) % 17) for k in range(i % 40))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(d, rows_each=11).collect()}
    assert a == {i: rows[(k + 1) % 300][1] for k, (i, _) in enumerate(rows)}


def test_sketches_merge(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t", "k l m n o p q r s t u v w x y z"
    d = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b"))
    assert d.select(fingerprint.merged(F.col("a"), F.col("b"))).first()[0] == sorted(sketch_of(a) | sketch_of(b))


def test_short_texts_keep_their_hashes(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    texts = ["", " "] + [words(n) for n in (*range(1, 14), *range(1, 14), 64, 68, 69, 120, 900) for _ in range(4)]
    texts += [x + " more" for x in texts]
    got = fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=fingerprint.LEAST).collect()

    def shingles(x):
        w = x.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1 if w else 0, len(w) - 4))}

    for r in got:
        t, nxt = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = shingles(t), shingles(e), shingles(nxt)
        assert (r["n_hashes"] == 0) == (not a) and r["n_hashes"] >= min(len(a), fingerprint.LEAST)
        for got_, x in ((r["near_edited"], b), (r["near_next"], c)):
            like = len(a & x) / len(a | x) if a | x else 1.0
            assert got_ == pytest.approx(like, abs=1e-9 if max(len(a), len(x)) < fingerprint.LEAST else 0.2)
        if max(len(a), len(b)) < fingerprint.LEAST:
            assert r["contained_edited"] == pytest.approx(len(a & b) / len(a) if a else 1.0)
    # a text against its near copy of one word more
    pairs = spark.createDataFrame([(x, x + " more") for x in texts[2:54]], "a string, b string").select(*[fingerprint.sketch(F.col(c), least=fingerprint.LEAST).alias(c) for c in "ab"], F.col("a").alias("t"))
    for r in pairs.select("t", fingerprint.likeness(F.col("a"), F.col("b"), least=fingerprint.LEAST).alias("like")).collect():
        a, b = shingles(r["t"]), shingles(r["t"] + " more")
        assert r["like"] == pytest.approx(len(a & b) / len(a | b))


def toxic_rows(n=600, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "er", "on", "th", "re")) for _ in range(rng.randrange(1, 6)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(rng.randrange(5, 120))]
        y = int(i % 8 == 0)
        for _ in range(rng.randrange(1, 4) * y):
            ws[rng.randrange(len(ws))] = rng.choice(("vile", "scum,", "Rotten"))
        out.append((i, " ".join(ws), y))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    d = spark.createDataFrame([r[:2] for r in rows] + [(9999, None), (9998, "")], "doc_id long, text string").withColumn("predicted", F.lit("x"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, common.train_rows("doc_id", 5, 0))
    got = {r["doc_id"]: r for r in toxicity.score(d, model, carry=True).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 602 and got[9999]["predicted"] == 0 and got[9999]["row"]["predicted"] == "x"
    assert sum(got[i]["predicted"] == y for i, y in held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert toxicity.score(docs, model).where("score = 0 and predicted = 0").count() == len(TEXTS) and toxicity.score(none, model).count() == 0
    one = toxicity.fit(docs, spark.createDataFrame([(5, 1)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(docs, one).where("score = 1").count() == len(TEXTS)


NAV = '<nav><ul><li><a href="/a">Home</a></li></ul></nav>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><body>" + NAV + "<article><h1>Title</h1><p>A <b>bo</b>ld  &amp; x&#233;<br>y<p>Z</article><footer>f</footer>", "Title A bold & xé y Z"),
        ("<body><script>var a='<p>no</p>';</script><main><p>in</p><aside>no</aside><form>no</form><div class='comments'><p>no</p></div><p>end</p></main>", "in end"),
        ("<div class=\"post\"><p>kept</p></div><div id='cookie-notice'>no</div><!-- <p>no</p> -->", "kept"),
        ("plain &lt;text&gt; &nbsp; here", "plain <text> here"),
        ("<article><p>open <a title=\"a>b\" href='x'>link</a> tail", "open link tail"),
        ("<article></div></section><p>a</p></article>", "a"),
        ("", ""), (None, ""), ("<p", ""), ("<article><nav>only</nav></article>", ""), ("<ARTICLE><P CLASS=ad>no<P>yes</ARTICLE>", "yes"),
    ],
)
def test_page_streams(page, want):
    assert " ".join(boilerplate.streams(page)[0]).replace("<p", "") == want


def test_suffix_groups_against_brute_force():
    rng = np.random.default_rng(1)
    for n, depth in ((0, 8), (1, 8), (50, 2), (300, 8), (500, 4)):
        s = rng.integers(0, 3, n)
        order, new = boilerplate.suffix_groups(s, depth)
        keys = [tuple(s[i : i + depth].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and all((keys[i] != keys[i - 1]) == new[i] for i in range(1, n))
        assert len(set(keys)) == new.sum()


def test_boilerplate_goes_and_shared_passages_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    notice, passage = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(60))
    pages, want = [], {}
    for i in range(30):
        own = " ".join(word() for _ in range(40))
        body = own + (" " + passage if i % 3 == 0 else "")
        pages.append((i, f"http://h.test/{i}", f"<article><p>{body}</p><p>{notice}</p></article>"))
        want[i] = body
    pages += [(100, None, None), (100, None, None), (101, "not a url", ""), (102, "http://one.test/", f"<p>{notice}</p>")]
    want |= {101: "", 102: notice}
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "article": F.lit(2), "n": F.lit(3)})
    got = boilerplate.main_text(d).collect()
    assert len(got) == 34 and all(r["text"] == want.get(r["page_id"], "") and r["n_chars"] == len(r["text"]) for r in got)
    assert boilerplate.main_text(d.limit(0)).count() == 0
    assert {r["page_id"]: r["text"] for r in boilerplate.main_text(d, block_pages=20).collect()}.keys() == {r["page_id"] for r in got}


def test_first_and_last_blocks_of_some_articles_go(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    first, last, more, passage, copied = text(9), text(12), text(5), text(60), text(50).split()
    pages, want = [], {}

    def add(i, host, own, *blocks):
        pages.append((i, f"http://{host}.test/{i}", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
        want[i] = " ".join(own)

    for i in range(20):  # half of a host's pages
        own = [text(3), text(30), text(20)]
        add(i, "half", own, own[0], *([first] if i % 2 else []), *own[1:], *([last, more] if i % 2 else []))
    for i in range(20, 24):  # a host of four pages
        own = [text(40), text(10)]
        add(i, "few", own, *([first] if i < 23 else []), *own, *([last] if i < 23 else []))
    for i in range(28, 40):  # a passage that a third of the articles end with
        own = [text(3), text(30), *([passage] if i % 3 == 0 else [])]
        add(i, "third", own, *own)
    for i in range(40, 46):  # copies and near copies of one article, blocks of its own each
        own = [text(4), " ".join([*copied[:25], *([f"edit{i}"] if i % 2 else []), *copied[25:]]), passage]
        add(i, "copies", own, *own)
    for i in range(50, 55):  # pages of the notice alone, and two articles with it
        own = [last] if i < 53 else [text(30), last]
        add(i, "alone", own, *own)
    got = boilerplate.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == want


def test_raking_holds_the_marginals():
    rng = np.random.default_rng(4)
    cells = pd.DataFrame([(s, g, t, int(rng.integers(1, 1000))) for s in "abc" for g in "xy" for t in "pq"], columns=["source", "lang", "topic", "tokens"])
    goals = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.3, "q": 0.7}}
    w = mixing.rake(cells, goals, 60)
    for d, goal in goals.items():
        assert (pd.Series(w).groupby(cells[d]).sum() / w.sum()).to_dict() == pytest.approx(goal)
    p = mixing.probabilities(cells["tokens"].to_numpy(float), w, 0.6)
    assert ((p > 0) & (p <= 1)).all() and (p * cells["tokens"]).sum() == pytest.approx(0.6 * cells["tokens"].sum())


def test_mixing(docs, none):
    got = mixing.mixed(docs)
    assert got.count() == len(TEXTS) and got.where("__weight is null or __probability is null or __sampled is null").count() == 0
    assert mixing.mixed(none).count() == 0 and mixing.select_mixed(docs).columns == docs.columns
    assert mixing.select_mixed(docs, budget=1.0).count() == len(TEXTS)


def test_transport(spark, docs, none):
    got = transport.digests(transport.store(docs)).collect()
    assert len(got) == len(TEXTS) and transport.digests(transport.store(none)).count() == 0
    by = {r["doc_id"]: r for r in got}
    raw = LONG.encode()
    pad = raw + bytes(-len(raw) % 64)
    r = by[11]
    assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["breaks"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]), 0)
    assert by[3]["payload_bytes"] == 64 and by[3]["payload_sha256"] == hashlib.sha256(bytes(64)).hexdigest() == by[9]["payload_sha256"] and by[5]["media_sha256"] == by[2]["media_sha256"]
    back = {r["doc_id"]: r for r in transport.read(transport.store(docs)).collect()}
    assert bytes(back[11]["payload"]) == pad and back[11]["units"][1]["time"] == transport.TICKS and back[11]["units"][4]["random_access"] and not back[11]["units"][1]["random_access"]


def test_transport_reads_what_is_stored(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_transport(spark, str(tmp_path))
    files = got.inputFiles()
    assert files and all("media" in f for f in files) and "media" in spark.read.parquet(*files).columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, transport.digests(transport.store(docs)).collect()))


def test_damaged_streams():
    data = random.Random(5).randbytes(60_000)
    m = transport.mux(data)
    for n in (0, 1, 63, 160, 161, 162, 176, 8192, 8193):
        assert transport.demux(transport.mux(data[:n])).data == data[:n]
    whole = transport.demux(m)
    assert whole.data == data and whole.breaks == whole.bad_tables == 0 and whole.programs == {1: transport.PMT_PID} and whole.streams == {transport.ES_PID: transport.STREAM_TYPE}
    lost = transport.demux(m[: 188 * 50] + m[188 * 51 :])
    assert lost.breaks == 1 and len(lost.units) == len(whole.units)
    twice = transport.demux(m[: 188 * 50] + m[188 * 49 :])
    assert twice.breaks == 0 and twice.data == data
    assert transport.demux(b"junk" + m + b"\x47tail").data == data and transport.demux(b"").units == []
    bad = bytearray(m)
    bad[10] ^= 1
    assert transport.demux(bytes(bad)).bad_tables == 1 and transport.demux(bytes(bad)).data == data


def plain_ids(text, end):
    from tokenizers import Tokenizer

    t = plain_ids.__dict__.setdefault("t", Tokenizer.from_file(tokenizer_path()))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs, none):
    got = packing.pack_documents(docs, tokenizer_path(), 0, 64).collect()
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
    want = collections.Counter()
    for i, t in TEXTS:
        ids = plain_ids(t, 0)
        for k, at in enumerate(range(0, len(ids), 64)):
            want[i, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64


def test_pieces_of_many_partitions(spark):
    d = spark.range(2400, numPartitions=1200).select(F.col("id").alias("doc_id"), F.lit(LONG[:1000]).alias("text"))
    some = [0, 1073, 1074, 1199]
    got = spark.sparkContext.runJob(packing.pieces_of(d, tokenizer_path(), 0, 64).rdd, list, some)
    assert {r["doc_id"] for r in got} == {2 * p + k for p in some for k in (0, 1)} and len({r["at"] for r in got}) == len(got) > 16
    assert all(0 <= r["at"] < 1 << 63 for r in got)


def test_local_search_raises_the_squared_fill():
    rng, gained = random.Random(6), 0
    for _ in range(30):
        lengths = [rng.randrange(18, 60) for _ in range(200)]
        found = []
        for rounds in (0, 8):
            used = collections.Counter()
            for w, n in zip(packing.pack(lengths, 100, rounds)[0], lengths):
                used[w] += n
            assert max(used.values()) <= 100 and sum(used.values()) == sum(lengths)
            found.append((len(used), sum(n * n for n in used.values())))
        assert found[1][0] <= found[0][0] and found[1][1] >= found[0][1]
        gained += found[1][1] > found[0][1]
    assert gained and packing.pack([], 10) == ([], [])


def brute_components(texts, threshold=75):
    sets = []
    for i, t in texts:
        w = common.words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if None in (texts[a][0], texts[b][0]) or not sets[a] or not sets[b]:
                continue
            n = len(sets[a] & sets[b])
            if texts[a][0] == texts[b][0] or 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(texts):
        r = root(k)
        low[r] = min(low.get(r, 1 << 62), i if i is not None else 1 << 62)
    return collections.Counter((i, len(sets[k]), None if i is None else low[root(k)]) for k, (i, _) in enumerate(texts))


def test_near_duplicates(spark, docs, none):
    got = near_dup.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(TEXTS)
    assert near_dup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [4000, 24])
def test_near_duplicates_of_chains_and_crowds(spark, block):
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = []
    for i in range(60):  # each differs from the one before in one word, so the ends are not alike
        base = [*base]
        base[rng.randrange(80)] = f"n{i}"
        rows.append((1000 - i, " ".join(base)))
    crowd = [f"c{k}" for k in range(100)]
    for i in range(40):
        x = [*crowd]
        x[i * 2] = f"z{i}"
        rows.append((2000 + i, " ".join(x)))
    rows += [(3000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50))) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(d, block=block).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(9)
    for j in (0.75, 0.9, 0.97):
        errors = []
        for _ in range(20):
            n = 400
            both = rng.integers(0, 1 << 63, int(n * j), dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 63, (n - len(both)) // 2, dtype=np.uint64)]) for _ in range(2))
            x, y = (np.frombuffer(near_dup.odd_sketch(near_dup.min_hashes(s)), np.uint64) for s in (a, b))
            errors.append(near_dup.likeness(np.bitwise_count(x ^ y).sum()) - j)
        assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.08


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (100, 100), (90, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 100: 90}
    assert components(e.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(800):
        ws = [word() for _ in range(rng.randrange(20, 200))]
        bad = i % 5 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad and i % 2 else w + " |" if bad else w for w in ws), int(not bad)))
    d = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5000, None), (None, "")], "doc_id long, text string").withColumn("x", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None), (1, 0)], "doc_id long, quality int")
    got = quality.classify(d, labels, common.train_rows("doc_id", 3, 1), carry=True).collect()
    assert len(got) == 803 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got) and got[0]["row"]["x"] == "clash"
    held = [(r["predicted"], rows[r["doc_id"]][2]) for r in got if r["doc_id"] is not None and r["doc_id"] < 800 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_quality_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, labels, F.lit(True)).where("score = 0").count() == len(TEXTS)
    assert quality.classify(none, labels, F.lit(True)).count() == 0
    x, v = quality.isotonic(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0.0, 3.0, 1.0, 4.0]), np.array([4.0, 4.0, 4.0, 4.0]))
    assert list(x) == [0.0, 1.5, 3.0] and (np.diff(v) > 0).all()


def test_token_index(docs, none):
    shards = token_index.write_shards(docs, tokenizer_path(), 1, shard_ids=1000, rows_each=4)
    got = token_index.read_shards(shards).collect()
    assert shards.count() > 2 and token_index.read_shards(token_index.write_shards(none, tokenizer_path(), 1)).count() == 0
    at, want = 0, []
    for i, t in sorted(TEXTS, key=lambda x: (x[0] if x[0] is not None else -1, x[1] or "")):
        ids = plain_ids(t, 1)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == want
    row = shards.first()
    shard = token_index.Shard(common.read_file(row["path"] + ".idx"), common.read_file(row["path"] + ".bin"))
    assert shard.get(shard.ids[0]).tolist()[-1] == 1 and shard.get(123_456_789) is None


def test_perfect_hash():
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        h = token_index.PerfectHash.build(keys)
        assert sorted(h(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_index.PerfectHash.build(np.array([1, 1], np.uint64))
    assert len(set(token_index.keys_of([1, 1, None, None, 0, -1]).tolist())) == 6
