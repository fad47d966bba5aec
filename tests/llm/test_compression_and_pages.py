"""Toxicity by compression and main text by suffix arrays against plain versions of what they are to compute."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosswalk.llm import boilerplate, toxicity


def rows_of(n=400, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "er", "on", "th", "re")) for _ in range(rng.randrange(1, 6)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(rng.randrange(5, 120))]
        y = int(i % 6 == 0)
        for _ in range(rng.randrange(2, 5) * y):
            ws[rng.randrange(len(ws))] = rng.choice(("vile", "scum,", "Rotten", "disgusting"))
        out.append((i, " ".join(ws), y))
    return out


def test_windows_cover_whole_texts():
    assert toxicity.windows(None) == toxicity.windows(" \n ") == [] and toxicity.windows("a B") == [b" a b "]
    for n in (1, 7, 8, 9, 12, 13, 40, 1001):
        ws = [f"w{k}" for k in range(n)]
        got = toxicity.windows(" ".join(ws))
        assert list(dict.fromkeys(w for x in got for w in x.decode().split())) == ws and all(len(x.split()) <= 8 for x in got)
    assert b"".join(x.replace(b" ", b"") for x in toxicity.windows("y" * 5000, 8)) == b"y" * 5000


def test_distances_and_calibration_against_plain_versions():
    import zstandard as z

    rows = rows_of()
    m = toxicity.fit_texts([(x, y) for _, x, y in rows])
    assert all(len(g.ordinary) > 1000 for g in m.groups) and m.toxic and set(m.toxic) <= set(range(256))

    def length(w, raw):  # a compressor made anew for each window
        log = max(10, (len(raw) + 4096).bit_length())
        p = z.ZstdCompressionParameters(window_log=log, chain_log=log, hash_log=log + 1, search_log=6, min_match=3, target_length=64, strategy=z.STRATEGY_LAZY2, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
        d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return len(z.ZstdCompressor(dict_data=d, compression_params=p).compress(w))

    for _, x, _ in rows[:12]:
        own, d = m.distances(x)
        g = m.groups[own]
        assert d == [length(w, g.ordinary) - length(w, m.toxic + g.ordinary) for w in toxicity.windows(x)]
        costs = [sum(length(w, o.ordinary) for w in toxicity.windows(x)[:: toxicity.SPREAD]) for o in m.groups]
        assert own == costs.index(min(costs)) and m.judge(x) == (max(d), g.probability(g.evidence(d)))
    rng = random.Random(1)
    counts = [collections.Counter(rng.randrange(toxicity.LOW, toxicity.HIGH) // (2 - y) for _ in range(500)) for y in (1, 0)]
    odds = toxicity.log_odds(*counts)
    plain = [math.log((counts[0][v] + 0.5) / (sum(counts[0].values()) + 1)) - math.log((counts[1][v] + 0.5) / (sum(counts[1].values()) + 1)) for v in range(toxicity.LOW, toxicity.HIGH + 1)]
    assert odds[: 1 - toxicity.LOW] == pytest.approx(plain[: 1 - toxicity.LOW])
    assert odds[1 - toxicity.LOW :] == pytest.approx([max(plain[-toxicity.LOW : k + 1]) for k in range(1 - toxicity.LOW, len(plain))])
    points = sorted((rng.randrange(30) / 4, int(rng.random() < 0.1 + 0.03 * k)) for k in range(25) for _ in range(6))
    model, e, y = toxicity.Group(steps=toxicity._steps(points)), np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    at = np.unique(e)
    for x in at:  # isotonic regression is the largest of the least means over intervals; its blocks are shrunk by half a row of either class
        want = max(min(y[(e >= a) & (e <= b)].mean() for b in at[at >= x]) for a in at[at <= x])
        same = [i for i, q in enumerate(e) if model.probability(q) == model.probability(x)]
        assert y[same].mean() == pytest.approx(want) and model.probability(x) == pytest.approx((y[same].sum() + 0.5) / (len(same) + 1))
    g = m.groups[0]
    assert g.evidence([]) == -math.inf and g.evidence([0, 0, 99]) == pytest.approx((2 * g.odds[-toxicity.LOW] + g.odds[-1]) / math.sqrt(3))
    # ordinary rows that stand for three each count as if they were there three times
    assert toxicity._steps([(1.0, 0), (1.0, 1), (2.0, 1)], (3, 1)) == toxicity._steps([(1.0, 0)] * 3 + [(1.0, 1), (2.0, 1)])


def test_letters_decide_not_a_list_of_words():
    rows = rows_of(900)
    m = toxicity.fit_texts([(x, y) for _, x, y in rows if _ % 5])
    score = lambda x: m.judge(x)[1]
    held = [(score(x), y) for i, x, y in rows if i % 5 == 0]
    assert sum((p >= 0.5) == y for p, y in held) / len(held) > 0.95
    plain = "thanre erthon anreth ononer thereon anther rethan eronth"
    # a word that was never seen, made of a toxic word's letters
    assert score(plain) < 0.5 < score(plain.replace("thereon", "undisgustingly rottenness"))


def two_languages(n=1400, seed=11):
    """Toxic text of the first language has insults; that of the second only begins words with syllables that ordinary words of it seldom begin with."""
    rng = random.Random(seed)
    sides = [("an", "er", "on", "th", "re", "ing", "ed"), ("schl", "ung", "keit", "lich", "ach", "ver", "tz", "pf")]
    out = []
    for i in range(n):
        lang = i % 2
        word = lambda: "".join(rng.choice(sides[lang]) for _ in range(rng.randrange(1, 5)))  # noqa: E731, B023
        ws = [word() for _ in range(rng.randrange(60, 200))]
        ws = [w for w in ws if not w.startswith("achlich")]
        y = int(i % 7 == 0)
        for _ in range(y * max(3, len(ws) // 20)):
            ws[rng.randrange(len(ws))] = rng.choice(("vile", "scum,", "Rotten")) if not lang else "achlich" + word()
        out.append((i, " ".join(ws), y, lang))
    return out


def test_both_languages_are_learned_without_being_named():
    rows = two_languages()
    groups = toxicity.group([toxicity.windows(x, 8) for _, x, _, _ in rows])
    assert len({(g, lang) for g, (_, _, _, lang) in zip(groups, rows, strict=True)}) == len(set(groups))  # no group holds both
    m = toxicity.fit_texts([(x, y) for i, x, y, _ in rows if i % 5])
    held = [(int(m.judge(x)[1] >= 0.5), y, lang) for i, x, y, lang in rows if i % 5 == 0]
    for lang in (0, 1):
        found = [p for p, y, own in held if y and own == lang]
        assert sum(found) / len(found) >= 0.8
    assert sum(p for p, y, _ in held if not y) <= 0.01 * sum(not y for _, y, _ in held)


def test_pieces_tell_beside_what_was_told():
    rows = two_languages(420)
    toxic, ordinary = ([toxicity.windows(x, 8)[:20] for _, x, y, lang in rows if y == side and not lang] for side in (1, 0))
    near = b" ".join(w for ws in ordinary[:20] for w in ws)[:4000]
    j = toxicity.Judges(near, toxic, ordinary[20:])
    for raw in (b" scum,", b" rotten ", b"aner", b" zzz "):
        f, g = toxicity._compressor(near), toxicity._compressor(raw + near)
        want = [[{i for w in ws if len(g(w)) < len(f(w))} for i, ws in enumerate(docs)] for docs in (toxic, ordinary[20:])]
        a, b = (len(set().union(*s)) for s in want)
        hits = j.hits(raw, j.windows)
        assert (len({x[1] for x in hits if x[0]}), len({x[1] for x in hits if not x[0]})) == (a, b)
        n1, n0 = len(toxic) - 1, len(ordinary) - 20
        p = (a + b) / (n1 + n0)
        sure = a >= 3 and a / n1 - b / n0 >= toxicity.SURE * math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        assert j.worth(hits, -1) == pytest.approx(a / n1 - toxicity.APART * (b + 1) / n0 if sure else -1)
    told = j.tell([(i, w) for i, ws in enumerate(toxic) for w in ws])
    # each of the three insults is told, and told pieces shorten toxic documents only
    assert all(any(s in p for p in told) for s in (b"vil", b"scu", b"otte")) and len(told) < 60
    after = toxicity.Judges(near, toxic, ordinary[20:])
    hits = after.hits(b"".join(told), after.windows)
    assert len({x[1] for x in hits if x[0]}) > 0.8 * len(toxic) and len({x[1] for x in hits if not x[0]}) < 0.2 * len(ordinary)


def test_very_long_texts_meet_a_trained_model(spark):
    rows = rows_of()
    long_ = " ".join(x for _, x, y in rows if not y) * 30
    d = spark.createDataFrame([(1, long_), (2, " ".join(x for _, x, y in rows if y) * 30), (3, "z" * 400_000), (4, None), (4, None), (None, "")], "doc_id long, text string").withColumns({"distance": F.lit("x"), "row": F.lit(1)})
    m = toxicity.fit_texts([(x, y) for _, x, y in rows])
    got = {(r["doc_id"], k): r for k, r in enumerate(toxicity.score(d, m).collect())}
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got.values())
    by = {i: r["predicted"] for (i, _), r in got.items()}
    assert by[1] == 0 and by[2] == 1 and by[4] == 0


def brute_covered(pages, article, depth=8):
    n = len(pages)
    held = collections.defaultdict(set)
    for k, p in enumerate(pages):
        for a in range(len(p)):
            for b in range(a + depth, len(p) + 1):  # every string of depth words or more
                held[tuple(p[a:b])].add(k)
    out = []
    for k, p in enumerate(pages):
        rule = boilerplate.INSIDE if article[k] else boilerplate.OUTSIDE
        hit = np.zeros(len(p), bool)
        for a in range(len(p)):
            for b in range(a + depth, len(p) + 1):
                if len(held[tuple(p[a:b])]) >= max(rule[1], rule[0] * n):
                    hit[a:b] = True
        out.append(hit.tolist())
    return out


def test_covered_against_all_long_strings():
    rng = random.Random(9)
    for n in (2, 5, 14):
        shared = [[f"s{rng.randrange(9)}" for _ in range(rng.randrange(6, 20))] for _ in range(3)]
        pages = []
        for _ in range(n):
            p = [f"o{rng.randrange(10**6)}" for _ in range(6)]
            for s in shared:
                if rng.random() < 0.75:
                    at = rng.randrange(len(p) + 1)
                    p[at:at] = s
            pages.append(p)
        article = [rng.random() < 0.5 for _ in range(n)]
        assert [h.tolist() for h in boilerplate.covered(pages, article)] == brute_covered(pages, article)


def site(n=90, seed=2):
    rng = random.Random(seed)
    text = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    notice, first, last, passage, out = text(12), text(9), text(14), text(60), []
    for i in range(n):
        body = text(40) + (" " + passage if i % 5 == 0 else "")
        if i % 4 == 0:
            html = f"<div><p>{text(30)}</p><p>{notice if i % 8 else ''} {text(5)}</p></div>"
        else:
            html = "<article>" + (f"<p>{first}</p>" if i % 2 else "") + f"<p>{body}</p><p>{text(6)} {notice}</p>" + (f"<p>{last}</p>" if i % 2 else "") + "</article>"
        out.append((i, f"http://h.test/{i}", html))
    return out, notice, first, last, passage


def test_blocks_of_any_size_give_equal_texts(spark):
    pages, notice, first, last, passage = site()
    pages += [(1000 + i, f"http://other.test/{i % 3}", f"<article><p>own {i} words</p></article>") for i in range(9)] + [(None, None, None), (None, None, "")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"part": F.lit("x"), "runs": F.lit(1), "inside": F.lit(2)})
    got = [sorted(map(tuple, boilerplate.main_text(d, block_pages=k).collect()), key=repr) for k in (2000, 20, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(pages)
    text = {r[0]: r[2] for r in got[0] if r[0] is not None}
    assert not any(notice in x or last in x for x in text.values()) and sum(passage in x for x in text.values()) == sum(1 for i in range(90) if i % 5 == 0 and i % 4)
    # on pages without an article, only the suffix array can know what goes
    for i in range(4, 90, 8):
        assert len(text[i].split()) == 35
    assert sorted(map(tuple, boilerplate.main_text(d, block_bytes=2000).collect()), key=repr) == got[0]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>a</p><figure><img><figcaption>caption</figcaption></figure><p>b</p></article>", "a caption b"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "so x=1 holds"),
        ('<article><div class="share-price">12 euros</div><p class="social-history">kept</p><p id="side-effects">too</p><div class="alert-level related">and this</div></article>', "12 euros kept too and this"),
        ('<article><p>a</p><div class="ad-slot">x</div><div class="main-nav">x</div><div id="comments">x</div><div class="post cookie-notice">x</div><p class="sidebar left">x</p></article>', "a"),
        ("<article><p>" + "<b>" * 5000 + "deep" + "</b>" * 5000 + "</p></article>", "deep"),
    ],
)
def test_only_named_parts_go(page, want):
    assert " ".join(boilerplate.streams(page)[0]) == want


def test_a_very_long_page(spark):
    words = " ".join(f"w{i}" for i in range(300_000))
    d = spark.createDataFrame([(1, "http://a.test/", f"<article><p>{words}</p></article>"), (2, "http://a.test/2", "<article><p>short</p></article>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["n_chars"] for r in boilerplate.main_text(d).collect()} == {1: len(words), 2: 5}
