"""The backoff model of three words against a recursion over plain counters."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from crosswalk.llm import common, katz

RNG = random.Random(12)
ZIPF = [f"w{k}" for k in range(60)]
TEXTS = [(i, " ".join(RNG.choices(ZIPF, [1 / (k + 1) for k in range(60)], k=RNG.randrange(0, 60)))) for i in range(120)]
TEXTS += [(200, None), (201, ""), (None, "w0 w1 w2"), (None, "w0 w1 w2"), (7, "w0 never seen w1 w2 words"), (202, "w0 " * 3000), (203, "Ü w0\x0bw1 \x1c W2"), (204, "x y z " * 400)]


class Plain:
    def __init__(self, texts, order):
        self.order, tokens = order, [["<s>"] * (order - 1) + t for t in texts]
        self.c = [collections.Counter(tuple(t[i - k : i + 1]) for t in tokens for i in range(order - 1, len(t))) for k in range(order)]
        self.d = [katz.discounts(collections.Counter(c.values())) for c in self.c]
        self.n = sum(self.c[0].values())
        self.left = 1 - sum(self.kept(0, c) for c in self.c[0].values()) / self.n
        self.after = [collections.defaultdict(dict) for _ in range(order)]
        for k in range(1, order):
            for run, c in self.c[k].items():
                self.after[k][run[:-1]][run[-1]] = c
        self.known = {}

    def kept(self, k, c):
        return c * (self.d[k][c] if c <= katz.K else 1)

    def p(self, context, w):
        k = len(context)
        if not k:
            return self.kept(0, self.c[0][w,]) / self.n if (w,) in self.c[0] else self.left
        after = self.after[k].get(context)
        if after is None:
            return self.p(context[1:], w)
        of, weight = self.context(context)
        return self.kept(k, after[w]) / of if w in after else weight * self.p(context[1:], w)

    def context(self, context):
        if context not in self.known:
            k, after = len(context), self.after[len(context)][context]
            of, kept = sum(after.values()), sum(self.kept(k, c) for c in after.values())
            of += of - kept < 1e-9
            self.known[context] = of, (1 - kept / of) / (1 - sum(self.p(context[1:], w) for w in after))
        return self.known[context]


@pytest.mark.parametrize(("order", "bucket", "chunk"), [(3, 2_500_000, 14 << 20), (3, 300, 2000), (2, 300, 2000)])
def test_scores_against_a_plain_recursion(spark, order, bucket, chunk):
    d = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(5).withColumns({"bucket": F.lit("x"), "chunk": F.lit(1), "train": F.lit(None)})
    got = katz.scores(d, F.col("doc_id") % 4 != 1, order=order, chunk_bytes=chunk, bucket_tokens=bucket).collect()
    tk = [(i, [*common.words(t), None], i is not None and i % 4 != 1) for i, t in TEXTS]
    m = Plain([t for _, t, l in tk if l], order)
    v = len(m.c[0])
    for h in list(m.after[order - 1])[:40]:  # the probabilities after any context add up to 1, with one share for all unseen words
        assert sum(m.p(h, w) for (w,) in m.c[0]) + m.p(h, "unseen!") == pytest.approx(1, abs=1e-9)
    pad = ("<s>",) * (order - 1)
    want = []
    for i, t, l in tk:
        run = (*pad, *t)
        score = sum(math.log10(m.p(run[k : k + order - 1], run[k + order - 1])) for k in range(len(t)))
        want.append((-1 if i is None else i, l, len(t), sum((w,) in m.c[0] for w in t), m.n, round(sum(math.log10((m.c[0][w,] + 1) / (m.n + v + 1)) for w in t), 4), round(score, 4)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["trained_on"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in got) == sorted(want)


def test_three_words_with_nothing_to_learn_from(spark):
    d = spark.createDataFrame(TEXTS[:20], "doc_id long, text string")
    got = katz.scores(d, F.lit(False), order=3).collect()
    assert len(got) == 20 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == pytest.approx(0) for r in got)
    assert katz.scores(d.limit(0), F.lit(True), order=3).count() == 0
