"""How many links near the threshold the candidate search of near duplicates finds, and sums over many partitions."""

import random

import numpy as np
from pyspark.sql import functions as F

from crosswalk.llm import mixing, near_dup, quality


def test_recall_of_links_near_the_threshold(spark):
    rng, rows, linked = random.Random(4), [], {}
    for k in range(600):
        n = rng.randrange(40, 400)
        a = [f"w{rng.randrange(10**7)}" for _ in range(n)]
        b = [*a]
        for at in rng.sample(range(n), max(1, round(n * rng.uniform(0.024, 0.033)))):
            b[at] = f"e{rng.randrange(10**7)}"
        x, y = ({tuple(t[i : i + 5]) for i in range(n - 4)} for t in (a, b))
        like = len(x & y) / len(x | y)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        linked[2 * k + 1] = 100 * len(x & y) >= 75 * len(x | y), like
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [i for i, (is_, like) in linked.items() if is_ and like < 0.85]
    assert len(near) > 100 and all(got[i] == i - 1 for i in near)
    assert all(got[i] == i for i, (is_, _) in linked.items() if not is_)


def test_sums_over_many_partitions(spark):
    rows = spark.range(1000, numPartitions=300).select(F.array(*[(F.col("id") + k).cast("double") for k in range(quality.N_STATS)]).alias("x"), (F.col("id") % 2).alias("y"))
    got = quality._summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0)]), (quality.N_STATS + 1,))
    assert got.tolist() == [1000.0] + [499500.0 + 1000 * k for k in range(quality.N_STATS)]


def test_topics_of_a_column(spark):
    d = spark.createDataFrame([(i, f"text {i}", "en", "s", "t" + str(i % 3), 1) for i in range(60)], "doc_id long, text string, lang string, source string, kind string, __topic int")
    got = mixing.mixed(d, topic_of=F.col("kind"))
    assert {r["__topic"] for r in got.collect()} == {"t0", "t1", "t2"}
    assert mixing.select_mixed(d, topic_of=F.col("kind")).columns == d.columns
