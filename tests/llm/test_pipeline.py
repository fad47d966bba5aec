import collections
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crosswalk.llm import mixing
from crosswalk.llm.common import words

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, piece int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice(("an", "er", "on", "th", "re")) for _ in range(rng.randrange(1, 6)))
    docs, labels = [], []
    for i in range(500):
        ws = [word() for _ in range(rng.randrange(30, 120))]
        toxic, low = i % 10 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                ws[rng.randrange(len(ws))] = rng.choice(("vile", "scum"))
        text = " ".join(w.upper() + "!!" if low else w for w in ws)
        docs.append((i, text, "en", f"s{i % 3}", len(text), 0.5, "r", 1))
        if i % 4:
            labels.append((i, int(not low), int(toxic)))
    docs += [(1000 + i, docs[i][1] + " more", *docs[i][2:]) for i in range(1, 400, 3)]
    docs += [(None, None, None, None, None, None, None, None), (2000, "", None, "s1", 0, None, None, None), (1, *docs[1][1:])]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, KIND).repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d), docs


def test_stages(spark, folder):
    d, docs = folder
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = now.columns, [now]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, d).collect(), KIND)
        assert now.columns == columns
        kept.append(now)
    ids = [[r["doc_id"] for r in k.collect()] for k in kept]
    good = lambda i: i is not None and i < 2000
    base = lambda i: i - 1000 if i >= 1000 else i
    clean = [i for i in ids[0] if good(i) and base(i) % 10]
    assert len([i for i in ids[1] if good(i) and base(i) % 10 == 0]) <= 2 and len([i for i in ids[1] if good(i) and base(i) % 10]) >= 0.98 * len(clean)
    fine = [i for i in ids[1] if good(i) and base(i) % 7]
    assert len([i for i in ids[2] if good(i) and base(i) % 7 == 0]) <= 2 and len([i for i in ids[2] if good(i) and base(i) % 7]) >= 0.98 * len(fine)
    text = {}
    for i, t, *_ in docs:
        text.setdefault(i, t)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in set(ids[2]) if (w := words(text[i]))}
    assert len(ids[3]) == len(set(ids[3])) and set(ids[3]) <= set(ids[2])
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    left = sorted(i for i in ids[3] if i in sets)
    assert not any(near(a, b) for k, a in enumerate(left) for b in left[:k])
    assert all(any(near(i, j) for j in left) for i in set(ids[2]) - set(ids[3]))
    mixed = {r["doc_id"] for r in mixing.mixed(kept[3]).where("__sampled").collect()}
    assert set(ids[4]) == mixed


def test_run(spark, folder):
    d, _ = folder
    got = corpus_pipeline.run(spark, d).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 for p in pieces.values()) and len({(r["doc_id"], r["piece"]) for r in got}) == len(got)


def test_no_documents(spark, folder, tmp_path):
    d, _ = folder
    spark.read.parquet(f"{d}/documents.parquet").where(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{d}/labels.parquet").where(F.lit(False)).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_modulus_of_ids(spark):
    from crosswalk.llm.common import train_rows

    got = spark.range(50).select("id", train_rows("id", 7, 2).alias("t")).collect()
    assert all(r["t"] == (zlib.crc32(str(r["id"]).encode()) % 7 != 2) for r in got)
