"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest
from foliant.llm import resampling
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def model(docs, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000)))) for b in range(10000)]
    rows = []
    for doc, text in docs:
        words, all_ = features(text)
        weight = sum(gain[bucket(f)] for f in all_) // len(all_) if all_ else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(all_), weight, score, None, len(words)])
    eligible = sorted((r for r in rows if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(eligible[: percent * len(eligible) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in rows]


TEXTS = ["", None, "one", "Ä É ß 北京 x1y2 ÀB", "a-b_c'd \x00 e\x7ff", "W" * 70 + " " + "v" * 200 + " z", "same words " * 30, "end.", "no break " * 25]


def test_features_of_touching_texts_and_slices(monkeypatch):
    texts = [*TEXTS, *TEXTS[::-1], "tail" * 5000 + " a b", "x y " * 3000]
    for size in (1 << 20, 64, 7):
        monkeypatch.setattr(resampling, "SLICE", size)
        words, pairs = [[] for _ in texts], [[] for _ in texts]
        for owner, own, pair_owner, pair in resampling.features(pa.array(texts)):
            for o, b in zip(owner.tolist(), own.tolist()):
                words[o].append(b)
            for o, b in zip(pair_owner.tolist(), pair.tolist()):
                pairs[o].append(b)
        for text, w, p in zip(texts, words, pairs):
            all_ = [zlib.crc32(f.encode()) % 10000 for f in features(text)[1]]
            assert w + p == all_


@pytest.mark.parametrize("enough", [100_000, 5])
def test_rows_equal_the_model(spark, enough):
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(vocabulary[(i * i + j * (i % 7 + 1)) % 40] for j in range(i % 60))) for i in range(400)]
    docs += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "w1 " * 30), (7, "w1 w2 " * 20), (7, "w1 w2 " * 20)]
    target = ["w1 w2 w3 " * 5, None, "w5"]
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, rank long").repartition(7)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resampled(table, wanted, enough=enough).select("doc_id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(model(docs, target), key=key)


def test_cutoff_with_ties(spark):
    rows = [(s, d) for s in (0, 0, 5) for d in range(300)] + [(9, 10**18)] * 50 + [(2, -(10**18) + i) for i in range(40)]
    keyed = spark.createDataFrame(rows, "a long, b long").withColumn("c", F.monotonically_increasing_id()).cache()
    order = sorted(tuple(r) for r in keyed.collect())
    for k in (1, 2, 300, 601, 640, 641, 900, 941, len(order) - 1, len(order)):
        assert resampling.cutoff(keyed, ["a", "b", "c"], k, 8) == order[k - 1]
    ranks = {(r.a, r.b, r.c): r["rank"] for r in resampling.ranked(keyed, ["a", "b", "c"]).collect()}
    assert [ranks[r] for r in order] == list(range(1, len(order) + 1))
    keyed.unpersist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert resampling.resampled(docs.limit(0), docs).count() == 0
    flat = resampling.resampled(docs, docs.limit(0), percent=100).collect()
    assert {r.doc_id: (r.n_words, r["rank"]) for r in flat} == {1: (40, 1), 2: (0, None)}
