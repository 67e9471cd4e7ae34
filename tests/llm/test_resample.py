"""Resampling against a plain version, and the cases its docstring names."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from sheetmetric.llm import resample as R

SCHEMA = "doc_id long, text string, score string, bucket int, rank string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, longest=2):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, share=25, least=20, buckets=10_000):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(crc(f) for x in rows for f in runs(x)) for rows in ([d[1] for d in docs], target))
    S, T, out = sum(s.values()), sum(t.values()), []
    for doc_id, text in docs:
        g = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(crc, runs(text))]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:share * len(able) // 100]):
        r[4] = k + 1
    return out


def key(row):
    return repr(row)


def some_texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["Ab", "cd", "é1", "x-y", "ß", "THE", "of", "\x00z", "9", "a_b", "ÀB"]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 19, 20, 40, 200]))) + rng.choice(["", " ", "!", "\n"]) for _ in range(n)]


def test_equals_plain(spark):
    texts = some_texts(300)
    docs = [(k, x) for k, x in enumerate(texts)] + [(None, texts[0] * 30), (900, None), (901, ""), (902, "--"), (903, "the of " * 40_000)]
    target = ["the of é1", None, "ab cd ab"]
    frame = spark.createDataFrame([(a, b, "x", 1, "y") for a, b in docs], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    for share, least in ((25, 20), (100, 0), (0, 20)):
        got = R.resample(frame, goal, share=share, least_words=least).select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()
        assert sorted(map(key, map(list, got))) == sorted(map(key, plain(docs, target, share, least)))


def test_repeated_rows_are_drawn_one_by_one(spark):
    long = "word " * 25
    frame = spark.createDataFrame([(7, long)] * 8 + [(9, "few words")], "doc_id long, text string").repartition(3)
    rows = R.resample(frame, frame).collect()
    assert len(rows) == 9 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2]
    assert R.draw(frame, frame).count() == 8


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert R.resample(none, one).count() == 0 and R.resample(none, none).count() == 0
    row = R.resample(one, none, share=100).first()
    assert row["rank"] == 1 and row["n_features"] == 59


def test_longer_runs():
    texts = some_texts(40, 5)
    n_words, found = R.features(pa.array(texts + [None]), 1_000_003, 4)
    assert n_words.tolist() == [len(words(x)) for x in texts] + [0]
    got = sorted((int(o), int(b)) for owner, bucket in found for o, b in zip(owner, bucket))
    assert got == sorted((k, zlib.crc32(f.encode()) % 1_000_003) for k, x in enumerate(texts) for f in runs(x, 4))


def test_gains_of_equal_counts_are_nothing():
    assert R.gains(np.array([3, 5, 0]), np.array([3, 5, 0])).tolist() == [0, 0, 0]
