"""Held-out accuracy on invented words, misspellings, and odd tables."""
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from sheetmetric.llm import toxicity as T

BAD = ["blorgface", "zumpkin", "grunklor"]


def text(draw, bad, words=120):
    out = ["".join(draw.choices(["an", "er", "ti", "on", "he", "st", "ou"], k=draw.randrange(1, 4))) for _ in range(words)]
    for _ in range(max(2, words // 40) if bad else 0):
        word = draw.choice(BAD)
        if bad == "misspelt":
            at = draw.randrange(len(word))
            word = word[:at] + draw.choice("xqj") + word[at:]
        out[draw.randrange(len(out))] = word
    return " ".join(out)


@pytest.fixture(scope="module")
def model():
    draw = random.Random(1)
    labels = [draw.random() < 0.2 for _ in range(700)]
    return T.train([text(draw, bad and "plain", draw.randrange(20, 300)) for bad in labels], [int(x) for x in labels])


def test_held_out_and_misspelt(model):
    """Known words in new texts are found; misspellings never seen still rank above clean texts."""
    draw = random.Random(2)
    scorer = T.Scorer(model, limit=500)
    plain, misspelt, clean = (scorer.score([text(draw, kind, draw.randrange(20, 300)) for _ in range(300)]) for kind in ("plain", "misspelt", None))
    assert (plain >= T.THRESHOLD).mean() >= 0.95 and (clean < T.THRESHOLD).mean() >= 0.98
    assert (misspelt[:, None] > clean[None, :]).mean() >= 0.97


def test_score_is_the_softmax_of_the_mean(model):
    words = T.split("Blorgface, an xx blorgface")
    total = 0.0
    for word in words:
        _, bucket = T.ngrams([word])
        total += model.weights[bucket].mean()
    want = 1 / (1 + np.exp(-(total / (len(words) + T.PADDING) + model.bias)))
    assert np.isclose(T.Scorer(model).score(["Blorgface, an xx blorgface"])[0], want)


def test_one_class_or_none():
    assert T.Scorer(T.train([], [])).score(["x", None]).tolist() == [0.5, 0.5]
    assert T.Scorer(T.train(["a b"] * 9, [0] * 9)).score(["a"])[0] < 0.1
    T.train([None, "", "x"], [0, 1, 1])


def test_tables(spark, model):
    rows = [(1, "an blorgface"), (2, None), (3, ""), (None, "an"), (1, "an blorgface"), (5, "zumpkin " * 30_000), (6, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS text_to_score")
    found = T.score_documents(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= T.THRESHOLD) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    left = T.keep_clean(docs, model)
    assert left.columns == docs.columns and left.where("doc_id = 5").count() == 0 and left.where("doc_id IS NULL").count() == 1
    assert T.score_documents(docs.limit(0), model).collect() == []


def test_learns_only_from_its_fold(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(60)] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(3, 1, 1), (None, 1, 1), (4, 0, None), (900, 1, 1)], "doc_id long, quality int, toxic int")
    rows = T.training_rows(docs, labels, toxic=10, clean=12)
    ids = [int(t[1:]) for t, _ in rows if t != "again"]
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    assert sum(x for _, x in rows) <= 10 and sum(1 - x for _, x in rows) == 12
    assert T.training_rows(docs, labels.limit(0)) == []


def test_training_holds_its_bags_once():
    """Column and share of each n-gram, 8 bytes in all, beside fixed tables and one batch; the bags as they are made take 16 bytes."""
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnop", k=9)) for _ in range(20_000)]
    texts = [" ".join(draw.choices(words, k=600)) for _ in range(600)]
    entries = sum(len(T._bag(t)[0]) for t in texts)
    T.train(texts[:4], [0, 1, 0, 1], least_steps=1)
    tracemalloc.start()
    T.train(texts, [i % 2 for i in range(600)], least_steps=1, batch=8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * entries + 100 * (1 << T.BITS)


def test_filters_find_the_text_without_copying_it(spark, model):
    from sheetmetric.llm import quality
    docs = spark.createDataFrame([("zumpkin " * 90, 1, "an"), ("an er " * 90, 2, "zumpkin"), (None, 3, "an")], "Text string, doc_id long, note string")
    few_words = [rule for rule in quality.RULES if rule.name == "few_words"]
    for left, kept in ((T.keep_clean(docs, model), [2, 3]), (quality.keep_good(docs, few_words), [1, 2])):
        assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == kept
        assert "text_to" not in left._jdf.queryExecution().toString()


def test_scorer_remembers_a_bounded_number_of_words(model):
    draw = random.Random(4)
    texts = ["blorgface " + " ".join(f"{w}{draw.randrange(10**9)}" for w in ("an", "er", "ti") * 400) for _ in range(40)]
    scorer = T.Scorer(model, limit=3000)
    scores = [scorer.score([t])[0] for t in texts]
    assert len(scorer.known) + len(scorer.older) <= 2 * (3000 + 1201)
    assert scores == T.Scorer(model, limit=10**9).score(texts).tolist()
    many = [b"an%d" % k for k in range(9000)]
    assert model.word_scores(many) == [x for w in many for x in model.word_scores([w])]
    assert T.Scorer(model).limit <= 125_000
