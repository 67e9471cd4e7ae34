"""Ids against the tokenizers library; places gapless, whole and tight."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sheetmetric.llm import packing as K

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_ids(library):
    draw = random.Random(8)
    texts = [f"a{chr(c)}b {chr(c)}1" for c in (*range(0x3400), *range(0x3400, 0xD800, 61), *range(0xE000, 0x110000, 997))]
    texts += ["".join(draw.choices(["a", " ", "the", "\n", "'ll", "é", "<|endoftext|>", "12", "..."], k=draw.randrange(30))) for _ in range(800)]
    found = [np.frombuffer(x, "<u4").tolist() for x in K.file_encoder(PATH, P.PATTERN).encode(texts)]
    assert found == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_cuts():
    assert K.cuts(1, 4) == [(0, 1)] and K.cuts(4, 4) == [(0, 4)] and K.cuts(5, 4) == [(0, 1), (1, 4)] and K.cuts(8, 4) == [(0, 4), (4, 4)]


def test_bins_take_the_best_fit():
    draw = random.Random(9)
    for most in (1, 3, 10_000):
        bins, open_, last = K.Bins(20, most), {}, 0
        for _ in range(3000):
            n = draw.randrange(1, 21)
            number, offset = bins.place(n)
            best = min((f for f in open_.values() if f >= n), default=None)
            if best is None:
                assert (number, offset) == (last, 0)
                last += 1
                left = 20 - n
            else:
                assert open_.pop(number) == best and offset == 20 - best
                left = best - n
            if left:
                open_[number] = left
                if len(open_) > most:
                    least = min(open_.values())
                    closed = [k for k, f in open_.items() if f == least]
                    still = {k for bins_ in bins.free for k in bins_}
                    gone = [k for k in closed if k not in still]
                    assert len(gone) == 1
                    del open_[gone[0]]
            assert {k: f for f, ks in enumerate(bins.free) for k in ks} == open_


def check(rows, texts, library, capacity=1024):
    """Each document's pieces in full, each sequence gapless."""
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [2] for t in set(texts)}
    want = sorted((i, k, s, n, zlib.crc32(np.array(ids[t][s:s + n], "<u4").tobytes())) for i, t in enumerate(texts) for k, (s, n) in enumerate(K.cuts(len(ids[t]), capacity)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(n for *_, n, _ in want)


def test_documents(spark, library):
    draw = random.Random(10)
    texts = [None, "", *(" ".join(draw.choices(["the", "cat", "xqzt", "of"], k=draw.choice([3, 90, 400, 900, 2500]))) for _ in range(400))] + ["the cat"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS offset", "'a' AS ids").repartition(3)
    packed = K.pack_documents(docs, PATH, P.PATTERN, rows_per_task=150, with_ids=True).cache()
    n, total = check(packed.drop("ids").collect(), texts, library)
    assert n <= total / 1024 * 1.02 + 3
    whole = {r["sequence_id"]: r["ids"] for r in K.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]
    packed.unpersist()


def test_bound_that_is_reached(spark, library):
    draw = random.Random(12)
    texts = [" ".join(draw.choices(["the", "cat", "xqzt", "of"], k=draw.randrange(1, 1300))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    needed = []
    for most in (2, 16, 10_000):
        packed = K.pack_documents(docs, PATH, P.PATTERN, most=most, rows_per_task=300).collect()
        needed.append(check(packed, texts, library)[0])
        tasks = {}
        for r in packed:
            tasks.setdefault(r["sequence_id"] >> 40, set()).add(r["sequence_id"])
        assert len(tasks) == 2 and min(map(len, tasks.values())) > 16       # more sequences than open bins: some were closed
    assert needed[0] >= needed[1] >= needed[2] * 0.99


def test_repeated_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")
    rows = K.pack_documents(docs, PATH, P.PATTERN).collect()
    assert len(rows) == 4 and len({r["sequence_id"] for r in rows}) == 1 and sorted(r["offset"] for r in rows) == [0, 3, 6, 9]
    assert K.pack_documents(docs.limit(0), PATH, P.PATTERN).collect() == []
