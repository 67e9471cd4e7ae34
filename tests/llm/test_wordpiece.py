"""Counts against a plain greedy longest-match tokenizer."""
import random

import public_tokenizers as P

from sheetmetric.llm import wordpiece as W

PATH = P.path("word_bpe_49k.json")


def greedy(word, initial, inner):
    at, n, pieces = 0, 0, initial
    longest = max(map(len, initial | inner), default=0)
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in pieces:
                break
        else:
            return -1
        at, n, pieces = end, n + 1, inner
    return n


def test_random_vocabularies():
    draw = random.Random(3)
    for _ in range(300):
        initial, inner = ({"".join(draw.choices("abc", k=draw.randrange(1, 6))).encode() for _ in range(draw.randrange(12))} for _ in range(2))
        both = W.Automaton(initial, inner)
        one = W.Automaton(initial)
        for _ in range(40):
            word = "".join(draw.choices("abc", k=draw.randrange(1, 14))).encode()
            assert both.count(word) == greedy(word, initial, inner), (word, initial, inner)
            assert one.count(word) == greedy(word, initial, initial), (word, initial)


def test_real_vocabulary():
    automaton = W.word_end_automaton(PATH)
    import json
    chars = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    back = {chr(b): b for b in chars} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in chars)}
    pieces = set()
    for token in json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]:
        end = token.endswith("</w>")
        body = token[:-4] if end else token
        if body and all(c in back for c in body):
            pieces.add(bytes(back[c] for c in body) + (W.END if end else b""))
    draw = random.Random(4)
    for word in ["the", "erstlich", "réeuxment", "日本語", "x" * 500, "\x7f", *("".join(draw.choices("etaoinshrdéß,.1", k=draw.randrange(1, 25))) for _ in range(2000))]:
        word = word.encode()
        assert automaton.count(word) == greedy(word + W.END, pieces, pieces)


def test_tables(spark):
    docs = spark.createDataFrame([(1, "The the  cat"), (1, "The the  cat"), (2, None), (3, ""), (None, "the"), (4, "\t\n "), (5, "cat " * 50_000)], "doc_id long, text string").selectExpr("*", "'x' AS n_tokens", "1 AS n_words")
    found = sorted((tuple(r) for r in W.count_tokens(docs, PATH).collect()), key=repr)
    assert found == sorted([(1, 3, 3, 0), (1, 3, 3, 0), (2, 0, 0, 0), (3, 0, 0, 0), (None, 1, 1, 0), (4, 0, 0, 0), (5, 50_000, 50_000, 0)], key=repr)
    assert W.count_tokens(docs.limit(0), PATH).collect() == []


def test_unknown_words():
    automaton = W.Automaton([b"a"], [b"b"])
    assert automaton.total([b"ab", b"abb", b"b", b"a"]) == (2 + 3 + 1 + 1, 1)
