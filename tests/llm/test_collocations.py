"""Phrase mining and its graph against plain counts, and the cases the docstring names."""
import collections
import random
import re

import pytest

from sheetmetric.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, size int"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(docs, longest):
    f = collections.defaultdict(collections.Counter)
    for text, lang in docs:
        for ws in pieces(text):
            f["und" if lang is None else lang][()] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f["und" if lang is None else lang][tuple(ws[i:i + k])] += 1
    return f


def plain(docs, longest=3, least=10, covered=50, top=2000):
    out = []
    for lang, f in counts(docs, longest).items():
        cand = {p: a for p, a in f.items() if 2 <= len(p) and a >= least}
        hidden = {p[i:i + k] for p, n in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * n >= covered * f[p[i:i + k]]}
        rows = []
        for p, a in cand.items():
            if p not in hidden:
                score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((" ".join(p), a, l, r, f[()], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, k + 1, *r) for k, r in enumerate(rows[:top])]
    return sorted(map(repr, out))


def some_docs(n=150, seed=4):
    rng = random.Random(seed)
    words = ["The", "of", "a", "é", "ß", "X-1", "\x00", "\x01b", "zz", "Ünter", "q"] + [f"w{k}" for k in range(40)]
    passage = " ".join(f"licence{k}" for k in range(70))
    docs = []
    for _ in range(n):
        text = "".join(rng.choices(words, [30, 20, 10] + [3] * (len(words) - 3))[0] + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ", " ", " "]) for _ in range(rng.choice([0, 1, 40, 200])))
        docs.append((text + (passage if rng.random() < 0.2 else ""), rng.choice(["en", "fr", None, ""])))
    return docs + [(None, "en"), ("", None), ("...", "xx"), ("again and again " * 3_000, "fr"), ("alone " * 9, "yy")]


def frame(spark, docs):
    return spark.createDataFrame([(k, *d, 1, "x", 2) for k, d in enumerate(docs)], SCHEMA)


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (4, 4, 7), (2, 2, 2000)])
def test_equals_plain(spark, longest, least, top):
    docs = some_docs()
    got = C.mine(frame(spark, docs).repartition(5), longest, least, top=top, tokens=900).collect()
    assert sorted(repr(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score"))) for r in got) == plain(docs, longest, least, top=top)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(C, "solid", lambda *_: np.full(1 << C.BITMAP_BITS - 3, 255, np.uint8))
    docs = some_docs(60, 9)
    got = C.mine(frame(spark, docs)).collect()
    assert sorted(map(lambda r: repr(tuple(r)), got)) == plain(docs)


def test_counts_come_from_flow(spark):
    docs = some_docs(80, 2)
    graph, f = C.Graph(frame(spark, docs), 3, 5), counts(docs, 3)
    for k in range(4):
        want = {(lang, " ".join(p)): n for lang, c in f.items() for p, n in c.items() if len(p) == k and (n >= 5 or k == 0)}
        assert {(r["lang"], r["phrase"]): r["n"] for r in graph.counts[k].collect()} == {x: n for x, n in want.items() if n}


def test_unary_paths(spark):
    passage = [f"licence{k}" for k in range(100)]
    docs = [(f"x{k} " + " ".join(passage), "en") for k in range(12)] + [("start " + " ".join(passage[40:]), "en")] * 10
    got = {r["path"]: r["n"] for r in C.paths(frame(spark, docs)).collect()}
    assert got[" ".join(passage[:42])] == 12 and got[" ".join(passage[40:])] == 22
    assert got == {" ".join(passage[:42]): 12, " ".join(passage[40:]): 22, " ".join(["start", *passage[40:42]]): 10}


def test_empty_tables(spark):
    assert C.mine(frame(spark, [("a", "b")]).where("doc_id > 3")).count() == 0
    assert C.mine(frame(spark, [(None, None), ("rare words only", "en")])).count() == 0
