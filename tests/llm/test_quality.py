"""Figures against brute force; the verdict whatever the order."""
import random
import re
from itertools import permutations

from sheetmetric.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    draw = random.Random(2)
    parts = ["a", "b", "c", "é", "#", "x|y", "\n", "\n", "ab cd ef", "", "\x0b", " ", "日本", " ", "WOW!!"]
    return [None, "", " ", "\n\n", *("".join(draw.choice(parts) + draw.choice([" ", " ", "\n", ""]) for _ in range(draw.randrange(90))) for _ in range(300)), "one two three four " * 4000]


def test_figures():
    for text in texts()[:-1]:
        f = Q.Facts(text)
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == brute(text), text
    f = Q.Facts(texts()[-1])
    assert f.n_repeat_words == f.n_words == 16_000 and f.base_failed


def test_order_changes_no_verdict():
    for text in texts()[:12]:
        assert len({Q.kept(text, rules) for rules in permutations(Q.RULES)}) == 1


def test_order_by_rejections_per_cost():
    measured = [("few_words", 10, 0, 0.1), ("symbols", 10, 5, 1.0), ("shouting", 10, 4, 0.1)]
    assert [r.name for r in Q.order(Q.RULES, measured)][:2] == ["shouting", "symbols"]


def test_tables(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, t) for i, t in enumerate([*texts()[:80], good, good])] + [(None, good), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS kept", "2 AS text_to_judge")
    found = Q.judge(docs).collect()
    want = []
    for i, t in rows:
        n, *rest = brute(t)
        base = n < 50 or 100 * rest[-1] > 50 * n
        assert not (base and Q.kept(t, Q.RULES))
        want.append((i, n, *rest, base, Q.kept(t, Q.RULES)))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    left = Q.keep_good(docs)
    assert left.columns == docs.columns
    assert sorted((tuple(r[:2]) for r in left.collect()), key=repr) == sorted([(r[0], t) for r, (_, t) in zip(want, rows) if r[-1]], key=repr)
    assert Q.judge(docs.limit(0)).collect() == [] and Q.keep_good(docs.limit(0)).collect() == []
