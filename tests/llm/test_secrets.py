"""Spans against a plain scan of each text."""
import hashlib
import random
import re

from sheetmetric.llm import secrets as S


def brute(text, scope=S.SCOPE):
    text = text or ""
    spans = []
    for m in re.finditer(S.ASSIGN, text, re.I | re.A):
        spans.append((m.start(), 0 if len(m[1]) >= 8 else 5, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    for kind, pattern in ((3, "(?i)" + S.USER), (4, "(?i)" + S.ENDPOINT), (6, S.BARE)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text)]
    part = [S.PART[k] for k in S.KINDS]

    def near(w, of):
        return any(part[k] == of and a <= w[2] + scope and b + scope >= w[0] for a, k, b in spans)
    need = {"secret": lambda w: near(w, "identifier") or near(w, "endpoint"), "identifier": lambda w: near(w, "secret"), "endpoint": lambda w: near(w, "secret") and near(w, "identifier")}
    return sorted(w for w in spans if w[1] < 3 or need[part[w[1]]](w))


def joined(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def texts():
    draw = random.Random(12)
    parts = ["password: hunter2hunter2", "PassWd = \"abc\"", "api_key='A1b2C3d4E5'", "token=secret=abcdefghij", "secret: secret: abcdefghij", "AKIA" + "Q" * 12, "AKIAQQ", "AKIAAKIA" + "Z9" * 8, "a1" * 16, "a1" * 15, "f" * 40,
             "user=alice", "client_id: x9y", "https://db.example.com:5432/x?y=1", "jdbc:pg://h/x", "aB3" * 8, "Zx9/" * 10, "é", "日本", "\n", "\n\n", "word", "the of and to", "key", "x" * 90, "y " * 120]
    return [None, "", "token", *(" ".join(draw.choices(parts, k=draw.randrange(1, 12))) for _ in range(250)), "user=bob " + "z " * 150 + "password=short " + "AKIA" + "A" * 5000 + " https://h/p", "a1" * 16 + " " + "q " * 40_000 + "token: 12345678", "https://h/" + "p" * 3000 + " user=me pwd token=abc"]


def test_spans(spark):
    rows = [(i % 90 or None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS row").repartition(3)
    want = []
    for i, t in rows:
        spans = brute(t)
        base = joined([s for s in spans if s[1] < 3])
        want.append((i, *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
    found = S.digest(docs)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert any("endpoint" in w[-1] for w in want) and any("bare" in w[-1] for w in want)
    assert S.digest(docs.limit(0)).collect() == []


def test_weak_parts_alone_stay():
    assert brute("https://example.org/a user=alice word") == [] and brute("aB3" * 8) == []


def test_masking(spark):
    rows = [(i % 50, t, len(t or "")) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").selectExpr("*", "'x' AS text_key", "1 AS spans")
    want = []
    for i, t, n in rows:
        merged = []
        for a, _, b in brute(t):
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        new, at = "", 0
        for a, b in merged:
            new, at = new + t[at:a] + S.MASK, b
        new = new + t[at:] if t else t
        want.append((i, new, len(new or "")))
    out = S.mask(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r[:3]) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert S.mask(docs.limit(0)).collect() == []


def spans_of(spark, found):
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    assert [r.spans for r in S.digest(docs).orderBy("doc_id").collect()] == [joined(brute(t)) for t in found]
    return [len(brute(t)) for t in found]


def test_partner_behind_a_weak_span_of_several_buckets(spark):
    keys = ["aB3" * (n // 3) for n in (300, 600, 1500, 3000)]
    near = [" " * shift + key + " " * gap + "user=alice" for key in keys for shift in (0, 17, 190) for gap in (1, 181, 200)]
    assert set(spans_of(spark, near)) == {2}
    assert set(spans_of(spark, ["aB3" * 200 + " " * 201 + "user=alice"])) == {0}
    edge = [" " * shift + "username=" + "q" * 30 + " " * 181 + "password=abc" for shift in (190, 210)]
    assert set(spans_of(spark, edge)) == {2}


def test_partner_behind_a_very_long_span(spark):
    long = ["a1" * 10_000 + " user=alice", "user=alice " + "a1" * 10_000, "aB3" * 7_000 + " user=alice", "user=bob https://h/" + "p" * 20_000 + " pwd token=abc"]
    assert spans_of(spark, long) == [2, 2, 2, 2]
