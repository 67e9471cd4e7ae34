"""Search against brute force."""
import math
import random

from sheetmetric.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]
    usable = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    queries = {}
    for i, v in usable:
        if i % 50 == 0 and (i not in queries or v < queries[i]):
            queries[i] = v
    out = []
    for i, q in queries.items():
        scores = sorted((-max(K.LEAST, min(K.MOST, sum(a * b for a, b in zip(q, v)))), j) for j, v in usable if j != i and len(v) == len(q) and q)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def numbers(draw, rows, width=6, grain=8):
    return [(i, [draw.randrange(-grain, grain + 1) / 8 for _ in range(width)]) for i in rows]


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "'a' AS shard").repartition(3)
    return sorted(map(tuple, K.search(df, **kw).select("query_id", "rank", "vec_id", "score").collect()))


def test_against_brute_force(spark):
    draw = random.Random(4)
    rows = numbers(draw, range(0, 400))
    for kw in ({}, {"block": 3, "shard": 20, "fan": 3}, {"k": 1, "shard": 64, "fan": 2}):
        assert found(spark, rows, **kw) == brute(rows, kw.get("k", 5))


def test_odd_rows(spark):
    draw = random.Random(5)
    rows = numbers(draw, range(40, 70)) + [(100, None), (150, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (200, [float("nan")] * 6), (250, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(300, [1.0, 2.0]), (301, [0.5, 0.25]), (350, []), (351, [])]
    rows += [(50, [0.5] * 6), (60, [1.0] * 6), (60, [1.0] * 6)]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, [(0, [1.0]), (50, [2.0])]) == [(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)]
    assert found(spark, []) == []


def test_large_numbers(spark):
    rows = [(0, [3e30, 1.0]), (1, [3e30, 5.0]), (2, [-3e30, 0.0]), (3, [1e9, 2.0]), (4, [0.0, 7.0])]
    import numpy as np
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(spark, rows) == brute(rows, 5)
