"""Links and components against brute force."""
import random

import numpy as np
import pyarrow as pa
import pytest

from sheetmetric.llm import jaccard as J


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 75 * len(a | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, families=12, size=9, words=60, vocabulary=400):
    draw = random.Random(seed)
    out = []
    for _ in range(families):
        base = [f"w{draw.randrange(vocabulary)}" for _ in range(draw.randrange(3, words))]
        for _ in range(draw.randrange(1, size)):
            text = list(base)
            for _ in range(draw.randrange(0, 4)):
                at = draw.randrange(len(text))
                text[at:at + draw.randrange(0, 2)] = [f"x{draw.randrange(9999)}"] * draw.randrange(0, 2)
            out.append(" ".join(text))
            if draw.random() < 0.2:
                out.append(" ".join(text).upper())
    draw.shuffle(out)
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS sig", "3 AS n", "1 AS component_id").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, seed):
    rows = corpus(seed)
    assert sorted(map(tuple, J.near_duplicates(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_links_only_over_pivots(spark, monkeypatch):
    """A large family whose members are linked only through others, with runs taken for long from three nodes on."""
    monkeypatch.setattr(J, "SMALL_RUN", 2)
    draw = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(40):                      # a chain: each member differs from the next by one more word
        base = list(base)
        base[(k * 7) % 80] = f"c{k}"
        rows.append((k, " ".join(base)))
    star = [f"s{i}" for i in range(100)]
    for k in range(25):                      # copies of one text that are like it, less like each other
        text = list(star)
        for at in draw.sample(range(0, 100, 12), 2):
            text[at] = f"y{k}-{at}"
        rows.append((100 + k, " ".join(text)))
    rows.append((200, " ".join(star)))
    rows += [(300 + i, t) for i, t in corpus(3, families=6)]
    want = brute(rows)
    for turns in (0, 1, 2):
        monkeypatch.setattr(J, "PIVOT_ROUNDS", turns)
        assert sorted(map(tuple, J.near_duplicates(frame(spark, rows)).collect()), key=repr) == want


def test_odd_tables(spark):
    long = " ".join(f"l{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, "one two three four five"), (7, "one two three four five"), (7, "one two three four five"),
            (None, "one two"), (None, "alone here"), (8, long), (9, long + " end"), (10, "É a"), (11, "é a"), (12, None)]
    docs = frame(spark, rows)
    assert sorted(map(tuple, J.near_duplicates(docs).collect()), key=repr) == brute(rows)
    assert J.near_duplicates(docs.limit(0)).collect() == []
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, 12, 4, 6, None, 8, 10, 11], key=repr)
    assert J.keep_one(docs.limit(0)).collect() == []


def test_filters_agree_and_lose_nothing(spark):
    draw = np.random.default_rng(3)
    n = draw.integers(1, 60, 400)
    m = draw.integers(1, 60, 400)
    info = [x << 32 | int.from_bytes(draw.integers(0, 30, 4).astype(np.uint8).tobytes()) for x in n.tolist()]
    info2 = [x << 32 | int.from_bytes(draw.integers(0, 30, 4).astype(np.uint8).tobytes()) for x in m.tolist()]
    pos, pos2 = draw.integers(0, 10, 400), draw.integers(0, 10, 400)
    plain = J.similar_enough(np.array(info), pos, np.array(info2), pos2).tolist()
    df = spark.createDataFrame(list(zip(info, pos.tolist(), info2, pos2.tolist())), "i long, p int, j long, q int")
    assert [r[0] for r in df.selectExpr(J.filters_sql("i", "p", "j", "q")).collect()] == plain
    assert J.common_needed(np.array([14, 15, 2])).tolist() == [6, 7, 1] and J.prefix_length(np.array([1, 4, 5, 100])).tolist() == [1, 2, 2, 26]


def test_runs_over_batches(monkeypatch):
    """Cuts between batches change nothing."""
    monkeypatch.setattr(J, "SMALL_RUN", 4)
    draw = random.Random(1)
    rows = sorted({(draw.randrange(30) ** 2 // 60, 0, draw.randrange(40), 9 << 32) for _ in range(200)})
    rows = [r for r in rows for _ in range(draw.choice([1, 1, 3]))]

    def run(step):
        out = []
        for at in range(0, len(rows), step):
            out.append(pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[at:at + step])], ["token", "pos", "sig", "info"]))
        return sorted(r for b in J._runs(iter(out)) for r in zip(*(c.to_pylist() for c in b.columns)))
    whole = run(len(rows))
    assert whole and all(run(step) == whole for step in (1, 2, 3, 5, 17))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(500, 139), (7, 7)]
    found = {r["node"]: r["label"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in (*range(100, 140), 500)}
    assert J.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_no_pair_is_verified_twice(spark, monkeypatch):
    """Many documents behind one common passage: long runs, several rounds, bands and salts."""
    rng, rows = random.Random(11), []
    common = " ".join(f"c{k}" for k in range(30))
    for k in range(60):
        own = [f"w{k}-{i}" for i in range(rng.choice([5, 8, 60]))]
        for copy in range(3):
            rows.append((len(rows), common + " " + " ".join(own[:len(own) - copy])))
    seen, plain = [], J.verify

    def counted(pairs, sets):
        seen.extend(map(tuple, pairs.collect()))
        return plain(pairs, sets)
    monkeypatch.setattr(J, "verify", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in J.near_duplicates(docs).collect()}
    assert len(seen) == len(set(seen)) and all(a < b for a, b in seen)
    sets = [frozenset(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert [got[k] for k in range(len(rows))] == label
