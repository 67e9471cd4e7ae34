"""Grid joins against brute force, crowded places included."""
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from drawing import frame, row
from sheetmetric.functions.grid import cell_pairs, label_pairs, near_pairs, nearest_candidates, overlapping_boxes
from sheetmetric.session import cut_lineage
from sheetmetric.operators import catalog, graph, places, spaces, spatial


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs(spark, seed):
    rnd = random.Random(seed)
    pts = [(rnd.randrange(2), rnd.uniform(-900, 900), rnd.uniform(-900, 900), i) for i in range(150)] + [(0, 0.0, 0.0, 1000), (0, 100.0, 0.0, 1001)]
    left = spark.createDataFrame(pts, "sheet_id BIGINT, lx DOUBLE, ly DOUBLE, a BIGINT")
    right = spark.createDataFrame(pts, "sheet_id BIGINT, rx DOUBLE, ry DOUBLE, b BIGINT")
    want = sorted((p[3], q[3]) for p in pts for q in pts if p[0] == q[0] and math.dist(p[1:3], q[1:3]) <= 100)
    assert sorted((r.a, r.b) for r in near_pairs(left, right, 100.0).collect()) == want
    strict = sorted((r.a, r.b) for r in near_pairs(left, right, 100.0, strict=True).collect())
    assert strict == [p for p in want if p not in ((1000, 1001), (1001, 1000))]


@pytest.mark.parametrize("spread", [30.0, 150.0, 4000.0])
def test_pairs_are_counted_without_being_listed(spark, spread):
    """Crowds and scattered places equal brute force; in a crowd far fewer pairs of cells and places are met than there are."""
    draw = np.random.default_rng(6)
    n = 3000
    x, y = (np.concatenate([draw.normal(0, spread, n), draw.integers(-3, 4, 300) * 50.0]) for _ in range(2))
    label = draw.integers(0, 4, len(x))
    data = pd.DataFrame({"sheet_id": 1, "x": x, "y": y, "label": [f"L{v}" for v in label]}).groupby(["sheet_id", "x", "y", "label"]).size().reset_index(name="n")
    points = spark.createDataFrame(data).repartition(3).cache()
    got = {(r.llabel, r.rlabel): r.pairs for r in label_pairs(points, 100.0).collect()}
    close = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 10_000
    want = {(f"L{a}", f"L{b}"): int(close[np.ix_(label == a, label == b)].sum()) for a in range(4) for b in range(a + 1, 4)}
    assert got == {k: v for k, v in want.items() if v}
    met = sum(whole.count() + (small.selectExpr("sum(na * nb)").first()[0] or 0) for _, whole, small in cell_pairs(points, 100.0))
    if spread < 1000:       # the denser the crowd, the more is counted in whole cells
        assert met < int(close.sum()) / (4 if spread < 100 else 1)


@pytest.mark.parametrize("seed", [3, 4])
def test_overlapping_boxes(spark, seed):
    rnd = random.Random(seed)

    def box(i):
        size = rnd.choice([0, 10, 3000, 90000, 3e6, 5e9])
        x, y = rnd.uniform(-1e5, 1e5) * rnd.choice([1, 1, 1e4]), rnd.uniform(-1e5, 1e5)
        return (1, x, y, x + rnd.random() * size, y + rnd.random() * size, i)
    a, b = [box(i) for i in range(150)] + [(1, 0.0, 0.0, 10.0, 10.0, 900)], [box(i) for i in range(150)] + [(1, 10.0, 10.0, 20.0, 20.0, 901)]
    cols = lambda p: f"sheet_id BIGINT, {p}xmin DOUBLE, {p}ymin DOUBLE, {p}xmax DOUBLE, {p}ymax DOUBLE, {p}id BIGINT"
    got = sorted((r.lid, r.rid) for r in overlapping_boxes(spark.createDataFrame(a, cols("l")), spark.createDataFrame(b, cols("r"))).collect())
    want = sorted((p[5], q[5]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2])
    assert got == want and (900, 901) in got


def brute_topology(rows, tol=3000.0, ends_kept=15, near_kept=10):
    lines = [r for r in rows if r["dxf_type"] == "LINE"]
    point = lambda p: (p["x"], p["y"])
    edges = {}
    for a in lines:
        ends = [point(a["points"][0]), point(a["points"][-1])]
        best = []
        for b in rows:
            if b is a:
                continue
            others = [point(b["points"][0]), point(b["points"][-1])] if b["dxf_type"] == "LINE" else [point(b["points"][0])]
            d = min(math.dist(p, q) for p in ends for q in others)
            if d <= tol:
                best.append((d, b["entity_id"]))
        if best:
            edges[a["entity_id"]] = ("CONNECTED", [i for _, i in sorted(best)[:ends_kept]])
    rest = [r for r in rows if r["entity_id"] not in edges]
    for a in rest:
        best = sorted((math.dist(point(a["points"][0]), point(b["points"][0])), b["entity_id"]) for b in rest if b is not a)
        near = [i for d, i in best if d <= tol][:near_kept]
        if near:
            edges[a["entity_id"]] = ("NEAR", near)
    return edges


def test_nearest_in_a_dense_sheet(spark):
    """100,000 places of one sheet, a crowd among them: few candidates for each, and the k nearest of brute force."""
    rng, k, radius = np.random.default_rng(3), 16, 3000.0
    xy = np.concatenate([rng.uniform(0, 6000, (60_000, 2)), rng.normal(3000, 20, (39_000, 2)), rng.uniform(0, 1e6, (1_000, 2))])
    right = spark.createDataFrame(pd.DataFrame({"sheet_id": 1, "rx": xy[:, 0], "ry": xy[:, 1], "id": np.arange(len(xy))}))
    some = rng.choice(len(xy), 2_000, replace=False)
    left = right.where(F.col("id").isin(some.tolist())).selectExpr("sheet_id", "rx AS lx", "ry AS ly", "id AS lid")
    got = {}
    for r in nearest_candidates(left, right, radius, "1", k).select("lid", "id", "dist").collect():
        got.setdefault(r.lid, []).append((r.dist, r.id))
    assert sum(map(len, got.values())) < 25 * k * len(some)         # tens of thousands lie within the radius of most
    for i in some[:300].tolist():
        d = np.sqrt(((xy - xy[i]) ** 2).sum(1))
        order = np.argsort(d)[:k]
        want = [(round(d[j], 6), j) for j in order if d[j] <= radius]
        assert [(round(x, 6), j) for x, j in sorted(got[i])[:k]] == want


def test_topology_with_crowded_places(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(120):   # a few places hold most of the entities
        x, y = rnd.choice([(0, 0), (0, 0), (500, 0), (rnd.randrange(40) * 500, rnd.randrange(40) * 500)])
        if i % 4 == 0:
            rows.append(row(i, "LINE", "P-PIPE", [(x, y), (x + rnd.choice([0, 500, 9000]), y)]))
        else:
            rows.append(row(i, "INSERT", "A-DOOR", [(x + 50000 * (i % 2), y)], block_name="M1"))
    want = brute_topology(rows)
    got = {}
    for r in sorted(spatial.topology(frame(spark, rows)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.src, (r.relation, []))[1].append(r.dst)
    assert got == want


def brute_reach(rows, anchor, hops):
    links = {}
    for a, (relation, others) in brute_topology(rows, ends_kept=None, near_kept=None).items():
        for b in others:
            links.setdefault(a, {})[b] = relation
            links.setdefault(b, {}).setdefault(a, relation)
    seen, frontier, out = {anchor}, {anchor}, set()
    for hop in range(1, hops + 1):
        step = {}
        for a in frontier:
            for b, relation in links.get(a, {}).items():
                if b not in seen:
                    step[b] = min(relation, step.get(b, relation))
        out |= {(b, hop, relation) for b, relation in step.items()}
        seen |= set(step)
        frontier = set(step)
    return out


def crowded_rows(seed, n=120):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        x, y = rnd.choice([(0, 0), (0, 0), (500, 0), (rnd.randrange(60) * 500, rnd.randrange(60) * 500)])
        if i % 4 == 0:
            rows.append(row(i, "LINE", "P-PIPE", [(x, y), (x + rnd.choice([0, 500, 9000]), y)]))
        else:
            rows.append(row(i, "INSERT", "A-DOOR", [(x + 50000 * (i % 2), y)], block_name="M1"))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_equals_brute_force(spark, seed):
    rows = crowded_rows(seed)
    anchors = [r["entity_id"] for r in rows[::17]]
    physical = places.place_graph(frame(spark, rows))
    got = {}
    for r in graph.graph_khop(spark.createDataFrame([(a,) for a in anchors], "node_id STRING"), physical).collect():
        got.setdefault(r.anchor, set()).add((r.node, r.hop, r.relation))
    assert got == {a: x for a in anchors if (x := brute_reach(rows, a, 3))}


def test_neither_neighbours_nor_copies_are_cut(spark):
    hub = [row(0, "LINE", "P-PIPE", [(0, 0), (0, 9000)])] + [row(1 + i, "INSERT", "A-DOOR", [(50 * i, 0)], block_name="M1") for i in range(40)]
    physical = places.place_graph(frame(spark, hub))
    one = spark.createDataFrame([(hub[0]["entity_id"],)], "entity_id STRING")
    assert places.neighbours(physical, one).count() == 40
    copies = [row(i, "LINE", "P-PIPE", [(0, 0), (9000, 0)]) for i in range(1000)] + [row(5000, "INSERT", "A-DOOR", [(9000, 10)], block_name="M1")]
    physical = places.place_graph(frame(spark, copies))
    assert physical.links.count() < 10 and physical.members.count() == 2002       # the device is free, too
    one = spark.createDataFrame([(copies[7]["entity_id"],)], "entity_id STRING")
    assert places.neighbours(physical, one).count() == 1000


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "Layer")], "node_id STRING, node_type STRING")
    edges = spark.createDataFrame([("n1", "n2", "NEAR")], "src STRING, dst STRING, relation STRING")
    graph.save_graph(nodes, edges, str(tmp_path))
    n, e = graph.load_graph(spark, str(tmp_path))
    assert n.collect() == nodes.collect() and e.collect() == edges.collect()


@pytest.mark.parametrize("tol", [50.0, 80.0])
def test_rows_anchor_on_their_first_text(spark, tol):
    rnd = random.Random(7)
    ys = [100, 80, 60, 10] + [rnd.choice([rnd.uniform(0, 3000), rnd.randrange(0, 3000, 25)]) for _ in range(200)]
    df = spark.createDataFrame([(1, float(y)) for y in ys], "sheet_id BIGINT, y DOUBLE")
    want, anchor = {}, None
    for y in sorted(set(map(float, ys)), reverse=True):
        anchor = y if anchor is None or anchor - y >= tol else anchor
        want[y] = anchor
    assert {r.y: r.row_y for r in catalog.row_anchors(df, tol).collect()} == want


def test_rows_of_one_long_run(spark):
    """100,000 heights without a gap: 1,000 rows, found in some ten rounds, no run in one row."""
    df = spark.range(100_000).selectExpr("1L AS sheet_id", "CAST(id AS DOUBLE) AS y")
    rows = catalog.row_anchors(df, 100.0).where("row_y = y").selectExpr("count(*) AS n", "max(y) AS hi", "min(y) AS lo").first()
    assert (rows.n, rows.hi, rows.lo) == (1000, 99_999.0, 99.0)
    plan = catalog.row_anchors(df.limit(1000), 100.0)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


@pytest.mark.parametrize("seed", [8, 9])
def test_snapping_is_greedy_in_drawing_order(spark, seed):
    rnd = random.Random(seed)
    segs = [(1, i, f"e{i}", 0, *[float(rnd.randrange(0, 300)) for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(segs, "sheet_id BIGINT, seq BIGINT, entity_id STRING, pos INT, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE")
    nodes, want = [], {}
    for s in segs:
        for p in (s[4:6], s[6:8]):
            hit = next((n for n in nodes if math.dist(n, p) <= 50), None)
            if hit is None:
                nodes.append(p)
                hit = p
            want.setdefault(p, hit)
    assert {(r.x, r.y): (r.nx, r.ny) for r in spaces.snap_points(df).collect()} == want


def _ends(spark, xs):
    """Short walls whose first ends stand at the given places, in drawing order; second ends far from all others."""
    rows = [(1, i, f"e{i:06d}", 0, float(x), 0.0, float(x), 1e6 + 1000.0 * i) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "sheet_id BIGINT, seq BIGINT, entity_id STRING, pos INT, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE")


def test_snapping_follows_long_chains_in_few_rounds(spark, monkeypatch):
    """10,000 ends that each meet only the one before: every second is a node, found in at most 20 rounds."""
    cuts = []
    monkeypatch.setattr(spaces, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    snapped = spaces.snap_points(_ends(spark, range(0, 400_000, 40))).where("y = 0")
    got = snapped.selectExpr("count(*) AS n", "count_if(nx = x AND x % 80 = 0) AS nodes", "count_if(nx = x - 40 AND x % 80 = 40) AS joined").first()
    assert (got.n, got.nodes, got.joined) == (10_000, 5_000, 5_000)
    assert len(cuts) <= 3 + 20


@pytest.mark.parametrize("seed,step", [(1, 10), (2, 25), (3, 60)])
def test_snapping_of_shuffled_rows_is_greedy(spark, seed, step):
    """Ends on a line in random drawing order, with several neighbours each, and repeated ends."""
    xs = [i * step for i in range(120)] + [0, step, 5 * step]
    random.Random(seed).shuffle(xs)
    nodes, want = [], {}
    for x in xs:
        want.setdefault(x, next((n for n in nodes if abs(n - x) <= 50), x))
        if want[x] == x and x not in nodes:
            nodes.append(x)
    assert {r.x: r.nx for r in spaces.snap_points(_ends(spark, xs)).where("y = 0").collect()} == want


def test_points_in_outlines_by_slabs(spark):
    """Random star-shaped outlines against a plain even-odd test; edges are joined by slab and nothing is gathered."""
    rnd = random.Random(5)
    rooms, points = [], [(1, rnd.uniform(-50, 450), rnd.uniform(-50, 450)) for _ in range(200)]
    for k, n in enumerate((3, 4, 40, 900)):
        ring = [(200 + rnd.uniform(50, 200) * math.cos(2 * math.pi * i / n), 200 + rnd.uniform(50, 200) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        points += [(1, *ring[0]), (1, ring[1][0], ring[0][1])]
        rooms.append((1, f"r{k}", n, *(f(p[i] for p in ring) for f, i in ((min, 0), (min, 1), (max, 0), (max, 1))), [(*p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]))
    df = spark.createDataFrame(rooms, "sheet_id BIGINT, space_id STRING, vertex_count BIGINT, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE, edges ARRAY<STRUCT<ux: DOUBLE, uy: DOUBLE, vx: DOUBLE, vy: DOUBLE>>")
    want = set()
    for _, x, y in points:
        for _, name, _, x0, y0, x1, y1, edges in rooms:
            if x0 <= x <= x1 and y0 <= y <= y1:
                odd = sum((e[3] > y) != (e[1] > y) and x < (e[0] - e[2]) * (y - e[3]) / (e[1] - e[3] + 1e-12) + e[2] for e in edges) % 2 == 1
                want.add((x, y, name, odd))
    tested = spaces.inside_spaces(spark.createDataFrame(points, "sheet_id BIGINT, x DOUBLE, y DOUBLE").distinct(), df)
    assert {(r.x, r.y, r.space_id, r.inside) for r in tested.collect()} == want
    assert max(r.n for r in spaces.slab_edges(df).groupBy("space_id", "slab").count().withColumnRenamed("count", "n").collect()) < 900 / 3
    assert spaces.inside_spaces(spark.createDataFrame([], "sheet_id BIGINT, x DOUBLE, y DOUBLE"), df).isEmpty()
