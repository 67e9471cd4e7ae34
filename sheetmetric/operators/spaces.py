"""Rooms from wall lines, as joins and grouped aggregates.

The walls of a sheet form a plane graph.  Every wall is taken in both directions; at its end
each directed wall goes on with the next wall clockwise, so directed walls fall into cycles,
and the anticlockwise cycles are the rooms.  The cycles are found by pointer doubling: a
number of joins logarithmic in the longest outline, with no sheet ever held in one task.
Walls that cross without a common end are not split.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetmetric.functions.geometry import REST, INIT
from sheetmetric.functions.grid import near_pairs, overlapping_boxes
from sheetmetric.functions.numbers import exact_sum, half_up
from sheetmetric.functions.text import contains_any_sql, norm_sql, raw
from sheetmetric.model import fixed
from sheetmetric.operators.spatial import keep_first
from sheetmetric.session import cut_lineage

EDGE = ["ux", "uy", "vx", "vy"]
BOX = ["xmin", "ymin", "xmax", "ymax"]


def wall_segments(entities: DataFrame) -> DataFrame:
    """Segments of lines and polylines on wall layers, with the closing one of closed polylines."""
    init, rest = INIT.format(p="points"), REST.format(p="points")
    chords = f"zip_with({init}, {rest}, (a, b) -> named_struct('ax', a.x, 'ay', a.y, 'bx', b.x, 'by', b.y))"
    closing = ("CASE WHEN dxf_type = 'LWPOLYLINE' AND closed AND size(points) > 2 THEN array(named_struct('ax', element_at(points, -1).x, 'ay', element_at(points, -1).y, "
               "'bx', points[0].x, 'by', points[0].y)) ELSE array() END")
    walls = entities.where(f"dxf_type IN ('LINE', 'LWPOLYLINE') AND {contains_any_sql(norm_sql('layer'), fixed.WALL_LAYER_KEYWORDS)}")
    return walls.selectExpr("sheet_id", "seq", "entity_id", f"posexplode(concat({chords}, {closing})) AS (pos, s)").select("sheet_id", "seq", "entity_id", "pos", "s.*")


def snap_points(segments: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """Node of every segment end: (sheet_id, x, y, nx, ny).

    Ends are taken in drawing order; an end joins the earliest node within the tolerance, else
    becomes a node.  Equal ends collapse first; drawings whose ends meet exactly need no round.
    """
    ends = segments.selectExpr("sheet_id", "inline(array(named_struct('x', ax, 'y', ay, 'k', struct(seq, entity_id, pos, 0)), named_struct('x', bx, 'y', by, 'k', struct(seq, entity_id, pos, 1))))")
    points = cut_lineage(ends.groupBy("sheet_id", "x", "y").agg(F.min("k").alias("k")).withColumn("id", F.monotonically_increasing_id()))
    near = near_pairs(points.selectExpr("sheet_id", "x AS lx", "y AS ly", "id", "k AS lk"), points.selectExpr("sheet_id", "x AS rx", "y AS ry", "id AS other", "k AS rk"), tolerance)
    earlier = cut_lineage(near.where("rk < lk").select("id", "other", "rx", "ry", "rk"))
    mine = points.selectExpr("sheet_id", "x", "y", "id")
    if earlier.isEmpty():
        return mine.selectExpr("sheet_id", "x", "y", "x AS nx", "y AS ny")
    nodes = greedy_nodes(points, earlier).selectExpr("id AS other")
    joined = earlier.join(nodes, "other", "left_semi").groupBy("id").agg(F.expr("min_by(struct(rx, ry), rk) AS n"))
    return mine.join(joined, "id", "left").selectExpr("sheet_id", "x", "y", "coalesce(n.rx, x) AS nx", "coalesce(n.ry, y) AS ny")


def greedy_nodes(points: DataFrame, earlier: DataFrame) -> DataFrame:
    """Points (id) that become nodes when taken in order; ``earlier``: (id, other), the earlier neighbours of each.

    A point is a node if none of its earlier neighbours is.  What is known of a point is a term: a constant (``root``
    null, ``flip`` its value), or whether an earlier point ``root`` is a node, turned round by ``flip``.  In a round
    every point that stands for itself puts the terms of its neighbours together: a node, or both sides of one root,
    joins it; nothing left makes it a node; one term left makes it the opposite of that.  Then each term goes on to
    its root's, twice as far with every round, so chains of points that only follow each other end in a number of
    rounds that grows with the logarithm of their length.  Where points have several undecided neighbours, rounds
    grow with the depth of such decisions.
    """
    waiting = earlier.select("id").distinct().withColumn("w", F.lit(True))
    terms = cut_lineage(points.select("id").join(waiting, "id", "left").selectExpr("id", "CASE WHEN w THEN id END AS root", "w IS NULL AS flip"))
    while not terms.where("root IS NOT NULL").isEmpty():
        known = terms.selectExpr("id AS other", "root", "flip")
        seen = earlier.select("id", "other").join(terms.where("root = id").select("id"), "id", "left_semi").join(known, "other")
        sides = seen.groupBy("id", "root").agg(F.expr("bool_or(flip) AS yes"), F.expr("bool_or(NOT flip) AS no"))
        met = sides.groupBy("id").agg(F.expr("bool_or(yes AND (root IS NULL OR no)) AS joins"), F.count("root").alias("roots"),
                                      F.min("root").alias("only"), F.expr("bool_or(yes) FILTER (WHERE root IS NOT NULL) AS turned"))
        news = met.selectExpr("id", "CASE WHEN joins OR roots = 0 THEN NULL WHEN roots = 1 THEN only ELSE id END AS to",
                              "CASE WHEN joins OR roots > 1 THEN false WHEN roots = 0 THEN true ELSE NOT turned END AS turn")
        stated = terms.join(news, "id", "left").selectExpr("id", "CASE WHEN turn IS NULL THEN root ELSE to END AS root", "coalesce(turn, flip) AS flip")
        # a constant has no root: it asks under a number of its own, so that constants do not meet in one task
        ahead = stated.selectExpr("id AS ask", "root AS root2", "flip AS flip2")
        terms = cut_lineage(stated.withColumn("ask", F.expr("coalesce(root, -1 - id)")).join(ahead, "ask", "left").selectExpr(
            "id", "root2 AS root", "CASE WHEN root IS NULL THEN flip ELSE flip <> flip2 END AS flip"))
    return terms.where("flip").select("id")


def wall_edges(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct directed walls between nodes, both directions."""
    start = nodes.selectExpr("sheet_id", "x AS ax", "y AS ay", "nx AS ux", "ny AS uy")
    end = nodes.selectExpr("sheet_id", "x AS bx", "y AS by", "nx AS vx", "ny AS vy")
    one_way = segments.join(start, ["sheet_id", "ax", "ay"]).join(end, ["sheet_id", "bx", "by"]).where("ux <> vx OR uy <> vy").select("sheet_id", *EDGE)
    return one_way.unionByName(one_way.selectExpr("sheet_id", "vx AS ux", "vy AS uy", "ux AS vx", "uy AS vy")).distinct()


def outlines(edges: DataFrame) -> DataFrame:
    """Cycle label of every directed wall: (sheet_id, ux, uy, vx, vy, face)."""
    leaving = Window.partitionBy("sheet_id", "ux", "uy").orderBy("angle", "vx", "vy")
    whole = leaving.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = (edges.withColumn("angle", F.expr("atan2(vy - uy, vx - ux)"))
              .withColumn("before", F.coalesce(F.lag(F.struct("vx", "vy")).over(leaving), F.last(F.struct("vx", "vy")).over(whole))))
    key = lambda a, b, c, d: f"concat_ws(',', CAST(sheet_id AS STRING), CAST({a} AS STRING), CAST({b} AS STRING), CAST({c} AS STRING), CAST({d} AS STRING))"
    # a wall arriving at u along (v -> u) goes on with the wall before (u -> v) in angle order
    steps = cut_lineage(around.selectExpr("sheet_id", "vx AS ux", "vy AS uy", "ux AS vx", "uy AS vy", f"{key('vx', 'vy', 'ux', 'uy')} AS h",
                                          f"{key('ux', 'uy', 'before.vx', 'before.vy')} AS nxt"))
    labels = steps.selectExpr("h", "nxt", "h AS face")
    while True:
        ahead = labels.selectExpr("h AS nxt", "nxt AS nxt2", "face AS face2")
        doubled = cut_lineage(labels.join(ahead, "nxt").selectExpr("h", "nxt2 AS nxt", "least(face, face2) AS face", "face2 < face AS changed"))
        labels = doubled.drop("changed")
        if doubled.where("changed").isEmpty():
            break
    return steps.select("sheet_id", *EDGE, "h").join(labels.select("h", "face"), "h").drop("h")


def detect_spaces(entities: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """Rooms: (sheet_id, space_id, area, area_m2, vertex_count, box, edges).

    Walls with the same room on both sides bound nothing and are left out of the outline.
    """
    segments = cut_lineage(wall_segments(entities))
    faces = outlines(wall_edges(segments, snap_points(segments, tolerance)))
    back = faces.selectExpr("sheet_id", "vx AS ux", "vy AS uy", "ux AS vx", "uy AS vy", "face")
    border = faces.join(back, ["sheet_id", *EDGE, "face"], "left_anti")
    rooms = border.groupBy("sheet_id", F.col("face").alias("space_id")).agg(
        exact_sum(F.expr("ux * vy - vx * uy")).cast("double").alias("twice"), F.count("*").alias("vertex_count"), F.min("ux").alias("xmin"),
        F.min("uy").alias("ymin"), F.max("ux").alias("xmax"), F.max("uy").alias("ymax"),
        F.expr("collect_list(named_struct('ux', ux, 'uy', uy, 'vx', vx, 'vy', vy)) AS edges"))
    area = half_up(F.expr("twice / 2"), 2)
    found = rooms.where("twice >= 2 AND vertex_count >= 3").withColumn("area", area)
    return found.withColumn("area_m2", F.when(F.col("area") > 1e5, half_up(F.col("area") / 1e6, 3)).otherwise(half_up(F.col("area"), 3))).drop("twice")


def in_boxes(points: DataFrame, spaces: DataFrame) -> DataFrame:
    """Points (sheet_id, x, y, ...) with every space whose box holds them."""
    left = points.selectExpr("*", "x AS lxmin", "y AS lymin", "x AS lxmax", "y AS lymax")
    right = spaces.withColumnsRenamed({c: "r" + c for c in ("xmin", "ymin", "xmax", "ymax")})
    return overlapping_boxes(left, right)


MOST_SLABS = 64                   # of one room; a room of n edges has about sqrt(n)
SLABS = f"least({MOST_SLABS}, CAST(ceil(sqrt(vertex_count)) AS INT))"


def slab_sql(y: str, low: str = "ymin", high: str = "ymax") -> str:
    """Which of the ``slabs`` horizontal slabs of a room's box holds the height; never falls while the height grows."""
    return f"CAST(greatest(0, least(slabs - 1, floor(({y} - {low}) * slabs / ({high} - {low})))) AS INT)"


def slab_edges(spaces: DataFrame) -> DataFrame:
    """Outline edges (sheet_id, space_id, slab, ux, uy, vx, vy), each in every slab that its heights touch; level ones cross nothing."""
    edges = spaces.selectExpr("sheet_id", "space_id", "ymin", "ymax", f"{SLABS} AS slabs", "inline(edges)").where("uy <> vy")
    return edges.selectExpr("sheet_id", "space_id", f"explode(sequence({slab_sql('least(uy, vy)')}, {slab_sql('greatest(uy, vy)')})) AS slab", *EDGE)


def inside_spaces(points: DataFrame, spaces: DataFrame) -> DataFrame:
    """Points (sheet_id, x, y; distinct) with every space whose box holds them, and whether its outline does (``inside``).

    Even-odd test: a point meets the outline's edges in its own slab only, and they are counted, never gathered.
    """
    found = in_boxes(points.select("sheet_id", "x", "y"), spaces.selectExpr("sheet_id", "space_id", "xmin", "ymin", "xmax", "ymax", f"{SLABS} AS slabs"))
    asked = found.selectExpr("sheet_id", "x", "y", "space_id", f"{slab_sql('y', 'rymin', 'rymax')} AS slab")
    crosses = "((vy > y) <> (uy > y)) AND x < (ux - vx) * (y - vy) / (uy - vy + 1e-12D) + vx"
    return asked.join(slab_edges(spaces), ["sheet_id", "space_id", "slab"], "left").groupBy("sheet_id", "x", "y", "space_id").agg(
        F.expr(f"count_if({crosses}) % 2 = 1 AS inside"))


def component_space(entities: DataFrame, spaces: DataFrame) -> DataFrame:
    """Space of every block reference: the largest one containing its point, of equal ones the lowest at the left."""
    inserts = entities.where("dxf_type = 'INSERT'").selectExpr("sheet_id", "seq", "entity_id", "block_name", "points[0].x AS x", "points[0].y AS y")
    inside = inside_spaces(inserts.select("sheet_id", "x", "y").distinct(), spaces).where("inside")
    order = "struct(-area, xmin, ymin, xmax, ymax, space_id)"
    best = inside.join(spaces.select("sheet_id", "space_id", "area", *BOX), ["sheet_id", "space_id"]).groupBy("sheet_id", "x", "y").agg(
        F.expr(f"min({order}).space_id AS space_id"))
    return inserts.join(best, ["sheet_id", "x", "y"], "left")


def component_unassigned(assigned: DataFrame, keep: int = 20) -> DataFrame:
    """Block references in no space: their number per sheet and first samples."""
    rest = assigned.where("space_id IS NULL")
    counts = rest.groupBy("sheet_id").agg(F.count("*").alias("unassigned"))
    return keep_first(rest.select("sheet_id", "seq", "entity_id", "block_name"), ["sheet_id"], ["seq", "entity_id"], keep).drop("seq").join(counts, "sheet_id")


def space_name(entities: DataFrame, spaces: DataFrame) -> DataFrame:
    """First text in the space's box that is no level, number, sheet title or scale."""
    t = "trim(label_text)"
    usable = (f"dxf_type IN ('TEXT', 'MTEXT') AND {t} <> '' AND NOT {t} RLIKE {raw(fixed.ELEVATION_PATTERN)} AND NOT replace({t}, '.', '') RLIKE r'^[0-9]+$' "
              f"AND NOT {t} RLIKE {raw(fixed.NOT_A_SPACE_NAME)} AND NOT {t} RLIKE {raw(fixed.TITLE_ZONE['scale'])}")
    texts = entities.where(usable).selectExpr("sheet_id", "seq", "entity_id", f"{t} AS text", "points[0].x AS x", "points[0].y AS y")
    found = in_boxes(texts, spaces.select("sheet_id", "space_id", "xmin", "ymin", "xmax", "ymax"))
    named = found.groupBy("space_id").agg(F.expr("min_by(text, struct(seq, entity_id)) AS name"))
    return spaces.select("sheet_id", "space_id").join(named, "space_id", "left").selectExpr("sheet_id", "space_id", "coalesce(name, '') AS name")


def space_report(assigned: DataFrame, keep: int = 3) -> DataFrame:
    """Component count and most frequent blocks per space."""
    counts = assigned.where("space_id IS NOT NULL").groupBy("sheet_id", "space_id", "block_name").agg(F.count("*").alias("n"))
    totals = counts.groupBy("space_id").agg(F.sum("n").alias("components"))
    return keep_first(counts, ["sheet_id", "space_id"], [F.desc("n"), "block_name"], keep).join(totals, "space_id")


def space_totals(spaces: DataFrame) -> DataFrame:
    return spaces.groupBy("sheet_id").agg(F.count("*").alias("space_count"), exact_sum(F.col("area")).cast("double").alias("total_area"))
