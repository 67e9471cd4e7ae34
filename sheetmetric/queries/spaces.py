"""Queries of the space operators."""
from pyspark.sql import functions as F

from sheetmetric.model import adapter, fixed
from sheetmetric.operators import spaces as sp
from sheetmetric.queries import sql
from sheetmetric.session import cut_lineage


def spaces(spark, sf):
    return sp.detect_spaces(adapter.entities(spark, sf))


def wide_spaces(spark, sf):
    """Rooms drawn twenty times larger from their lower left corner, so that they hold components."""
    grow = lambda c, low: f"{low} + ({c} - {low}) * 20 AS {c}"
    edges = "transform(edges, e -> named_struct('ux', xmin + (e.ux - xmin) * 20, 'uy', ymin + (e.uy - ymin) * 20, 'vx', xmin + (e.vx - xmin) * 20, 'vy', ymin + (e.vy - ymin) * 20)) AS edges"
    return cut_lineage(spaces(spark, sf).selectExpr("sheet_id", "space_id", "area * 400 AS area", "vertex_count", "xmin", "ymin", grow("xmax", "xmin"), grow("ymax", "ymin"), edges))


ROOM = ["area", "xmin", "ymin"]


def assigned(spark, sf, rooms=None):
    return sp.component_space(adapter.entities(spark, sf), rooms or wide_spaces(spark, sf))


def with_room(found, rooms, how="inner"):
    """Rows with area and lower left corner of their room, in place of its key."""
    return found.join(rooms.select("sheet_id", "space_id", *ROOM), ["sheet_id", "space_id"], how)


def _owners(spark, sf):
    rooms = wide_spaces(spark, sf)
    return with_room(assigned(spark, sf, rooms).where("space_id IS NOT NULL"), rooms).select("entity_id", "block_name", "sheet_id", *ROOM)


def _names(spark, sf):
    rooms = wide_spaces(spark, sf)
    return with_room(sp.space_name(adapter.entities(spark, sf), rooms), rooms).select("sheet_id", "name", *ROOM)


def _report(spark, sf):
    rooms = wide_spaces(spark, sf)
    return with_room(sp.space_report(assigned(spark, sf, rooms)), rooms).selectExpr("sheet_id", "block_name", "n", "components", "CAST(rank AS BIGINT) AS rank", *ROOM)


def _segments(spark, sf):
    return sp.wall_segments(adapter.entities(spark, sf)).selectExpr("entity_id", "CAST(pos AS BIGINT) AS pos", "ax", "ay", "bx", "by AS by_")


def _pip(spark, sf):
    """Points of block references tested against the outline of every room of their sheet whose box holds them."""
    rooms = wide_spaces(spark, sf)
    places = adapter.entities(spark, sf).where("dxf_type = 'INSERT'").selectExpr("sheet_id", "entity_id", "points[0].x AS x", "points[0].y AS y")
    tested = sp.inside_spaces(places.select("sheet_id", "x", "y").distinct(), rooms)
    return with_room(places.join(tested, ["sheet_id", "x", "y"]), rooms).select("entity_id", "inside", *ROOM)


QUERIES = {
    "wall_segments": _segments,
    "snap_points": lambda s, d: sp.snap_points(sp.wall_segments(adapter.entities(s, d)), 120.0),
    "detect_spaces": lambda s, d: spaces(s, d).select("sheet_id", "area", "area_m2", "vertex_count", "xmin", "ymin", "xmax", "ymax"),
    "point_in_polygon": _pip,
    "component_space": _owners,
    "component_unassigned": lambda s, d: sp.component_unassigned(assigned(s, d)).withColumn("rank", F.col("rank").cast("long")),
    "space_name": _names,
    "space_report": _report,
    "space_totals": lambda s, d: sp.space_totals(spaces(s, d)),
}

WALL = sql.any_of("upper(layer)", fixed.WALL_LAYER_KEYWORDS)
SEGS = (f"walls AS (SELECT * FROM ent WHERE dxf_type IN ('LINE', 'LWPOLYLINE') AND {WALL}), "
        "segs AS (SELECT sheet_id, seq, entity_id, 0 AS pos, x0 AS ax, y0 AS ay, x0 + w AS bx, y0 AS by_ FROM walls UNION ALL "
        "SELECT sheet_id, seq, entity_id, 1, x0 + w, y0, x0 + w, y0 + h FROM walls WHERE dxf_type = 'LWPOLYLINE' UNION ALL "
        "SELECT sheet_id, seq, entity_id, 2, x0 + w, y0 + h, x0, y0 + h FROM walls WHERE dxf_type = 'LWPOLYLINE' UNION ALL "
        "SELECT sheet_id, seq, entity_id, 3, x0, y0 + h, x0, y0 FROM walls WHERE dxf_type = 'LWPOLYLINE' AND closed)")
FACES = ("he AS (SELECT DISTINCT * FROM (SELECT sheet_id, ax AS ux, ay AS uy, bx AS vx, by_ AS vy FROM segs UNION ALL SELECT sheet_id, bx, by_, ax, ay FROM segs) WHERE ux <> vx OR uy <> vy), "
         "ang AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, ux, uy ORDER BY atan2(vy - uy, vx - ux)) AS i, count(*) OVER (PARTITION BY sheet_id, ux, uy) AS k FROM he), "
         "nxt AS MATERIALIZED (SELECT a.sheet_id, a.vx AS ux, a.vy AS uy, a.ux AS vx, a.uy AS vy, b.vx AS wx, b.vy AS wy FROM ang a JOIN ang b ON a.sheet_id = b.sheet_id AND a.ux = b.ux AND a.uy = b.uy AND b.i = CASE WHEN a.i = 1 THEN a.k ELSE a.i - 1 END), "
         "walk AS (SELECT sheet_id, ux AS su, uy AS sv, vx AS sx, vy AS sy, ux, uy, vx, vy FROM nxt UNION SELECT w.sheet_id, su, sv, sx, sy, n.vx, n.vy, n.wx, n.wy FROM walk w JOIN nxt n ON w.sheet_id = n.sheet_id AND w.ux = n.ux AND w.uy = n.uy AND w.vx = n.vx AND w.vy = n.vy), "
         "lab AS (SELECT sheet_id, su AS ux, sv AS uy, sx AS vx, sy AS vy, min((ux, uy, vx, vy)) AS face FROM walk GROUP BY ALL), "
         "border AS (SELECT a.* FROM lab a JOIN lab b ON a.sheet_id = b.sheet_id AND a.ux = b.vx AND a.uy = b.vy AND a.vx = b.ux AND a.vy = b.uy WHERE a.face <> b.face), "
         "rooms AS MATERIALIZED (SELECT sheet_id, face, CAST(sum(ux * vy - vx * uy) AS DOUBLE) / 2 AS area, count(*) AS vertex_count, CAST(min(ux) AS DOUBLE) AS xmin, CAST(min(uy) AS DOUBLE) AS ymin, CAST(max(ux) AS DOUBLE) AS xmax, CAST(max(uy) AS DOUBLE) AS ymax "
         "FROM border GROUP BY ALL HAVING sum(ux * vy - vx * uy) >= 2 AND count(*) >= 3)")
WIDE = ("wrooms AS MATERIALIZED (SELECT sheet_id, face, area * 400 AS area, xmin, ymin, xmin + (xmax - xmin) * 20 AS xmax, ymin + (ymax - ymin) * 20 AS ymax FROM rooms), "
        "wborder AS MATERIALIZED (SELECT b.sheet_id, b.face, xmin + (b.ux - xmin) * 20 AS ux, ymin + (b.uy - ymin) * 20 AS uy, xmin + (b.vx - xmin) * 20 AS vx, ymin + (b.vy - ymin) * 20 AS vy FROM border b JOIN wrooms r ON b.sheet_id = r.sheet_id AND b.face = r.face)")
INSIDE = (WIDE + ", tests AS MATERIALIZED (SELECT e.sheet_id, e.entity_id, e.seq, e.block_name, r.face, r.area, r.xmin, r.ymin, r.xmax, r.ymax, count(*) FILTER (WHERE (b.vy > e.y0) <> (b.uy > e.y0) AND e.x0 < (b.ux - b.vx) * (e.y0 - b.vy) / (b.uy - b.vy + 1e-12) + b.vx) % 2 = 1 AS inside "
          "FROM ent e JOIN wrooms r ON e.sheet_id = r.sheet_id AND e.dxf_type = 'INSERT' AND e.x0 BETWEEN r.xmin AND r.xmax AND e.y0 BETWEEN r.ymin AND r.ymax JOIN wborder b ON b.sheet_id = r.sheet_id AND b.face = r.face GROUP BY ALL), "
          "owner AS (SELECT sheet_id, entity_id, block_name, seq, face, area, xmin, ymin FROM tests WHERE inside QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY area DESC, xmin, ymin, xmax, ymax, face) = 1)")
CTES = [sql.ENT, SEGS, FACES, INSIDE]
NODES = ("pts AS (SELECT sheet_id, x, y, row_number() OVER (PARTITION BY sheet_id ORDER BY min(k)) AS o FROM (SELECT sheet_id, ax AS x, ay AS y, (seq, entity_id, pos, 0) AS k FROM segs UNION ALL SELECT sheet_id, bx, by_, (seq, entity_id, pos, 1) FROM segs) GROUP BY sheet_id, x, y), "
         "greedy AS (SELECT sheet_id, 1::BIGINT AS step, [{'x': x, 'y': y}] AS leaders FROM pts WHERE o = 1 UNION ALL SELECT g.sheet_id, g.step + 1, CASE WHEN len([l FOR l IN g.leaders IF (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) <= 14400]) > 0 THEN g.leaders "
         "ELSE list_append(g.leaders, {'x': p.x, 'y': p.y}) END FROM greedy g JOIN pts p ON p.sheet_id = g.sheet_id AND p.o = g.step + 1), "
         "final AS (SELECT sheet_id, arg_max(leaders, step) AS leaders FROM greedy GROUP BY sheet_id), "
         "snapped AS (SELECT sheet_id, x, y, n.x AS nx, n.y AS ny FROM (SELECT p.sheet_id, p.x, p.y, ([l FOR l IN f.leaders IF (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) <= 14400])[1] AS n FROM pts p JOIN final f USING (sheet_id)))")
USABLE = "dxf_type = 'TEXT' AND trim(label_text) <> '' AND NOT regexp_matches(label_text, '[+\\-±]\\s?\\d+\\.\\d{3}') AND NOT regexp_matches(trim(label_text), '平面图|立面图|剖面图|详图|系统图|大样图|总平面|图$') AND NOT regexp_matches(label_text, '1\\s*[:：]\\s*\\d+')"
ORACLES = {
    "wall_segments": sql.query("SELECT entity_id, CAST(pos AS BIGINT) AS pos, CAST(ax AS DOUBLE) AS ax, CAST(ay AS DOUBLE) AS ay, CAST(bx AS DOUBLE) AS bx, CAST(by_ AS DOUBLE) AS by_ FROM segs", sql.ENT, SEGS),
    "snap_points": sql.query("SELECT sheet_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(nx AS DOUBLE) AS nx, CAST(ny AS DOUBLE) AS ny FROM snapped", sql.ENT, SEGS, NODES, recursive=True),
    "detect_spaces": sql.query(f"SELECT sheet_id, area, CASE WHEN area > 1e5 THEN {sql.rnd('area / 1e6', 3)} ELSE area END AS area_m2, vertex_count, xmin, ymin, xmax, ymax FROM rooms", *CTES[:3], recursive=True),
    "point_in_polygon": sql.query("SELECT entity_id, inside, area, xmin, ymin FROM tests", *CTES, recursive=True),
    "component_space": sql.query("SELECT entity_id, block_name, sheet_id, area, xmin, ymin FROM owner", *CTES, recursive=True),
    "component_unassigned": sql.query("SELECT sheet_id, entity_id, block_name, row_number() OVER (PARTITION BY sheet_id ORDER BY seq, entity_id) AS rank, count(*) OVER (PARTITION BY sheet_id) AS unassigned FROM ent WHERE dxf_type = 'INSERT' AND entity_id NOT IN (SELECT entity_id FROM owner) QUALIFY rank <= 20", *CTES, recursive=True),
    "space_name": sql.query(f"SELECT r.sheet_id, coalesce(arg_min(trim(t.label_text), (t.seq, t.entity_id)), '') AS name, r.area, r.xmin, r.ymin FROM wrooms r LEFT JOIN (SELECT * FROM ent WHERE {USABLE}) t ON r.sheet_id = t.sheet_id AND t.x0 BETWEEN r.xmin AND r.xmax AND t.y0 BETWEEN r.ymin AND r.ymax GROUP BY r.sheet_id, r.face, r.area, r.xmin, r.ymin", *CTES, recursive=True),
    "space_report": sql.query("SELECT sheet_id, block_name, n, components, rank, area, xmin, ymin FROM (SELECT sheet_id, face, area, xmin, ymin, block_name, n, CAST(sum(n) OVER (PARTITION BY sheet_id, face) AS BIGINT) AS components, row_number() OVER (PARTITION BY sheet_id, face ORDER BY n DESC, block_name) AS rank FROM "
                              "(SELECT sheet_id, face, area, xmin, ymin, block_name, count(*) AS n FROM owner GROUP BY ALL)) WHERE rank <= 3", *CTES, recursive=True),
    "space_totals": sql.query("SELECT sheet_id, count(*) AS space_count, sum(area) AS total_area FROM rooms GROUP BY sheet_id", *CTES[:3], recursive=True),
}
