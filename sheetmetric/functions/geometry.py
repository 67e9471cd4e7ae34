"""Geometry over ``points`` (array<struct<x,y>>) as SQL expression texts."""
from __future__ import annotations

REST = "slice({p}, 2, greatest(size({p}) - 1, 0))"
INIT = "slice({p}, 1, greatest(size({p}) - 1, 0))"
BOX = "named_struct('xmin', {}, 'ymin', {}, 'xmax', {}, 'ymax', {})"


def distance_sql(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


def polyline_length_sql(p: str = "points", closed: str = "closed") -> str:
    """Chord lengths, plus the closing chord when closed with more than two points."""
    chords = (f"aggregate(zip_with({INIT.format(p=p)}, {REST.format(p=p)}, (a, b) -> {distance_sql('a.x', 'a.y', 'b.x', 'b.y')}), "
              "0D, (s, v) -> s + v)")
    closing = distance_sql(f"element_at({p}, -1).x", f"element_at({p}, -1).y", f"{p}[0].x", f"{p}[0].y")
    return f"({chords} + CASE WHEN {closed} AND size({p}) > 2 THEN {closing} ELSE 0D END)"


def polygon_area_sql(p: str = "points") -> str:
    """Absolute shoelace area; fewer than three points give 0."""
    turned = f"concat({REST.format(p=p)}, slice({p}, 1, 1))"
    return (f"CASE WHEN size({p}) >= 3 THEN abs(aggregate(zip_with({p}, {turned}, (a, b) -> a.x * b.y - b.x * a.y), 0D, (s, v) -> s + v)) / 2D "
            "ELSE 0D END")


# length by type; types without a measurable length give null
LENGTH = (f"CASE dxf_type WHEN 'LINE' THEN {distance_sql('points[0].x', 'points[0].y', 'points[1].x', 'points[1].y')} "
          f"WHEN 'LWPOLYLINE' THEN {polyline_length_sql()} WHEN 'ARC' THEN radians(pmod(end_angle - start_angle, 360D)) * radius "
          "WHEN 'CIRCLE' THEN 2D * pi() * radius END")
# area of closed polylines and hatch boundaries; everything else gives 0
AREA = (f"CASE WHEN dxf_type = 'HATCH' OR (dxf_type IN ('LWPOLYLINE', 'POLYLINE') AND closed) THEN {polygon_area_sql()} ELSE 0D END")


def points_bbox_sql(p: str = "points") -> str:
    xs, ys = f"transform({p}, q -> q.x)", f"transform({p}, q -> q.y)"
    return BOX.format(f"array_min({xs})", f"array_min({ys})", f"array_max({xs})", f"array_max({ys})")


def bbox_sql(text_extent: bool) -> str:
    """Axis-aligned box of an entity row.

    ``text_extent=False``: texts and dimensions are points (interchange form).
    ``text_extent=True``: texts take max(height, length * height * 0.7) by height (pool form).
    """
    x, y, h = "points[0].x", "points[0].y", "coalesce(height, 0D)"
    text = (f"WHEN dxf_type IN ('TEXT', 'MTEXT') THEN "
            + BOX.format(x, y, f"{x} + greatest({h}, length(coalesce(label_text, '')) * {h} * 0.7D)", f"{y} + {h}")) if text_extent else ""
    circle = BOX.format(f"{x} - radius", f"{y} - radius", f"{x} + radius", f"{y} + radius")
    return f"CASE WHEN dxf_type IN ('CIRCLE', 'ARC') THEN {circle} {text} ELSE {points_bbox_sql()} END"


def point_in_polygon_sql(x: str, y: str, polygon: str) -> str:
    """Even-odd ray casting with the 1e-12 denominator guard."""
    previous = f"concat(slice({polygon}, -1, 1), {INIT.format(p=polygon)})"
    crosses = f"((i.y > {y}) <> (j.y > {y})) AND {x} < (j.x - i.x) * ({y} - i.y) / (j.y - i.y + 1e-12D) + i.x"
    return f"aggregate(zip_with({polygon}, {previous}, (i, j) -> {crosses}), false, (inside, c) -> inside <> c)"
