"""Proximity, topology and clash operators.

Copies at one place are collapsed before every spatial join, and what a place can contribute
to a bounded answer (k nearest, first partner) is cut to what an exact argument allows: a
place never offers more than the k smallest ids, because they rank before its other ids for
every partner.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetmetric.functions.geometry import bbox_sql
from sheetmetric.functions.grid import label_pairs, near_pairs, nearest_candidates, overlapping_boxes
from sheetmetric.functions.text import contains_any_sql, nonblank_sql, norm_sql
from sheetmetric.model import fixed
from sheetmetric.operators.classify import categorized
from sheetmetric.session import cut_lineage, stored

DEVICES = "dxf_type IN ('INSERT', 'CIRCLE', 'ARC', 'POINT')"
LINES = "dxf_type IN ('LINE', 'LWPOLYLINE', 'POLYLINE') AND size(points) >= 2"


def keep_first(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key; Spark limits groups before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def places(points: DataFrame, k: int, keys=("sheet_id", "x", "y"), ident: str = "entity_id") -> DataFrame:
    """One row per place with its k smallest ids."""
    smallest = keep_first(points.select(*keys, ident).distinct(), keys, [ident], k)
    return smallest.groupBy(*keys).agg(F.sort_array(F.collect_list(ident)).alias("ids"))


def layer_points(entities: DataFrame) -> DataFrame:
    """Representative points: block references and non-blank texts."""
    return entities.where(f"dxf_type = 'INSERT' OR (dxf_type IN ('TEXT', 'MTEXT') AND {nonblank_sql('label_text')})").selectExpr(
        "sheet_id", "layer", "points[0].x AS x", "points[0].y AS y", "entity_id")


def _layer_place_pairs(entities: DataFrame, tolerance: float, k: int) -> DataFrame:
    keys = ["sheet_id", "layer", "x", "y"]
    points = layer_points(entities)
    counted = points.groupBy(*keys).agg(F.count("*").alias("n"))
    if k:
        counted = counted.join(places(points, k, keys), keys)
    side = lambda p: counted.select("sheet_id", *[F.col(c).alias(p + c) for c in counted.columns if c != "sheet_id"])
    return near_pairs(side("l"), side("r"), tolerance).where("llayer < rlayer")


def cross_layer_proximity(entities: DataFrame, tolerance: float = 3000.0) -> DataFrame:
    """Number of close point pairs per pair of layers, counted by cells where these are crowded."""
    points = layer_points(entities).groupBy("sheet_id", "x", "y", F.col("layer").alias("label")).agg(F.count("*").alias("n"))
    return label_pairs(points, tolerance).selectExpr("sheet_id", "llabel AS layer_a", "rlabel AS layer_b", "pairs AS pair_count")


def top_pairs_per_layer_pair(entities: DataFrame, tolerance: float = 3000.0, keep: int = 10) -> DataFrame:
    """Closest pairs per layer pair."""
    keys = ["sheet_id", "llayer", "rlayer"]
    near = keep_first(_layer_place_pairs(entities, tolerance, keep), keys, [F.col("dist"), F.expr("lids[0]"), F.expr("rids[0]")], keep)
    pairs = near.select(*keys, "dist", F.explode("lids").alias("entity_a"), "rids").withColumn("entity_b", F.explode("rids")).drop("rids")
    return keep_first(pairs, keys, ["dist", "entity_a", "entity_b"], keep).selectExpr(
        "sheet_id", "llayer AS layer_a", "rlayer AS layer_b", "CAST(rank AS BIGINT) AS rank", "entity_a", "entity_b", "dist")


def top_layer_pairs(proximity: DataFrame, keep: int = 30) -> DataFrame:
    return keep_first(proximity, ["sheet_id"], [F.desc("pair_count"), "layer_a", "layer_b"], keep)


def legend_entries(entities: DataFrame) -> DataFrame:
    """Distinct texts in the window right below a legend title (other than the title itself)."""
    texts = entities.where("dxf_type IN ('TEXT', 'MTEXT') AND label_text <> ''").selectExpr(
        "sheet_id", "trim(label_text) AS text", f"{norm_sql('label_text')} AS u", "points[0].x AS x", "points[0].y AS y").distinct()
    titles = [t.upper() for t in fixed.LEGEND_TITLES]
    anchors = texts.where(contains_any_sql("u", titles)).selectExpr("sheet_id", "u AS au", "x AS ax", "y AS ay").distinct()
    size = 8000
    a = anchors.select("*", F.expr(f"explode(sequence(floor((ax - 8000) / {size}), floor((ax + 8000) / {size}))) AS cx")).select(
        "*", F.expr(f"explode(sequence(floor((ay - 6000) / {size}), floor((ay + 500) / {size}))) AS cy"))
    b = texts.selectExpr("*", f"floor(x / {size}) AS cx", f"floor(y / {size}) AS cy")
    window = "abs(x - ax) < 8000 AND y - ay > -6000 AND y - ay < 500 AND u <> au"
    joined = b.alias("b").join(a.alias("a"), F.expr(f"b.sheet_id = a.sheet_id AND b.cx = a.cx AND b.cy = a.cy AND {window}"), "left_semi")
    return joined.select("sheet_id", "text", "x", "y").distinct()


def nearby_text(entities: DataFrame, radius: float = 8000.0) -> DataFrame:
    """Texts around every entity: how many, and the distinct ones in drawing order joined by a space."""
    texts = entities.where("dxf_type IN ('TEXT', 'MTEXT') AND label_text <> ''").groupBy(
        "sheet_id", F.expr("points[0].x AS rx"), F.expr("points[0].y AS ry"), "label_text").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    here = entities.selectExpr("sheet_id", "points[0].x AS lx", "points[0].y AS ly", "entity_id")
    found = near_pairs(here.select("sheet_id", "lx", "ly").distinct(), texts, radius)
    per_text = found.groupBy("sheet_id", "lx", "ly", "label_text").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    joined = per_text.groupBy("sheet_id", "lx", "ly").agg(
        F.sum("n").alias("n_texts"), F.expr("array_join(transform(array_sort(collect_list(struct(first, label_text))), t -> t.label_text), ' ') AS nearby_text"))
    return here.join(joined, ["sheet_id", "lx", "ly"]).select("entity_id", "n_texts", "nearby_text")


def _nearest(sources: DataFrame, targets: DataFrame, radius: float, k: int, points_per_target: int) -> DataFrame:
    """For every source place the k + 1 nearest distinct ids among the targets (ties by id)."""
    offered = cut_lineage(places(targets, k + 1, ident="num").selectExpr("sheet_id", "x AS rx", "y AS ry", "ids"))
    rows = (k + 1) * points_per_target       # an id can occur once per point it has
    near = nearest_candidates(sources.selectExpr("sheet_id", "x AS lx", "y AS ly").distinct(), offered, radius, "size(ids)", rows)
    at = ["sheet_id", "lx", "ly"]
    closest = keep_first(near, at, [F.col("dist"), F.expr("ids[0]")], rows).drop("rank").withColumn("dst", F.explode("ids"))
    unique = keep_first(closest, at, ["dist", "dst"], rows).groupBy(*at, "dst").agg(F.min("dist").alias("dist"))
    return keep_first(unique, at, ["dist", "dst"], k + 1).drop("rank")


def _linked(owners: DataFrame, nearest: DataFrame, k: int) -> DataFrame:
    """k nearest per entity from the lists of its places, itself excluded."""
    rows = owners.selectExpr("sheet_id", "x AS lx", "y AS ly", "num AS src").join(nearest, ["sheet_id", "lx", "ly"]).where("src <> dst")
    # one shuffle serves the grouping and the ranking
    return keep_first(rows.repartition("sheet_id", "src").groupBy("sheet_id", "src", "dst").agg(F.min("dist").alias("dist")), ["sheet_id", "src"], ["dist", "dst"], k)


def topology_candidates(entities: DataFrame, ordered: bool = True) -> DataFrame:
    """Entities that take part in topology, stored: a physical category and coordinates; ends and stand, a number, whether others share it.

    ``num`` stands for ``entity_id`` in all that follows: equal ids have one number, and numbers are in the order of ids,
    so ties by number are ties by id, and no id travels before a result is named. Without ``ordered`` numbers only tell
    ids apart, and the pass over the entities that samples ranges is saved.
    """
    skip = ", ".join(f"'{c}'" for c in fixed.NO_TOPOLOGY_CATEGORIES)
    found = categorized(entities.where("dxf_type <> 'HATCH' AND size(points) >= 1")).where(f"category NOT IN ({skip})").selectExpr(
        "sheet_id", "entity_id", f"{LINES} AS line", f"{DEVICES} AS device", "points[0].x AS x", "points[0].y AS y",
        "element_at(points, -1).x AS ex", "element_at(points, -1).y AS ey")
    dealt = found.repartitionByRange("entity_id").sortWithinPartitions("entity_id") if ordered else found.repartition("entity_id")
    dealt = dealt.withColumn("at", F.monotonically_increasing_id())
    return stored(dealt.withColumns({"num": F.expr("CASE WHEN entity_id IS NOT NULL THEN min(at) OVER (PARTITION BY entity_id) END"),
                                     "shared": F.expr("entity_id IS NOT NULL AND count(*) OVER (PARTITION BY entity_id) > 1")}).drop("at"))


def line_ends(candidates: DataFrame) -> DataFrame:
    """Both ends of every line (one if they are equal): sheet_id, num, entity_id, x, y."""
    return candidates.where("line").selectExpr(
        "sheet_id", "num", "entity_id", "inline(array_distinct(array(named_struct('x', x, 'y', y), named_struct('x', ex, 'y', ey))))")


def held_places(candidates: DataFrame) -> DataFrame:
    """Places of line ends and devices, stored: what is there (line, stand), least and greatest number (lo, hi)."""
    ends, devices = line_ends(candidates), candidates.where("device")
    fixed_at = ends.selectExpr("sheet_id", "x", "y", "num", "true AS line").unionByName(devices.selectExpr("sheet_id", "x", "y", "num", "false AS line"))
    return stored(fixed_at.groupBy("sheet_id", "x", "y").agg(F.min("num").alias("lo"), F.max("num").alias("hi"), F.bool_or("line").alias("line"), F.expr("bool_or(NOT line) AS stand")))


def end_pairs(held: DataFrame, tolerance: float) -> DataFrame:
    """Places with a line end (x, y) and the places of ends and devices within the tolerance (x2, y2; line, stand, lo, hi: as in ``held_places``)."""
    # the ends stand in several cells, not what carries more
    met = near_pairs(held.withColumnsRenamed({"x": "lx", "y": "ly"}), held.where("line").selectExpr("sheet_id", "x AS rx", "y AS ry"), tolerance)
    return met.selectExpr("sheet_id", "rx AS x", "ry AS y", "lx AS x2", "ly AS y2", "line", "stand", "lo", "hi")


def end_surroundings(held: DataFrame, tolerance: float, pairs: DataFrame | None = None) -> DataFrame:
    """Places with a line end, stored: number of places within the tolerance (n), least and greatest number there (lo, hi); from their ``end_pairs`` where these are at hand."""
    return stored((pairs or end_pairs(held, tolerance)).groupBy("sheet_id", "x", "y").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def free_candidates(candidates: DataFrame, around: DataFrame) -> DataFrame:
    """Candidates without a connection of their own: no other entity's end or device within the tolerance of an end of theirs.

    ``around``: see ``end_surroundings``. Only lines, and what shares its id, can be tied; the other candidates are free as they stand.
    """
    # an end is within the tolerance of itself, so two numbers around it mean that another entity is there
    busy = around.where("lo <> hi").select("sheet_id", "x", "y")
    tied = line_ends(candidates).drop("entity_id").join(busy, ["sheet_id", "x", "y"], "left_semi").select("num").distinct()
    asked = "line OR shared"
    return candidates.where(f"NOT ({asked})").unionByName(stored(candidates.where(asked).join(tied, "num", "left_anti")))


def topology_connected(candidates: DataFrame, tolerance: float = 3000.0, keep: int = 15) -> DataFrame:
    """Line ends against devices and other line ends: the nearest ``keep`` per line (numbers of both, see ``topology_candidates``)."""
    ends = line_ends(candidates).drop("entity_id")
    devices = candidates.where("device").select("sheet_id", "num", "x", "y")
    return _linked(ends, _nearest(ends, ends.unionByName(devices), tolerance, keep, 2), keep)


def topology_near(candidates: DataFrame, tolerance: float = 3000.0, keep: int = 10) -> DataFrame:
    """Nearest neighbours among the entities without a connection, as ``topology_connected`` gives them."""
    around = end_surroundings(held_places(candidates), tolerance)
    rest = free_candidates(candidates, around).select("sheet_id", "num", "x", "y")
    return _linked(rest, _nearest(rest, rest, tolerance, keep, 1), keep)


def topology_ranks(entities: DataFrame, tolerance: float = 3000.0, relations=("CONNECTED", "NEAR")) -> DataFrame:
    """Edges between numbered entities (sheet_id, src, dst, dist, rank, relation) and the stored candidates that name them."""
    candidates = topology_candidates(entities)
    parts = {"CONNECTED": topology_connected, "NEAR": topology_near}
    edges = [parts[r](candidates, tolerance).withColumn("relation", F.lit(r)) for r in relations]
    return (edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])), candidates


def topology(entities: DataFrame, tolerance: float = 3000.0, relations=("CONNECTED", "NEAR")) -> DataFrame:
    """Edges (sheet_id, src, dst, relation, dist, rank)."""
    edges, candidates = topology_ranks(entities, tolerance, relations)
    ids = candidates.select("num", "entity_id").groupBy("num").agg(F.first("entity_id").alias("entity_id"))
    name = lambda df, c: df.withColumnRenamed(c, "num").join(ids.withColumnRenamed("entity_id", c), "num").drop("num")
    return name(name(edges, "src"), "dst").select("sheet_id", "src", "dst", "relation", "dist", "rank")


BOX = ("xmin", "ymin", "xmax", "ymax")


def bbox_clash(entities: DataFrame, a_words, b_words, tolerance: float = 0.0) -> DataFrame:
    """Every A entity whose box touches a B box, with its first B (sheet_id, entity_id, partner)."""
    boxed = entities.where("dxf_type <> 'HATCH'").selectExpr(
        "sheet_id", "seq", "entity_id", "upper(concat_ws(' ', layer, coalesce(block_name, ''))) AS u", f"inline(array({bbox_sql(False)}))")
    a = boxed.where(contains_any_sql("u", [w.upper() for w in a_words]))
    b = boxed.where(contains_any_sql("u", [w.upper() for w in b_words]))
    grown = [f"{c} - {tolerance}D AS l{c}" if c.endswith("min") else f"{c} + {tolerance}D AS l{c}" for c in BOX]
    a_boxes = a.selectExpr("sheet_id", *grown).distinct()
    b_boxes = b.groupBy("sheet_id", *[F.col(c).alias("r" + c) for c in BOX]).agg(F.expr("min(struct(seq, entity_id)) AS first"))
    keys = ["sheet_id", *["l" + c for c in BOX]]
    partners = overlapping_boxes(a_boxes, b_boxes).groupBy(*keys).agg(F.min("first").alias("first"))
    return a.selectExpr("sheet_id", "entity_id", *grown).join(partners, keys).selectExpr("sheet_id", "entity_id", "first.entity_id AS partner")


def pair_distance(entities: DataFrame, a_words, b_words, threshold: float) -> DataFrame:
    """Every A entity nearer than the threshold to a B entity (first coordinates, by layer), with its first B."""
    points = entities.where("dxf_type <> 'HATCH' AND size(points) >= 1").selectExpr(
        "sheet_id", "seq", "entity_id", "upper(layer) AS u", "points[0].x AS x", "points[0].y AS y")
    a = points.where(contains_any_sql("u", [w.upper() for w in a_words])).withColumnsRenamed({"x": "lx", "y": "ly"})
    b = points.where(contains_any_sql("u", [w.upper() for w in b_words]))
    b_places = b.groupBy("sheet_id", F.col("x").alias("rx"), F.col("y").alias("ry")).agg(F.expr("min(struct(seq, entity_id)) AS first"))
    keys = ["sheet_id", "lx", "ly"]
    partners = near_pairs(a.select(*keys).distinct(), b_places, threshold, strict=True).groupBy(*keys).agg(F.min("first").alias("first"))
    return a.join(partners, keys).selectExpr("sheet_id", "entity_id", "first.entity_id AS partner")
