"""The physical graph of drawings in factored form: entities stand at places, places are linked.

A line ends at places, a device stands at one; a place with line ends is CONNECTED to every place within the
tolerance at which a line ends or a device stands. Entities without a connection of their own are free, and places of
free entities within the tolerance are NEAR. Two different entities are linked if their places are in these roles:
a thousand copies at one place are a thousand members and no edge between them, and no list of neighbours is cut.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.functions.grid import near_pairs
from sheetmetric.operators.spatial import end_pairs, end_surroundings, free_candidates, held_places, line_ends, topology_candidates
from sheetmetric.session import stored

PLACE = ["sheet_id", "x", "y"]
END, STAND, FREE = "ENDS_AT", "STANDS_AT", "FREE_AT"
ROLES = {"CONNECTED": [(END, END), (END, STAND)], "NEAR": [(FREE, FREE)]}
CODE = {END: "0Y", STAND: "1Y", FREE: "2Y", "CONNECTED": "0Y", "NEAR": "1Y"}     # of roles and relations while they travel, in their order


@dataclass
class PlaceGraph:
    members: DataFrame      # sheet_id, x, y, role, entity_id, num (stands for entity_id)
    links: DataFrame        # sheet_id, x, y, x2, y2, relation: from the place with a line end to the other, or between free ones
    steps: DataFrame        # sheet_id, x, y, role, x2, y2, role2, relation: walks from place to place that may lead to another entity
    names: DataFrame        # num, entity_id
    counts: DataFrame       # kind, item, n: places and relations, without listing the links of line ends again


def place_graph(entities: DataFrame, tolerance: float = 3000.0, listed: bool = False) -> PlaceGraph:
    """Candidates, their places, how many are around each end and the free lines are stored; members and links are read from these where they are asked for.

    Where links or steps are ``listed`` in any case, the pairs of places are stored too: each is found once, and none is
    looked for again while links are written or steps are walked.
    """
    kept = stored if listed else (lambda df: df)
    candidates = topology_candidates(entities, ordered=False)
    held = held_places(candidates)
    pairs = kept(end_pairs(held, tolerance))
    around = end_surroundings(held, tolerance, pairs)
    free = free_candidates(candidates, around)
    role = lambda df, name: df.selectExpr("sheet_id", "x", "y", f"'{name}' AS role", "entity_id", "num")
    members = role(line_ends(candidates), END).unionByName(role(candidates.where("device"), STAND)).unionByName(role(free, FREE))
    spots = free.groupBy(*PLACE).agg(F.min("num").alias("lo"), F.max("num").alias("hi"))
    near = kept(near_pairs(spots.withColumnsRenamed({"x": "lx", "y": "ly"}), spots.selectExpr("sheet_id", "x AS rx", "y AS ry"), tolerance).selectExpr(
        "sheet_id", "rx AS x", "ry AS y", "lx AS x2", "ly AS y2", "lo", "hi"))
    ends = [*PLACE, "x2", "y2"]
    links = pairs.selectExpr(*ends, "'CONNECTED' AS relation").unionByName(near.selectExpr(*ends, "'NEAR' AS relation"))
    # from a place to itself nothing leads where one entity stands alone
    other = "x <> x2 OR y <> y2 OR lo <> hi"
    both = (f"filter(array(CASE WHEN line THEN {_step('x', 'y', END, 'x2', 'y2', END)} END, CASE WHEN stand THEN {_step('x', 'y', END, 'x2', 'y2', STAND)} END, "
            f"CASE WHEN stand THEN {_step('x2', 'y2', STAND, 'x', 'y', END)} END), s -> s IS NOT NULL)")
    steps = pairs.where(other).selectExpr("sheet_id", f"inline({both})", f"{CODE['CONNECTED']} AS relation").unionByName(
        near.where(other).selectExpr("sheet_id", f"inline(array({_step('x', 'y', FREE, 'x2', 'y2', FREE)}))", f"{CODE['NEAR']} AS relation"))
    return PlaceGraph(members, links, steps, candidates.select("num", "entity_id"), _counts(candidates, held, around, free, near))


def _counts(candidates: DataFrame, held: DataFrame, around: DataFrame, free: DataFrame, near: DataFrame) -> DataFrame:
    """The same numbers as counting places, members and links gives."""
    total = lambda df, kind, item, sql="count(*)": df.selectExpr(f"CAST({sql} AS BIGINT) AS n").selectExpr(f"'{kind}' AS kind", f"'{item}' AS item", "n")
    spots = held.select(*PLACE).unionByName(free.where("NOT line AND NOT device").select(*PLACE)).distinct()     # a free line or device stands at a held place
    parts = [total(spots, "node_type", "Place"), total(line_ends(candidates), "relation", END), total(candidates.where("device"), "relation", STAND),
             total(free, "relation", FREE), total(around, "relation", "CONNECTED", "sum(n)"), total(near, "relation", "NEAR")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _step(x: str, y: str, role: str, x2: str, y2: str, role2: str) -> str:
    return f"named_struct('x', {x}, 'y', {y}, 'role', {CODE[role]}, 'x2', {x2}, 'y2', {y2}, 'role2', {CODE[role2]})"


def neighbours(graph: PlaceGraph, entities: DataFrame) -> DataFrame:
    """(src, dst, relation): the entities linked with those given (entity_id), both directions of a connection."""
    one = entities.selectExpr("entity_id AS node_id").distinct()
    return reach(graph, one, 1).selectExpr("anchor AS src", "node AS dst", "relation")


def reach(graph: PlaceGraph, anchors: DataFrame, hops: int = 3) -> DataFrame:
    """(anchor, node, hop, relation): entities within ``hops`` links of each anchor (node_id), shortest first, relation of the last link.

    Entities with the same places in the same roles are one unit; the walk goes from units to places to units, once
    for all anchors of a unit. Numbers stand for places with their roles (spots) on the way, and members are put in at
    the end, so that what is stored meanwhile grows with places, not with copies. Every step of the way is stored, and
    its shuffles are freed.
    """
    code = "CASE role " + " ".join(f"WHEN '{r}' THEN {CODE[r]}" for r in (END, STAND, FREE)) + " END AS role"
    here = [*PLACE, "role"]
    # every step has its way back, so what no step leads to starts none either and is left out
    spots = stored(graph.steps.selectExpr("sheet_id", "x2 AS x", "y2 AS y", "role2 AS role").distinct().withColumn("spot", F.monotonically_increasing_id()))
    there = spots.selectExpr("sheet_id", "x AS x2", "y AS y2", "role AS role2", "spot AS spot2")
    steps = stored(graph.steps.join(spots, here).select("sheet_id", "x2", "y2", "role2", "spot", "relation").join(there, ["sheet_id", "x2", "y2", "role2"]).select("spot", "spot2", "relation"))
    members = graph.members.where("num IS NOT NULL").selectExpr(*PLACE, code, "num").join(spots, here).select("num", "spot")
    keyed = stored(members.groupBy("num").agg(F.sort_array(F.collect_set("spot")).alias("spots")))      # at most four for each row of an entity
    units = stored(keyed.groupBy("spots").agg(F.min("num").alias("unit")))
    own = stored(keyed.join(units, "spots").select("unit", "num"))
    at = units.select("unit", F.explode("spots").alias("spot"))
    names = graph.names.groupBy("num").agg(F.first("entity_id").alias("entity_id"))
    wanted = graph.names.join(anchors.select(F.col("node_id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("num").distinct()
    asked = stored(own.join(wanted, "num", "left_semi").selectExpr("unit AS anchor", "num"))
    frontier, found = asked.selectExpr("anchor", "anchor AS unit").distinct(), None
    for hop in range(1, hops + 1):
        touched = frontier.select("anchor", "unit").join(at, "unit").select("anchor", "spot").distinct()
        places = touched.join(steps, "spot").groupBy("anchor", F.col("spot2").alias("spot")).agg(F.min("relation").alias("relation"))
        step = places.join(at, "spot").groupBy("anchor", "unit").agg(F.min("relation").alias("relation"))
        if found is not None:
            step = step.join(found.select("anchor", "unit"), ["anchor", "unit"], "left_anti")
        frontier = stored(step.withColumn("hop", F.lit(hop).cast("long")))
        found = frontier if found is None else found.unionByName(frontier)
    rows = found.join(asked.withColumnRenamed("num", "anchor_num"), "anchor").join(own, "unit").where("anchor_num <> num")
    relation = "CASE relation " + " ".join(f"WHEN {CODE[r]} THEN '{r}'" for r in ROLES) + " END AS relation"
    named = rows.join(names.withColumnRenamed("entity_id", "node"), "num").drop("num").join(names.toDF("anchor_num", "from"), "anchor_num")
    return named.selectExpr("`from` AS anchor", "node", "hop", relation)
