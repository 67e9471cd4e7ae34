"""Spatial joins as equi-joins on grid cells.

Catalyst has no distance or box join; an explicit cell column makes each of them an
ordinary equi-join on (sheet, cell), which adaptive execution can split when a cell is hot.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.session import cut_lineage

BASE, FACTOR, TOP = 4096, 16, 4   # box cells: BASE * FACTOR^level, levels 0..TOP
EDGE = 8                          # outermost cell index of the top level (far-away strays share it)


def near_pairs(left: DataFrame, right: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """Pairs of ``left`` (sheet_id, lx, ly, ...) and ``right`` (sheet_id, rx, ry, ...) within ``radius``, with ``dist``.

    Cells are twice the radius wide, so a disc touches at most four of them; every pair meets
    in exactly one cell, the one of the left point.
    """
    size = 2.0 * radius
    a = left.withColumns({"cx": F.expr(f"floor(lx / {size}D)"), "cy": F.expr(f"floor(ly / {size}D)")})
    span = lambda c: f"explode(sequence(floor(({c} - {radius}D) / {size}D), floor(({c} + {radius}D) / {size}D)))"
    b = right.select("*", F.expr(f"{span('rx')} AS cx")).select("*", F.expr(f"{span('ry')} AS cy"))
    d2 = "(lx - rx) * (lx - rx) + (ly - ry) * (ly - ry)"
    return (a.join(b, ["sheet_id", "cx", "cy"]).where(f"{d2} {'<' if strict else '<='} {radius * radius}D")
            .withColumn("dist", F.expr(f"sqrt({d2})")).drop("cx", "cy"))


PAIR_LEVELS, FEW = 14, 64         # halvings of cells while counting; cell pairs of this many place pairs are compared at once


def _cells(points: DataFrame, radius: float, level: int) -> DataFrame:
    """Points with their cell at a level, of a side of 2 radius / 2^level."""
    return points.select("*", *[F.expr(f"floor({c} * {float(1 << level)}D / {2.0 * radius}D)").alias(a) for c, a in (("x", "cx"), ("y", "cy"))])


def cell_pairs(points: DataFrame, radius: float):
    """Levels of the descent that ``label_pairs`` makes: (level, pairs of cells wholly within the radius, pairs to compare).

    A pair (sheet_id, ax, ay, bx, by, na, nb) holds two cells and their numbers of places. It is kept whole where all
    of its distances are below the radius, dropped where all are beyond, compared where it is small, else split.
    """
    filled = lambda level: _cells(points, radius, level).groupBy("sheet_id", "cx", "cy").agg(F.count("*").alias("places"))
    end = lambda df, p, *more: df.select("sheet_id", F.col("cx").alias(f"{p}x"), F.col("cy").alias(f"{p}y"), F.col("places").alias(f"n{p}"), *more)
    cells = cut_lineage(filled(0))
    near = end(cells, "a").withColumn("bx", F.explode(F.expr("sequence(ax - 1, ax + 1)"))).withColumn("by", F.explode(F.expr("sequence(ay - 1, ay + 1)")))
    pairs = near.join(end(cells, "b"), ["sheet_id", "bx", "by"])
    for level in range(PAIR_LEVELS + 1):
        far, close = ("pow(abs(ax - bx) + 1, 2) + pow(abs(ay - by) + 1, 2)", "pow(greatest(abs(ax - bx) - 1, 0), 2) + pow(greatest(abs(ay - by) - 1, 0), 2)")
        pairs = cut_lineage(pairs.where(f"4 * ({close}) <= {4 ** level}").withColumn("whole", F.expr(f"4 * ({far}) < {4 ** level}")))
        small = f"NOT whole AND {'true' if level == PAIR_LEVELS else f'na * nb <= {FEW}'}"
        yield level, pairs.where("whole"), pairs.where(small)
        rest = pairs.where(f"NOT whole AND NOT ({small})").drop("whole", "na", "nb")
        if level == PAIR_LEVELS or rest.isEmpty():
            return
        children = cut_lineage(filled(level + 1))
        half = lambda p: end(children, f"c{p}", F.expr("shiftright(cx, 1)").alias(f"{p}x"), F.expr("shiftright(cy, 1)").alias(f"{p}y"))
        pairs = (rest.join(half("a"), ["sheet_id", "ax", "ay"]).join(half("b"), ["sheet_id", "bx", "by"])
                 .selectExpr("sheet_id", "cax AS ax", "cay AS ay", "cbx AS bx", "cby AS by", "nca AS na", "ncb AS nb"))


def label_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Number of point pairs within ``radius`` by their two labels, the smaller first: sheet_id, llabel, rlabel, pairs.

    ``points``: sheet_id, x, y, label, n (one row per place and label). Pairs are counted, not listed: cells that lie
    wholly within the radius of each other multiply their counts, and only cells at the border are split.
    """
    points = cut_lineage(points.where("x IS NOT NULL AND y IS NOT NULL"))
    found = []
    for level, whole, small in cell_pairs(points, radius):
        at = _cells(points, radius, level)
        inside = at.groupBy("sheet_id", "cx", "cy", "label").agg(F.sum("n").alias("n"))
        side = lambda df, cell, p, *more: df.select("sheet_id", F.col("cx").alias(f"{cell}x"), F.col("cy").alias(f"{cell}y"), *[F.col(c).alias(p + c) for c in ("label", "n", *more)])
        met = lambda pairs, df, *more: (pairs.join(side(df, "a", "l", *more), ["sheet_id", "ax", "ay"]).join(side(df, "b", "r", *more), ["sheet_id", "bx", "by"]).where("llabel < rlabel"))
        if level > 1:       # no cells of the first two levels lie within the radius
            found.append(met(whole, inside).select("sheet_id", "llabel", "rlabel", F.expr("ln * rn").alias("pairs")))
        found.append(met(small, at, "x", "y").where(f"(lx - rx) * (lx - rx) + (ly - ry) * (ly - ry) <= {radius * radius}D").select("sheet_id", "llabel", "rlabel", F.expr("ln * rn").alias("pairs")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy("sheet_id", "llabel", "rlabel").agg(F.sum("pairs").alias("pairs"))


LEVELS = 16                       # halvings of the radius that a search in a crowd may shrink to


def _square(x: str, y: str, level: str, radius: float) -> list:
    """Cell at a level, of a side of radius / 2^level."""
    return [F.expr(f"floor({c} * pow(2D, {level}) / {radius}D)").alias(a) for c, a in ((x, "cx"), (y, "cy"))]


def crowded_cells(right: DataFrame, weight: str, enough: int, radius: float) -> DataFrame:
    """(sheet_id, level, cx, cy) of the cells whose ``right`` points weigh ``enough``; finer levels only within full coarser ones."""
    at = lambda df, level: df.select("sheet_id", level.alias("level"), "rx", "ry", F.expr(weight).alias("w")).select("sheet_id", "level", *_square("rx", "ry", "level", radius), "w")
    count = lambda df: df.groupBy("sheet_id", "level", "cx", "cy").agg(F.sum("w").alias("w")).where(F.col("w") >= enough).drop("w")
    first = cut_lineage(count(at(right, F.lit(1))))
    inside = right.select("*", *_square("rx", "ry", "1", radius)).join(first.drop("level"), ["sheet_id", "cx", "cy"], "left_semi").drop("cx", "cy")
    return cut_lineage(first.unionByName(count(at(inside, F.explode(F.sequence(F.lit(2), F.lit(LEVELS)))))))


def nearest_candidates(left: DataFrame, right: DataFrame, radius: float, weight: str, enough: int) -> DataFrame:
    """The pairs of ``near_pairs`` that can be among the nearest of a left point, of which a weight of ``enough`` is wanted.

    A point in a cell that holds ``enough`` has all it wants within the cell's diagonal. So each left point searches
    that far from the finest such cell around it, and as far as ``radius`` where there is none: what it meets follows the
    density around it, not the crowd within the radius.
    """
    # the left points, which carry least, are the ones that stand in several cells
    turned = {"lx": "rx", "ly": "ry", "rx": "lx", "ry": "ly"}
    turn = lambda df: df.toDF(*[turned.get(c, c) for c in df.columns])
    plain = lambda points: turn(near_pairs(turn(right), turn(points), radius))
    full = crowded_cells(right, weight, enough, radius)
    if full.isEmpty():
        return plain(left)
    first = full.where("level = 1").drop("level")
    keys = [c for c in left.columns]
    crowd = left.select("*", *_square("lx", "ly", "1", radius)).join(first, ["sheet_id", "cx", "cy"], "left_semi").drop("cx", "cy")
    level = crowd.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS)))).select("*", *_square("lx", "ly", "level", radius))
    level = level.join(full, ["sheet_id", "level", "cx", "cy"]).groupBy(*keys).agg(F.max("level").alias("level"))
    sparse = left.select("*", *_square("lx", "ly", "1", radius)).join(first, ["sheet_id", "cx", "cy"], "left_anti").drop("cx", "cy")
    # a search from level 1 on reaches two cells of level 1 at most
    around = first.select("sheet_id", F.explode(F.expr("sequence(cx - 2, cx + 2)")).alias("cx"), "cy").select("sheet_id", "cx", F.explode(F.expr("sequence(cy - 2, cy + 2)")).alias("cy")).distinct()
    close = right.select("*", *_square("rx", "ry", "1", radius)).join(around, ["sheet_id", "cx", "cy"], "left_semi").drop("cx", "cy")
    reach, d2 = f"{radius}D * sqrt(2D) / pow(2D, level)", "(lx - rx) * (lx - rx) + (ly - ry) * (ly - ry)"
    span = lambda c: F.explode(F.expr(f"sequence(floor(({c} - {reach}) * pow(2D, level) / {radius}D), floor(({c} + {reach}) * pow(2D, level) / {radius}D))"))
    a = level.withColumn("cx", span("lx")).withColumn("cy", span("ly"))
    b = close.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS)))).select("*", *_square("rx", "ry", "level", radius))
    found = a.join(b, ["sheet_id", "level", "cx", "cy"]).where(f"{d2} <= {reach} * ({reach}) * (1D + 1e-9)").where(f"{d2} <= {radius * radius}D")
    found = found.withColumn("dist", F.expr(f"sqrt({d2})")).drop("level", "cx", "cy")
    return plain(sparse).unionByName(found)


def _cell(coordinate: str, level: str) -> str:
    plain = f"floor({coordinate} / ({BASE}D * pow({FACTOR}, {level})))"
    return f"CASE WHEN {level} = {TOP} THEN least(greatest({plain}, {-EDGE}L), {EDGE}L) ELSE {plain} END"


def _with_cells(df: DataFrame, p: str, first: int, last: int) -> DataFrame:
    """Boxes with the cells they cover at ``first`` to ``last`` levels above their own (``last`` None: to the top)."""
    span = f"greatest({p}xmax - {p}xmin, {p}ymax - {p}ymin)"
    level = "CASE " + " ".join(f"WHEN {span} <= {BASE * FACTOR ** i} THEN {i}" for i in range(TOP)) + f" ELSE {TOP} END"
    ys = f"transform(sequence({_cell(p + 'ymin', 'l')}, {_cell(p + 'ymax', 'l')}), cy -> named_struct('level', l, 'cx', cx, 'cy', cy))"
    cells = f"flatten(transform(sequence({_cell(p + 'xmin', 'l')}, {_cell(p + 'xmax', 'l')}), cx -> {ys}))"
    top = TOP if last is None else f"least({TOP}, {p}level + {last})"
    levels = f"filter(sequence(0, {TOP}), v -> v >= {p}level + {first} AND v <= {top})"
    own = df.withColumn(f"{p}level", F.expr(level))
    return own.select("*", F.expr(f"inline(flatten(transform({levels}, l -> {cells})))"))


def overlapping_boxes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ``left`` (sheet_id, lxmin..lymax, ...) and ``right`` (sheet_id, rxmin..rymax, ...) whose boxes touch.

    A box lives at the grid level whose cells are at least its size, so it covers at most four
    cells there however large it is.  A pair meets at the coarser level of the two only, in the
    one cell holding the lower left corner of the intersection, and so is found once: left boxes
    at their own level meet right ones of that level or a finer one, right boxes at theirs meet
    left ones of a finer level.  Small boxes are never compared in large cells.
    """
    return _met(left, right, (0, 0), (0, None)).unionByName(_met(left, right, (1, None), (0, 0)))


def _met(left: DataFrame, right: DataFrame, left_levels: tuple, right_levels: tuple) -> DataFrame:
    a, b = _with_cells(left, "l", *left_levels), _with_cells(right, "r", *right_levels)
    corner_x, corner_y = _cell("greatest(lxmin, rxmin)", "level"), _cell("greatest(lymin, rymin)", "level")
    return (a.join(b, ["sheet_id", "level", "cx", "cy"])
            .where("lxmin <= rxmax AND lxmax >= rxmin AND lymin <= rymax AND lymax >= rymin")
            .where(f"cx = {corner_x} AND cy = {corner_y}").drop("level", "cx", "cy", "llevel", "rlevel"))
