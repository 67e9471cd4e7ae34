"""Construction divisions: where each quantity belongs, and the label chain of every node."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmetric.functions.text import contains_any_sql, let_sql, raw
from sheetmetric.model import fixed
from sheetmetric.operators import measure
from sheetmetric.operators.calibrate import lookup
from sheetmetric.operators.classify import layer_discipline

NODE = ("division", "sub_division", "item")


def wbs_map(name: str = "name", discipline: str = "discipline") -> Column:
    """Struct(division, sub_division, item) of a named quantity.

    Candidate divisions follow the discipline (all of them without one); the first keyword
    found decides.  The sub-division is always the division's first.
    """
    by_name = {d: (sub, items) for d, sub, items in fixed.DIVISIONS}

    def chain(candidates):
        node = "named_struct('division', {}, 'sub_division', {}, 'item', {})"
        whens = [f"WHEN {contains_any_sql('q', words)} THEN {node.format(raw(d), raw(by_name[d][0]), raw(item))}"
                 for d in candidates for item, words in by_name[d][1]]
        first = candidates[0]
        return f"CASE {' '.join(whens)} ELSE {node.format(raw(first), raw(by_name[first][0]), raw(fixed.NO_ITEM))} END"

    arms = " ".join(f"WHEN {raw(d)} THEN {chain(c)}" for d, c in fixed.DISCIPLINE_DIVISIONS.items())
    return F.expr(let_sql(name, "q", f"CASE coalesce({discipline}, '') {arms} ELSE {chain([d for d, _, _ in fixed.DIVISIONS])} END"))


def length_discipline(layer: str = "layer") -> Column:
    u = f"upper({layer})"
    return F.expr(f"CASE WHEN {contains_any_sql(u, ['PIPE', 'WATER', 'DRAIN'])} THEN '给排水' WHEN {contains_any_sql(u, ['DUCT', 'HVAC'])} THEN '暖通' "
                  f"WHEN {contains_any_sql(u, ['CABLE', 'WIRE', 'ELEC'])} THEN '电气' ELSE '其他' END")


def wbs_entries(detail: DataFrame, lengths: DataFrame, areas: DataFrame, keys=()) -> DataFrame:
    """Quantity entries with their division node; ``keys=('sheet_id',)`` keeps sheets apart."""
    keys = list(keys)
    blocks = (detail.groupBy(*keys, "block_name").agg(F.sum("n").cast("double").alias("quantity"), F.min_by("layer", "first").alias("layer"))
              .select(*keys, F.lit(0).alias("kind"), F.col("block_name").alias("name"), F.col("block_name").alias("label"), "quantity",
                      F.lit("个").alias("unit"), "layer", layer_discipline("layer").alias("discipline")))
    if keys:
        length_rows, area_rows = lengths, areas
    else:
        length_rows, area_rows = measure.merge_lengths(lengths), measure.merge_areas(areas)
    length_rows = length_rows.select(*keys, F.lit(1).alias("kind"), F.col("layer").alias("name"), F.expr("concat('管线(', layer, ')') AS label"),
                                     F.col("total_length_m").alias("quantity"), F.lit("m").alias("unit"), "layer", length_discipline().alias("discipline"))
    area_rows = area_rows.select(*keys, F.lit(2).alias("kind"), F.col("layer").alias("name"), F.expr("concat('面积(', layer, ')') AS label"),
                                 F.col("total_area_m2").alias("quantity"), F.lit("m²").alias("unit"), "layer", F.lit("建筑").alias("discipline"))
    rows = blocks.unionByName(length_rows).unionByName(area_rows).withColumn("node", wbs_map())
    return rows.select(*keys, "kind", "label", "quantity", "unit", "layer", "discipline", "node.*")


def wbs_tree(entries: DataFrame, keys=()) -> DataFrame:
    return entries.groupBy(*keys, *NODE).agg(F.count("*").alias("entries"))


def label_chains(entries: DataFrame, keys=(), evidence_layers: int | None = None) -> DataFrame:
    """Discipline, unit work, division and item of every node, with confidence and evidence.

    The discipline is that of most entries' layers; ties go to the earliest entry. The evidence names all layers,
    or the first ``evidence_layers``.
    """
    keys = [*keys, *NODE]
    per_layer = (entries.groupBy(*keys, "layer").agg(F.count("*").alias("n"), F.min(F.struct("kind", "label")).alias("first"))
                 .withColumn("name", layer_discipline("layer")))
    # the evidence names the layers of a node, so they are gathered once for all that is asked of them
    nodes = per_layer.groupBy(*keys).agg(F.sum("n").alias("entries"), F.expr("array_sort(collect_list(struct(layer, n, name, first)))").alias("found"))
    of = "filter(found, e -> e.name = d)"
    vote = f"struct(-aggregate({of}, 0L, (s, e) -> s + e.n) AS n, array_min(transform({of}, e -> e.first)) AS first, d AS name)"
    named = "array_distinct(transform(filter(found, e -> e.name <> ''), e -> e.name))"
    shown = "found" if evidence_layers is None else f"slice(found, 1, {int(evidence_layers)})"
    joined = nodes.withColumns({
        "discipline_name": F.expr(f"coalesce(array_min(transform({named}, d -> {vote})).name, '未识别')"),
        "layers": F.expr(f"array_join(transform({shown}, e -> concat('LAYER:', e.layer, ':', CAST(e.n AS STRING), ' 项')), '；')")})
    reg = fixed.DISCIPLINE_REGISTRY
    hi, lo = fixed.CONFIDENCE_HIGH, fixed.CONFIDENCE_LOW
    chained = joined.withColumns({
        "discipline_code": F.coalesce(lookup({r[1]: r[0] for r in reg}, "discipline_name"), F.lit("UNKNOWN")),
        "unit_work": F.coalesce(lookup({r[1]: r[2] for r in reg}, "discipline_name"), F.lit("未分类工程")),
        "acceptance_standard": F.coalesce(lookup({r[1]: r[3] for r in reg}, "discipline_name"), F.lit("GB50300")),
        "discipline_confidence": F.expr(f"CASE WHEN discipline_name <> '未识别' THEN {hi}D ELSE {lo}D END")})
    item_confidence = f"CASE WHEN item <> '{fixed.NO_ITEM}' THEN discipline_confidence ELSE {lo}D END"
    return chained.selectExpr(*keys, "entries", "discipline_code", "discipline_name", "unit_work", "acceptance_standard", "discipline_confidence",
                              f"{item_confidence} AS item_confidence", f"least(discipline_confidence, {item_confidence}) AS confidence",
                              "concat('RULE:GB50300#', division, '/', sub_division, '/', item, '；', layers) AS evidence")


def anchors_sample(entries: DataFrame, keep: int = 10, keys=()) -> DataFrame:
    """First entries of every node, as anchors of its label chain."""
    w = Window.partitionBy(*keys, *NODE).orderBy("kind", "label")
    return entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select(*keys, *NODE, "rank", "label", "unit", "quantity")


def discipline_quantities(detail: DataFrame, lengths: DataFrame, areas: DataFrame) -> DataFrame:
    """Component types and totals per discipline, beside the set's measured layer counts."""
    blocks = detail.groupBy("block_name").agg(F.sum("n").alias("n"), F.min_by("layer", "first").alias("layer"))
    per_disc = (blocks.withColumn("discipline", F.coalesce(F.nullif(layer_discipline("layer"), F.lit("")), F.lit("其他")))
                .groupBy("discipline").agg(F.count("*").alias("block_types"), F.sum("n").alias("block_total")))
    count = lambda df: df.agg(F.countDistinct("layer").alias("n")).scalar()
    return per_disc.select("discipline", "block_types", "block_total", count(lengths).alias("length_layers"), count(areas).alias("area_layers"))
