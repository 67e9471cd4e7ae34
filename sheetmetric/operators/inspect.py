"""Statistics of drawings: types, layers, blocks, dimensions, extents, overview."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetmetric.functions.numbers import half_up
from sheetmetric.functions.text import map_sql
from sheetmetric.model import fixed
from sheetmetric.operators import rules
from sheetmetric.operators.calibrate import lookup
from sheetmetric.operators.spatial import keep_first
from sheetmetric.functions.geometry import bbox_sql

USER_BLOCK = "NOT block_name RLIKE r'^[*_]'"


def entity_type_stats(entities: DataFrame) -> DataFrame:
    """Count and percentage per type."""
    counts = entities.groupBy("sheet_id", "dxf_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("sheet_id"))     # over the few counted types of a sheet
    return counts.withColumn("ratio", half_up(F.col("n") * 100.0 / total, 2))


def layer_summary(entities: DataFrame) -> DataFrame:
    return entities.groupBy("sheet_id", "layer").agg(F.count("*").alias("n"))


def layer_stats(layers: DataFrame, entities: DataFrame) -> DataFrame:
    """Declared layers with state, entity count and type counts; layers without entities stay."""
    by_type = entities.groupBy("sheet_id", F.col("layer").alias("name"), "dxf_type").agg(F.count("*").alias("n"))
    by_layer = by_type.groupBy("sheet_id", "name").agg(
        F.sum("n").alias("n"), F.expr("array_join(transform(array_sort(collect_list(struct(dxf_type, n))), t -> concat(t.dxf_type, '×', CAST(t.n AS STRING))), '；') AS types"))
    return layers.join(by_layer, ["sheet_id", "name"], "left").selectExpr(
        "sheet_id", "name", "color", "is_off", "is_frozen", "is_locked", "coalesce(n, 0L) AS entity_count", "coalesce(types, '') AS entity_types")


def user_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(USER_BLOCK)


def block_references(entities: DataFrame, keep: int) -> DataFrame:
    """References per block: number (``n``), layers with counts, attributed ones, keys of the first attributed one and the first ``keep`` attribute sets."""
    named = entities.where("dxf_type = 'INSERT'").withColumn("block_name", F.expr("coalesce(block_name, 'UNKNOWN')"))
    per_layer = named.groupBy("sheet_id", "block_name", "layer").agg(F.count("*").alias("n"), F.expr("count_if(size(attribs) > 0) AS with_attribs"))
    usage = per_layer.groupBy("sheet_id", "block_name").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_layers"), F.sum("with_attribs").alias("with_attribs"),
        F.expr("array_join(transform(array_sort(collect_list(struct(layer, n))), t -> concat(t.layer, '×', CAST(t.n AS STRING))), '；') AS layers"))
    # at most ``keep`` rows of a block
    samples = block_samples(named, keep).groupBy("sheet_id", "block_name").agg(
        F.expr("min_by(attribute_keys, rank) AS attribute_keys"),
        F.expr("array_join(transform(array_sort(collect_list(struct(rank, attributes))), r -> r.attributes), ' | ') AS attribute_samples"))
    return usage.join(samples, ["sheet_id", "block_name"], "left").na.fill("", ["attribute_keys", "attribute_samples"])


def block_usage(entities: DataFrame, blocks: DataFrame, keep: int = 5) -> DataFrame:
    """Insertions per block with the layers used, attributed references and the first of their attribute sets, and whether it is defined."""
    defined = blocks.select("sheet_id", "block_name", F.lit(True).alias("d")).distinct()
    usage = block_references(entities, keep).withColumnRenamed("n", "insert_count").drop("attribute_keys")
    return usage.join(defined, ["sheet_id", "block_name"], "left").withColumn("defined", F.expr("coalesce(d, false)")).drop("d")


def block_samples(entities: DataFrame, keep: int = 5) -> DataFrame:
    """First attribute sets of every block, and their keys."""
    rows = entities.where("dxf_type = 'INSERT' AND size(attribs) > 0")
    best = keep_first(rows.select("sheet_id", "block_name", "seq", "entity_id", "attribs"), ["sheet_id", "block_name"], ["seq", "entity_id"], keep)
    return best.selectExpr("sheet_id", "block_name", "rank", "array_join(transform(array_sort(map_entries(attribs)), e -> concat(e.key, '=', e.value)), '；') AS attributes",
                           "array_join(array_sort(map_keys(attribs)), '；') AS attribute_keys")


def dimension_kinds(dimensions: DataFrame) -> DataFrame:
    kind = lookup(fixed.DIMENSION_KINDS, "CAST(dimtype & 7 AS INT)")
    return dimensions.withColumn("kind", F.coalesce(kind, F.expr("concat('其他(', CAST(dimtype & 7 AS STRING), ')')")))


def dimension_stats(dimensions: DataFrame) -> DataFrame:
    return dimension_kinds(dimensions).groupBy("sheet_id", "kind").agg(F.count("*").alias("n"), F.max("measurement").alias("largest"))


def extents(entities: DataFrame) -> DataFrame:
    """Bounding box of all entities of a sheet."""
    boxes = entities.selectExpr("sheet_id", f"inline(array({bbox_sql(False)}))")
    box = boxes.groupBy("sheet_id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    return box.selectExpr("*", "xmax - xmin AS width", "ymax - ymin AS height")


def sheet_overview(sheets: DataFrame, entities: DataFrame, layers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Counts, extents and unit of every sheet; without a unit code the measurement system decides."""
    counts = entities.groupBy("sheet_id").agg(F.count("*").alias("entities"))
    n_layers = layers.groupBy("sheet_id").agg(F.count("*").alias("layers"))
    n_blocks = user_blocks(blocks).groupBy("sheet_id").agg(F.count("*").alias("block_definitions"))
    units = sheets.selectExpr("sheet_id", "CASE WHEN coalesce(insunits, 0) <> 0 THEN insunits WHEN measurement = 1 THEN 4 WHEN measurement = 0 THEN 1 ELSE 0 END AS units_code",
                              "CASE WHEN coalesce(insunits, 0) <> 0 THEN '' WHEN measurement = 1 THEN '未显式设置，按公制推断为毫米' WHEN measurement = 0 THEN '未显式设置，按英制推断为英寸' ELSE '图纸未设置单位，请人工确认' END AS units_note")
    named = units.withColumn("units_name", F.coalesce(lookup(fixed.UNIT_NAMES, "CAST(units_code AS INT)"), F.expr("concat('未知(', units_code, ')')")))
    box = extents(entities).select("sheet_id", "width", "height")
    joined = named.join(counts, "sheet_id", "left").join(n_layers, "sheet_id", "left").join(n_blocks, "sheet_id", "left").join(box, "sheet_id", "left")
    return joined.selectExpr("sheet_id", "CAST(units_code AS BIGINT) AS units_code", "units_name", "units_note", "coalesce(entities, 0L) AS entities", "coalesce(layers, 0L) AS layers",
                             "coalesce(block_definitions, 0L) AS block_definitions", "width", "height")


def empty_layers(ctx: rules.RuleContext) -> DataFrame:
    return rules.layer_entity_count_zero(ctx, {"exclude": ["0", "Defpoints"]}).selectExpr("sheet_id", "item AS name")


def unused_blocks(ctx: rules.RuleContext) -> DataFrame:
    return rules.unused_block_definition(ctx, {}).selectExpr("sheet_id", "item AS block_name")
