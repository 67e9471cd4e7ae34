"""Quantity take-off: component counts, lengths and areas by layer role."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmetric.functions.geometry import AREA, LENGTH
from sheetmetric.functions.numbers import exact_sum, half_up, out_of_range
from sheetmetric.functions.text import alternation, first_group_sql, norm_sql, raw
from sheetmetric.model import fixed

ORDER = ("seq", "entity_id")  # position in the drawing; the id breaks ties


def layer_role(layer: str = "layer", groups: list = fixed.ROLE_KEYWORDS) -> Column:
    return F.expr(first_group_sql(norm_sql(layer), groups, "'UNKNOWN'"))


def with_role(entities: DataFrame) -> DataFrame:
    return entities.withColumn("layer_role", layer_role())


def spec_from_attribs_sql(attribs: str = "attribs") -> str:
    """Distinct specification texts of the attributes, joined; '' when there is none."""
    looks_like = " OR ".join(f"trim(e.value) RLIKE {raw(p)}" for p in fixed.SPEC_PATTERNS)
    is_spec = f"trim(e.value) <> '' AND (upper(e.key) RLIKE {raw(alternation(fixed.SPEC_TAGS))} OR {looks_like})"
    return (f"coalesce(array_join(array_distinct(transform(filter(map_entries({attribs}), e -> {is_spec}), e -> trim(e.value))), ' / '), '')")


def spec_from_layer_sql(layer: str = "layer", block: str = "block_name") -> str:
    """First pattern found in layer and block name; '' when there is none."""
    text = f"concat_ws(' ', {layer}, coalesce({block}, ''))"
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {raw(p)}, 0), '')" for p in fixed.SPEC_PATTERNS) + ", '')"


def spec(attribs: str = "attribs") -> Column:
    return F.expr(f"coalesce(nullif({spec_from_attribs_sql(attribs)}, ''), nullif({spec_from_layer_sql()}, ''), {raw(fixed.NO_SPEC)})")


def block_detail(entities: DataFrame) -> DataFrame:
    """Counted block references by sheet, block, layer and specification (the finest grain)."""
    inserts = entities.where((F.col("dxf_type") == "INSERT") & ~layer_role().isin(fixed.EXCLUDED_ROLES))
    # the specification is worked out once per distinct attribute set, after counting
    by_attribs = inserts.groupBy("sheet_id", "block_name", "layer", F.map_entries("attribs").alias("a")).agg(
        F.count("*").alias("n"), F.min(F.struct(*ORDER)).alias("first"))
    return (by_attribs.withColumn("spec", spec("map_from_entries(a)"))
            .groupBy("sheet_id", "block_name", "layer", "spec").agg(F.sum("n").alias("n"), F.min("first").alias("first")))


def block_counts(detail: DataFrame) -> DataFrame:
    return detail.groupBy("sheet_id", "block_name").agg(F.sum("n").alias("quantity")).withColumn("unit", F.lit("个"))


def block_layers(detail: DataFrame) -> DataFrame:
    """The layer -> count map of every block, one row per entry."""
    return detail.groupBy("sheet_id", "block_name", "layer").agg(F.sum("n").alias("n"))


def block_specs(detail: DataFrame) -> DataFrame:
    """The specification -> count map of every block, one row per entry."""
    return detail.groupBy("sheet_id", "block_name", "spec").agg(F.sum("n").alias("n"))


def first_layer_of_block(detail: DataFrame, keys=("sheet_id", "block_name")) -> DataFrame:
    return detail.groupBy(*keys).agg(F.min_by("layer", "first").alias("first_layer"))


IS_LENGTH = "dxf_type IN ('LINE', 'LWPOLYLINE', 'ARC', 'CIRCLE', 'SPLINE')"
IS_AREA = "dxf_type IN ('LWPOLYLINE', 'POLYLINE', 'HATCH')"


def _raw_lengths(entities: DataFrame) -> DataFrame:
    return entities.where(IS_LENGTH).groupBy("sheet_id", "layer").agg(exact_sum(F.expr(LENGTH)).alias("raw"))


def _raw_areas(entities: DataFrame) -> DataFrame:
    return entities.where(IS_AREA).groupBy("sheet_id", "layer").agg(exact_sum(F.expr(AREA)).alias("raw"))


def _measured(raw: DataFrame) -> DataFrame:
    # the role is decided on the grouped rows: one test per sheet and layer, not per entity
    return raw.where((layer_role() == "MEASURABLE") & (F.col("raw") > 0))


def layer_length(entities: DataFrame, factors: DataFrame) -> DataFrame:
    """Length per measurable layer in true millimetres; ``factors``: sheet_id, factor_to_mm."""
    mm = F.col("raw").cast("double") * F.col("factor_to_mm")
    return _measured(_raw_lengths(entities)).join(factors, "sheet_id").select(
        "sheet_id", "layer", half_up(mm, 2).alias("total_length_mm"), half_up(mm / 1000, 2).alias("total_length_m"))


def layer_area(entities: DataFrame, factors: DataFrame) -> DataFrame:
    mm2 = F.col("raw").cast("double") * F.col("factor_to_mm") * F.col("factor_to_mm")
    return _measured(_raw_areas(entities)).join(factors, "sheet_id").select(
        "sheet_id", "layer", half_up(mm2, 2).alias("total_area_mm2"), half_up(mm2 / 1e6, 2).alias("total_area_m2"))


def layer_measures(entities: DataFrame, factors: DataFrame) -> DataFrame:
    """Length and area of every measurable layer in one pass, null where there is none."""
    sums = entities.where(f"{IS_LENGTH} OR {IS_AREA}").groupBy("sheet_id", "layer").agg(
        exact_sum(F.expr(f"CASE WHEN {IS_LENGTH} THEN {LENGTH} END")).alias("length"), exact_sum(F.expr(f"CASE WHEN {IS_AREA} THEN {AREA} END")).alias("area"))
    factor = F.col("factor_to_mm")
    return sums.where((layer_role() == "MEASURABLE") & F.expr("length > 0 OR area > 0")).join(factors, "sheet_id").select(
        "sheet_id", "layer", F.when(F.col("length") > 0, half_up(F.col("length").cast("double") * factor, 2)).alias("total_length_mm"),
        F.when(F.col("area") > 0, half_up(F.col("area").cast("double") * factor * factor, 2)).alias("total_area_mm2"))


def role_stats(entities: DataFrame) -> DataFrame:
    per_layer = entities.groupBy("sheet_id", "layer").agg(F.count("*").alias("n"))
    return (per_layer.withColumn("role", layer_role()).groupBy("sheet_id", "role")
            .agg(F.sum("n").alias("entity_count"), F.count("*").alias("layer_count")))


def measure_audit(entities: DataFrame, calibration: DataFrame) -> DataFrame:
    """What was not measured and why: excluded and unclassified layers, pending scale evidence, values that no exact sum holds."""
    skips = ", ".join(raw(r) for r in fixed.EXCLUDED_ROLES + ["UNKNOWN"])
    far = lambda types, what: out_of_range(F.expr(f"CASE WHEN {types} THEN {what} END"))
    per_layer = entities.groupBy("sheet_id", "layer").agg(
        F.count("*").alias("n"), far(IS_LENGTH, LENGTH).alias("far_lengths"), far(IS_AREA, AREA).alias("far_areas")).withColumn("role", layer_role())
    line = lambda kind, role, n: f"named_struct('kind', {kind}, 'role', {role}, 'item', layer, 'n', {n})"
    rows = ", ".join([line("CASE WHEN role = 'UNKNOWN' THEN 'unclassified' ELSE 'excluded' END", "role", f"CASE WHEN role IN ({skips}) THEN n END"),
                      line("'out_of_range'", "'LENGTH'", "nullif(far_lengths, 0)"), line("'out_of_range'", "'AREA'", "nullif(far_areas, 0)")])
    found = per_layer.selectExpr("sheet_id", f"inline(filter(array({rows}), r -> r.n IS NOT NULL))")
    unmeasured = (per_layer.where(F.col("role") == "UNKNOWN").groupBy("sheet_id").agg(F.sum("n").alias("n"))
                  .select("sheet_id", F.lit("pending").alias("kind"), F.lit("UNKNOWN").alias("role"),
                          F.lit("UNCLASSIFIED_LAYERS").alias("item"), "n"))
    scale = calibration.where("pending IS NOT NULL").select(
        "sheet_id", F.lit("pending").alias("kind"), F.lit("").alias("role"), F.col("pending").alias("item"), F.lit(1).cast("long").alias("n"))
    return found.unionByName(unmeasured).unionByName(scale)


def quantity_summary(blocks: DataFrame, lengths: DataFrame, areas: DataFrame, keys=("sheet_id",)) -> DataFrame:
    zero = F.lit(0).cast("long")
    rows = (blocks.select(*keys, F.lit(1).cast("long").alias("b"), "quantity", zero.alias("l"), zero.alias("a"))
            .unionByName(lengths.select(*keys, zero.alias("b"), zero.alias("quantity"), F.lit(1).cast("long").alias("l"), zero.alias("a")))
            .unionByName(areas.select(*keys, zero.alias("b"), zero.alias("quantity"), zero.alias("l"), F.lit(1).cast("long").alias("a"))))
    return rows.groupBy(*keys).agg(F.sum("b").alias("block_types"), F.sum("quantity").alias("block_total"),
                                   F.sum("l").alias("length_layers"), F.sum("a").alias("area_layers"))


def merge_blocks(detail: DataFrame) -> DataFrame:
    return detail.groupBy("block_name").agg(F.sum("n").alias("quantity"), F.countDistinct("layer").alias("n_layers"),
                                            F.countDistinct("spec").alias("n_specs"))


def merge_lengths(lengths: DataFrame) -> DataFrame:
    total = exact_sum(F.col("total_length_mm")).cast("double")
    return lengths.groupBy("layer").agg(half_up(total, 3).alias("total_length_mm"), half_up(total / 1000, 3).alias("total_length_m"))


def merge_areas(areas: DataFrame) -> DataFrame:
    total = exact_sum(F.col("total_area_mm2")).cast("double")
    return areas.groupBy("layer").agg(half_up(total, 3).alias("total_area_mm2"), half_up(total / 1e6, 3).alias("total_area_m2"))


def merge_quantities(detail: DataFrame, measures: DataFrame) -> DataFrame:
    """The corpus totals as one table: kind, name, item, quantity, unit.

    Kinds: block; block_layer and block_spec, the entries of a block's merged layer and specification maps (``item``
    is the layer or specification); length and area of a layer. Blocks are one grouping by sets.
    """
    sets = detail.groupingSets([["block_name"], ["block_name", "layer"], ["block_name", "spec"]], "block_name", "layer", "spec").agg(
        F.sum("n").cast("double").alias("quantity"), F.grouping_id().alias("g"))
    blocks = sets.selectExpr("CASE g WHEN 3 THEN 'block' WHEN 1 THEN 'block_layer' ELSE 'block_spec' END AS kind", "block_name AS name",
                             "CASE g WHEN 3 THEN '' WHEN 1 THEN layer ELSE spec END AS item", "quantity", "'个' AS unit")
    long = measures.selectExpr("layer AS name", "stack(2, 'length', total_length_mm, 'area', total_area_mm2) AS (kind, v)").where("v IS NOT NULL")
    total = exact_sum(F.col("v")).cast("double")
    layers = long.groupBy("kind", "name").agg(half_up(total / F.expr("CASE kind WHEN 'length' THEN 1e3D ELSE 1e6D END"), 3).alias("quantity"))
    return blocks.unionByName(layers.selectExpr("kind", "name", "'' AS item", "quantity", "CASE kind WHEN 'length' THEN 'm' ELSE 'm²' END AS unit"))


def spec_text(specs: str) -> Column:
    """'spec×count；...' of a map, without the unlabelled entry."""
    kept = f"array_sort(filter(map_entries({specs}), e -> e.key <> {raw(fixed.NO_SPEC)}))"
    return F.expr(f"array_join(transform({kept}, e -> concat_ws('×', e.key, CAST(e.value AS STRING))), '；')")


def block_texts(detail: DataFrame, keys=("sheet_id", "block_name")) -> DataFrame:
    """Specification and layer texts of every block; each list holds distinct values with their counts."""
    specs = detail.groupBy(*keys, "spec").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        spec_text("map_from_entries(collect_list(struct(spec, n)))").alias("spec_text"), F.sum("n").alias("quantity"))
    names = detail.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("layer")), "、").alias("layer_text"))
    return specs.join(names, list(keys))


def quantity_appendix(detail: DataFrame, lengths: DataFrame, areas: DataFrame) -> DataFrame:
    """Six-column appendix of the corpus: category, name, spec, quantity, unit, source."""
    blocks = block_texts(detail, ("block_name",)).select(
        F.lit("构件").alias("category"), F.col("block_name").alias("name"), F.col("spec_text").alias("spec"),
        F.col("quantity").cast("double").alias("quantity"), F.lit("个").alias("unit"), F.col("layer_text").alias("source"))
    length_rows = merge_lengths(lengths).select(
        F.lit("线长").alias("category"), F.col("layer").alias("name"), F.lit("").alias("spec"),
        F.col("total_length_m").alias("quantity"), F.lit("m").alias("unit"), F.col("layer").alias("source"))
    area_rows = merge_areas(areas).select(
        F.lit("面积").alias("category"), F.col("layer").alias("name"), F.lit("").alias("spec"),
        F.col("total_area_m2").alias("quantity"), F.lit("m²").alias("unit"), F.col("layer").alias("source"))
    return blocks.unionByName(length_rows).unionByName(area_rows)


def quantity_quick(entities: DataFrame) -> DataFrame:
    """The three totals per sheet in drawing units, without role filter or scale.

    Blocks carry their layers with counts, the attribute keys of their first attributed reference and the first 3
    attribute sets; references without a name count as UNKNOWN.
    """
    from sheetmetric.operators.inspect import block_references
    texts = ["layers", "attribute_keys", "attribute_samples"]
    blocks = block_references(entities, 3).select("sheet_id", F.lit("block").alias("kind"), F.col("block_name").alias("name"), F.col("n").cast("double").alias("total"), *texts)
    none = [F.lit("").alias(c) for c in texts]
    lengths = _raw_lengths(entities.where("dxf_type <> 'SPLINE'")).where("raw > 0").select(
        "sheet_id", F.lit("length").alias("kind"), F.col("layer").alias("name"), half_up(F.col("raw"), 2).alias("total"), *none)
    areas = _raw_areas(entities.where("dxf_type = 'LWPOLYLINE'")).where("raw > 0").select(
        "sheet_id", F.lit("area").alias("kind"), F.col("layer").alias("name"), half_up(F.col("raw"), 2).alias("total"), *none)
    return blocks.unionByName(lengths).unionByName(areas)
