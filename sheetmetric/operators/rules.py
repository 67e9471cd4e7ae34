"""Drawing rules as data-quality checks over entity, layer and block tables.

A rule operator is a function ``(RuleContext, parameters) -> DataFrame(sheet_id, item, weight)``;
a rule's count on a sheet is the sum of the weights.  Checks of one entity row alone are
declared as predicates instead, so that any number of them shares a single scan.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmetric.functions.geometry import distance_sql
from sheetmetric.functions.text import contains_any_sql, map_sql, nonblank_sql, raw
from sheetmetric.model import fixed
from sheetmetric.operators.calibrate import lookup
from sheetmetric.operators.spatial import bbox_clash, keep_first, pair_distance
from sheetmetric.session import stored

LINE_LENGTH = distance_sql("points[0].x", "points[0].y", "points[1].x", "points[1].y")
GEOMETRY_TYPE = ("CASE WHEN dxf_type IN ('LWPOLYLINE', 'POLYLINE') THEN CASE WHEN closed THEN 'POLYGON' ELSE 'POLYLINE' END "
                 "WHEN dxf_type IN ('TEXT', 'MTEXT') THEN 'TEXT' WHEN dxf_type = 'INSERT' THEN 'BLOCK_REF' WHEN dxf_type = 'DIMENSION' THEN 'POINT' ELSE dxf_type END")


@dataclass
class RuleContext:
    entities: DataFrame
    layers: DataFrame
    blocks: DataFrame
    sheets: DataFrame

    def used_layers(self) -> DataFrame:
        return self.entities.select("sheet_id", F.col("layer").alias("name")).distinct()

    def unit_scales(self) -> DataFrame:
        """Factor that brings a threshold in metres to the drawing unit."""
        unit = f"try_element_at({map_sql(fixed.INSUNITS)}, CAST(insunits AS INT))"
        return self.sheets.select("sheet_id", F.coalesce(lookup(fixed.RULE_UNIT_SCALE, f"coalesce({unit}, '')"), F.lit(1.0)).alias("scale"))


# row predicates: parameters -> SQL condition on one entity
PREDICATES: dict[str, Callable[[dict], str]] = {
    "zero_length_line": lambda p: f"dxf_type = 'LINE' AND {LINE_LENGTH} < {p['threshold']}D",
    "zero_radius_circle": lambda p: f"dxf_type = 'CIRCLE' AND coalesce(radius, 0D) < {p['threshold']}D",
    "entity_on_layer": lambda p: f"layer = {raw(p['layer'])}",
    "empty_text": lambda p: f"dxf_type IN ('TEXT', 'MTEXT') AND NOT ({nonblank_sql('label_text')})",
    "block_attr_empty": lambda p: "exists(map_values(attribs), v -> trim(coalesce(v, '')) = '')",
}
# measured values compared with threshold x unit scale: SQL value, lower bound
SCALED: dict[str, tuple[str, str]] = {
    "short_line": (f"CASE WHEN dxf_type = 'LINE' THEN {LINE_LENGTH} END", "1e-9D"),
    "text_height_lt": ("CASE WHEN dxf_type IN ('TEXT', 'MTEXT') THEN height END", "0D"),
}
LARGEST_SCALE = max(fixed.RULE_UNIT_SCALE.values())


def _item(df: DataFrame, item: str, weight: str = "1L") -> DataFrame:
    return df.selectExpr("sheet_id", f"{item} AS item", f"{weight} AS weight")


def scaled_hits(ctx: RuleContext, operator: str, params: dict) -> DataFrame:
    """Only rows that could pass under the largest unit scale meet the sheet table."""
    value, low = SCALED[operator]
    rows = ctx.entities.selectExpr("sheet_id", "entity_id", f"{value} AS v").where(f"v > {low} AND v < {params['threshold'] * LARGEST_SCALE}D")
    return _item(rows.join(ctx.unit_scales(), "sheet_id").where(f"v < {params['threshold']}D * scale"), "entity_id")


def duplicate_entity(ctx: RuleContext, params: dict) -> DataFrame:
    """Members of every group of equal geometry; a group counts once, through its first member.

    The radius is no part of the key. Only sheets on which a 64-bit hash of a key repeats are compared by the key itself;
    they are found first and stored, so that where they are few, neither points nor ids of the other sheets are shuffled.
    """
    key = "transform(points, p -> named_struct('x', round(p.x, 3), 'y', round(p.y, 3)))"
    rows = ctx.entities.where("dxf_type <> 'HATCH' AND size(points) > 0").selectExpr("sheet_id", "entity_id", f"{GEOMETRY_TYPE} AS g", f"{key} AS k")
    repeated = rows.groupBy("sheet_id", F.expr("xxhash64(g, k) AS h")).agg(F.count("*").alias("n")).where("n > 1").select("sheet_id").distinct()
    rows = rows.join(stored(repeated), "sheet_id", "left_semi")
    groups = rows.groupBy("sheet_id", "g", "k").agg(F.count("*").alias("n"), F.min("entity_id").alias("head")).where("n > 1")
    return _item(rows.join(groups, ["sheet_id", "g", "k"]), "entity_id", "CASE WHEN entity_id = head THEN 1L ELSE 0L END")


def _excluding(df: DataFrame, params: dict) -> DataFrame:
    names = params.get("exclude") or []
    return df.where(~F.col("name").isin(names)) if names else df


def layer_entity_count_zero(ctx: RuleContext, params: dict) -> DataFrame:
    return _item(_excluding(ctx.layers, params).join(ctx.used_layers(), ["sheet_id", "name"], "left_anti"), "name")


def layer_is_off(ctx: RuleContext, params: dict) -> DataFrame:
    return _item(_excluding(ctx.layers.where("is_off AND name <> 'Defpoints'"), params), "name")


def layer_is_frozen(ctx: RuleContext, params: dict) -> DataFrame:
    return _item(ctx.layers.where("is_frozen"), "name")


def layer_name_matches(ctx: RuleContext, params: dict) -> DataFrame:
    return _item(ctx.used_layers().where(f"name RLIKE {raw('^(?:' + params['pattern'] + ')')}"), "name")


def unused_block_definition(ctx: RuleContext, params: dict) -> DataFrame:
    used = ctx.entities.where("block_name IS NOT NULL AND block_name <> ''").select("sheet_id", "block_name").distinct()
    user = ctx.blocks.where("NOT block_name RLIKE r'^[*_]'")
    return _item(user.join(used, ["sheet_id", "block_name"], "left_anti"), "block_name")


def _with_partners(hits: DataFrame) -> DataFrame:
    """A entities count; their partners are listed beside them."""
    both = _item(hits, "entity_id").unionByName(_item(hits, "partner", "0L"))
    return both.groupBy("sheet_id", "item").agg(F.max("weight").alias("weight"))


def _counted(hits: DataFrame) -> DataFrame:
    """The A entities of ``_with_partners`` alone, each once: the same sum of weights without a partner to be found or shuffled."""
    return _item(hits.select("sheet_id", "entity_id").distinct(), "entity_id")


def entity_bbox_overlap(ctx: RuleContext, params: dict) -> DataFrame:
    return _with_partners(bbox_clash(ctx.entities, params["a"], params["b"], params.get("tolerance", 0.0)))


def layer_pair_distance_lt(ctx: RuleContext, params: dict) -> DataFrame:
    return _with_partners(pair_distance(ctx.entities, params["a"], params["b"], float(params["threshold"])))


def overlap_counted(ctx: RuleContext, params: dict) -> DataFrame:
    return _counted(bbox_clash(ctx.entities, params["a"], params["b"], params.get("tolerance", 0.0)))


def distance_counted(ctx: RuleContext, params: dict) -> DataFrame:
    return _counted(pair_distance(ctx.entities, params["a"], params["b"], float(params["threshold"])))


def discipline_mismatch(ctx: RuleContext, params: dict) -> DataFrame:
    """Forbidden words on sheets of the expected discipline; only rows with a hit meet the sheet table."""
    blob = "upper(concat_ws(' ', layer, coalesce(label_text, '')))"
    rows = ctx.entities.where(contains_any_sql(blob, [w.upper() for w in params["forbidden"]])).select("sheet_id", "entity_id")
    expected = ctx.sheets.where(F.col("discipline") == params["expected"]).select("sheet_id")
    return _item(rows.join(expected, "sheet_id", "left_semi"), "entity_id")


def _entity_total(ctx: RuleContext, condition: str, where: str | None = None) -> DataFrame:
    rows = ctx.entities.where(where) if where else ctx.entities
    return rows.groupBy("sheet_id").agg(F.count("*").alias("n")).where(condition).selectExpr("sheet_id", "CAST(NULL AS STRING) AS item", "n AS weight")


def entity_count_gt(ctx: RuleContext, params: dict) -> DataFrame:
    return _entity_total(ctx, f"n > {params['threshold']}")


def entity_count_lt(ctx: RuleContext, params: dict) -> DataFrame:
    """Sheets below the threshold; a sheet without any entity has count 0 and so passes."""
    return _entity_total(ctx, f"n < {params['threshold']}")


def entity_type_count_gt(ctx: RuleContext, params: dict) -> DataFrame:
    return _entity_total(ctx, f"n > {params['threshold']}", f"dxf_type = {raw(params['dxf_type'])}")


OPERATORS: dict[str, Callable[[RuleContext, dict], DataFrame]] = {
    f.__name__: f for f in (duplicate_entity, layer_entity_count_zero, layer_is_off, layer_is_frozen, layer_name_matches, unused_block_definition,
                            entity_bbox_overlap, layer_pair_distance_lt, discipline_mismatch, entity_count_gt, entity_count_lt, entity_type_count_gt)}
# what gives the same sums of weights for less where no item is listed
COUNTED = {entity_bbox_overlap: overlap_counted, layer_pair_distance_lt: distance_counted}


def register_rule(name: str, fn: Callable[[RuleContext, dict], DataFrame]) -> None:
    """Adds a rule operator of one's own."""
    OPERATORS[name] = fn


def operator_hits(ctx: RuleContext, operator: str, params: dict) -> DataFrame:
    """Hits of one operator: sheet_id, item, weight."""
    if operator in PREDICATES:
        return _item(ctx.entities.where(PREDICATES[operator](params)), "entity_id")
    if operator in SCALED:
        return scaled_hits(ctx, operator, params)
    return OPERATORS[operator](ctx, params)


def operator_counts(ctx: RuleContext, operator: str, params: dict) -> DataFrame:
    """Rows whose weights sum up per sheet as those of ``operator_hits`` do."""
    counted = COUNTED.get(OPERATORS.get(operator)) if operator not in PREDICATES and operator not in SCALED else None
    return counted(ctx, params) if counted else operator_hits(ctx, operator, params)


def active_rules(rules=fixed.RULES, cross_discipline: bool = False) -> list:
    """Cross-discipline rules run only on request (their flag is then ignored), the others by their flag."""
    return [r for r in rules if (cross_discipline if r[2] == "cross_discipline" else r[4])]


def known(operator: str) -> bool:
    return operator in PREDICATES or operator in SCALED or operator in OPERATORS


def run_rules(ctx: RuleContext, rules, hits=operator_hits) -> DataFrame:
    """All hits of the rules: sheet_id, rule_id, item, weight.  Rules of unknown operators are skipped."""
    parts = []
    local = [r for r in rules if r[5] in PREDICATES]
    if local:
        flags = ", ".join(f"CASE WHEN {PREDICATES[r[5]](r[6])} THEN '{r[0]}' END" for r in local)
        parts.append(ctx.entities.selectExpr("sheet_id", f"explode(array_compact(array({flags}))) AS rule_id", "entity_id AS item", "1L AS weight"))
    shared: dict[str, list] = {}      # rules with one operator and equal parameters are evaluated together
    for rule in rules:
        if rule[5] not in PREDICATES and known(rule[5]):
            shared.setdefault(f"{rule[5]} {rule[6]}", []).append(rule)
    for group in shared.values():
        ids = F.explode(F.array(*[F.lit(r[0]) for r in group]))
        parts.append(hits(ctx, group[0][5], group[0][6]).withColumn("rule_id", ids))
    out = parts[0].select("sheet_id", "rule_id", "item", "weight")
    for part in parts[1:]:
        out = out.unionByName(part.select("sheet_id", "rule_id", "item", "weight"))
    return out


def _severity(rules) -> Column:
    return lookup({r[0]: r[3] for r in rules}, "rule_id")


def rule_counts(ctx: RuleContext, rules) -> DataFrame:
    """Weights of ``run_rules`` (sheet_id, rule_id, weight) without its items, for results that list none."""
    return run_rules(ctx, rules, operator_counts).drop("item")


def rule_results(ctx: RuleContext, rules, hits: DataFrame) -> DataFrame:
    """Failed rules per sheet with count and rendered message, from hits or counts."""
    scaled = {r[0]: r[6]["threshold"] for r in rules if r[5] in SCALED}
    plain = {r[0]: str(r[6]["threshold"]) for r in rules if r[5] == "layer_pair_distance_lt"}
    counts = hits.groupBy("sheet_id", "rule_id").agg(F.sum("weight").alias("count")).where("count > 0")
    joined = counts.join(ctx.unit_scales(), "sheet_id")
    template = f"try_element_at({map_sql({r[0]: r[7] for r in rules})}, rule_id)"
    threshold = f"CAST(try_element_at({map_sql(scaled or {'': 0.0})}, rule_id) * scale AS STRING)"
    given = f"try_element_at({map_sql(plain or {'': ''})}, rule_id)"
    message = f"replace(replace({template}, '{{count}}', CAST(count AS STRING)), '{{threshold}}', coalesce({threshold}, {given}, ''))"
    return joined.select("sheet_id", "rule_id", _severity(rules).alias("severity"), "count", F.expr(message).alias("message"))


def rule_summary(ctx: RuleContext, rules, results: DataFrame) -> DataFrame:
    """Errors, warnings, infos, executed and passed rules per sheet."""
    executed, runnable = len(rules), sum(1 for r in rules if known(r[5]))
    per_sheet = results.groupBy("sheet_id").agg(*[F.expr(f"count_if(severity = '{s}') AS {s}s") for s in ("error", "warning", "info")], F.count("*").alias("failed"))
    zero = lambda c: f"coalesce({c}, 0L) AS total_{c}"
    return ctx.sheets.select("sheet_id").join(per_sheet, "sheet_id", "left").selectExpr(
        "sheet_id", zero("errors"), zero("warnings"), zero("infos"), f"{executed}L AS rules_executed", f"{runnable}L - coalesce(failed, 0L) AS rules_passed")


def entity_errors(hits: DataFrame, results: DataFrame) -> DataFrame:
    """Violations appended to every item hit; at most one entry per rule."""
    joined = hits.where("item IS NOT NULL").select("sheet_id", "rule_id", "item").join(results, ["sheet_id", "rule_id"])
    return joined.groupBy("sheet_id", "item").agg(
        F.count("*").alias("n_errors"), F.expr("array_join(array_sort(collect_set(concat(rule_id, ':', severity, ':', message))), '；') AS errors"))


def hit_samples(hits: DataFrame, keep: int = 50) -> DataFrame:
    return keep_first(hits.where("item IS NOT NULL"), ["sheet_id", "rule_id"], ["item"], keep).drop("weight")


def quality_check(ctx: RuleContext) -> DataFrame:
    """Leveled issues of a sheet from a fixed set of checks (small texts under 0.5, not unit-scaled)."""
    e = ctx.entities
    row_checks = [("warn", "零长度直线", PREDICATES["zero_length_line"]({"threshold": 1e-6})),
                  ("warn", "零半径圆", PREDICATES["zero_radius_circle"]({"threshold": 1e-6})),
                  ("info", "文字高度过小", "dxf_type IN ('TEXT', 'MTEXT') AND height > 0 AND height < 0.5D"),
                  ("info", "实体位于 0 图层", "layer = '0'"), ("warn", "图块属性为空", PREDICATES["block_attr_empty"]({}))]
    flags = ", ".join(f"CASE WHEN {cond} THEN named_struct('level', '{lv}', 'category', '{c}') END" for lv, c, cond in row_checks)
    rows = e.selectExpr("sheet_id", f"inline(array_compact(array({flags})))")
    layer_checks = [("info", "未使用图层", layer_entity_count_zero(ctx, {"exclude": ["0", "Defpoints"]})),
                    ("info", "图层被关闭", layer_is_off(ctx, {})), ("info", "图层被冻结", layer_is_frozen(ctx, {}))]
    for level, category, hits in layer_checks:
        rows = rows.unionByName(hits.select("sheet_id", F.lit(level).alias("level"), F.lit(category).alias("category")))
    return rows.groupBy("sheet_id", "level", "category").agg(F.count("*").alias("count"))
