"""Queries of the drawing rules."""
from pyspark.sql import functions as F

from sheetmetric.model import adapter, fixed
from sheetmetric.operators import rules as r
from sheetmetric.queries import sql
from sheetmetric.queries.spatial import clash_sql, distance_sql
from sheetmetric.session import stored

# the two rule sets together, cross-discipline rules included
ALL_RULES = r.active_rules(fixed.RULES + fixed.FIRE_RULES, cross_discipline=True)
BY_OPERATOR = {rule[5]: rule for rule in reversed(ALL_RULES)}


def context(spark, sf):
    return r.RuleContext(adapter.entities(spark, sf), adapter.layers(spark, sf), adapter.block_definitions(spark, sf), adapter.sheets(spark, sf))


def _operator(name, params=None):
    def run(spark, sf):
        return r.operator_hits(context(spark, sf), name, params or BY_OPERATOR[name][6])
    return run


def _results(spark, sf):
    ctx = context(spark, sf)
    return ctx, r.rule_results(ctx, ALL_RULES, r.rule_counts(ctx, ALL_RULES))


def _summary(spark, sf):
    ctx, results = _results(spark, sf)
    return r.rule_summary(ctx, ALL_RULES, results)


def _errors(spark, sf):
    ctx = context(spark, sf)
    hits = stored(r.run_rules(ctx, ALL_RULES))
    return r.entity_errors(hits, r.rule_results(ctx, ALL_RULES, hits))


def _samples(spark, sf):
    hits = r.run_rules(context(spark, sf), ALL_RULES)
    return r.hit_samples(hits, 50).withColumn("rank", F.col("rank").cast("long"))


MISMATCH = {"expected": "ELEC", "forbidden": ["DUCT", "图例"]}
DISTANCE = {"a": ["PIPE"], "b": ["BEAM", "COLUMN"], "threshold": 1500}
OVERLAP = {"a": ["风管", "DUCT", "给水", "排水", "PIPE"], "b": ["梁", "BEAM", "柱", "COLUMN"], "tolerance": 0.0}
PATTERN = {"pattern": "^(门窗表|MYSTERY.*)$"}
QUERIES = {
    "rule_zero_length_line": _operator("zero_length_line"), "rule_zero_radius_circle": _operator("zero_radius_circle"),
    "rule_short_line": _operator("short_line", {"threshold": 0.35}), "rule_duplicate_entity": _operator("duplicate_entity"),
    "rule_layer_entity_count_zero": _operator("layer_entity_count_zero"), "rule_entity_on_layer": _operator("entity_on_layer"),
    "rule_layer_is_off": _operator("layer_is_off"), "rule_layer_is_frozen": _operator("layer_is_frozen"),
    "rule_layer_name_matches": _operator("layer_name_matches", PATTERN), "rule_text_height_lt": _operator("text_height_lt"),
    "rule_empty_text": _operator("empty_text"), "rule_block_attr_empty": _operator("block_attr_empty"),
    "rule_unused_block_definition": _operator("unused_block_definition"), "rule_entity_bbox_overlap": _operator("entity_bbox_overlap", OVERLAP),
    "rule_discipline_mismatch": _operator("discipline_mismatch", MISMATCH), "rule_layer_pair_distance_lt": _operator("layer_pair_distance_lt", DISTANCE),
    "rule_entity_count_gt": _operator("entity_count_gt", {"threshold": 45}), "rule_entity_count_lt": _operator("entity_count_lt", {"threshold": 35}),
    "rule_entity_type_count_gt": _operator("entity_type_count_gt", {"threshold": 9, "dxf_type": "INSERT"}),
    "rule_results": lambda s, d: _results(s, d)[1],
    "rule_summary": _summary, "entity_errors": _errors, "hit_samples": _samples,
    "quality_check": lambda s, d: r.quality_check(context(s, d)),
}

SCALE = ("scale AS (SELECT sheet_id, CAST(CASE insunits WHEN 1 THEN 39.37 WHEN 2 THEN 3.28 WHEN 4 THEN 1000.0 WHEN 5 THEN 100.0 ELSE 1.0 END AS DOUBLE) AS k FROM sheets)")
GEOKEY = "sheet_id, CASE WHEN dxf_type = 'LWPOLYLINE' THEN CASE WHEN closed THEN 'PG' ELSE 'PL' END ELSE dxf_type END, x0, y0, CASE WHEN dxf_type IN ('LINE', 'LWPOLYLINE') THEN w END, CASE WHEN dxf_type = 'LWPOLYLINE' THEN h END"
DUP = (f"(SELECT sheet_id, entity_id AS item, CASE WHEN entity_id = min(entity_id) OVER (PARTITION BY {GEOKEY}) THEN 1::BIGINT ELSE 0::BIGINT END AS weight, count(*) OVER (PARTITION BY {GEOKEY}) AS n FROM ent WHERE dxf_type <> 'HATCH')")


def rows(item, source, weight="1::BIGINT"):
    return f"SELECT sheet_id, {item} AS item, {weight} AS weight FROM {source}"


def partnered(hits):
    return f"SELECT sheet_id, item, max(weight) AS weight FROM (SELECT sheet_id, entity_id AS item, 1::BIGINT AS weight FROM ({hits}) UNION ALL SELECT sheet_id, partner, 0::BIGINT FROM ({hits})) GROUP BY ALL"


def short(threshold):
    return rows("entity_id", f"ent JOIN scale USING (sheet_id) WHERE dxf_type = 'LINE' AND w > 1e-9 AND w < {threshold} * k")


def height(threshold):
    return rows("entity_id", f"ent JOIN scale USING (sheet_id) WHERE dxf_type = 'TEXT' AND text_height > 0 AND text_height < {threshold} * k")


def mismatch(expected, forbidden):
    return rows("entity_id", f"ent JOIN sheets USING (sheet_id) WHERE discipline = '{expected}' AND {sql.any_of(chr(117) + 'pper(layer || ' + sql.lit(' ') + ' || coalesce(label_text, ' + sql.lit('') + '))', forbidden)}")


SQL = {
    "zero_length_line": rows("entity_id", "ent WHERE dxf_type = 'LINE' AND w = 0"),
    "zero_radius_circle": rows("entity_id", "ent WHERE dxf_type = 'CIRCLE' AND r = 0"),
    "short_line": short(0.1), "duplicate_entity": rows("item", f"{DUP} WHERE n > 1", "weight"),
    "layer_entity_count_zero": rows("name", "layers WHERE name NOT IN ('0', 'Defpoints') AND (sheet_id, name) NOT IN (SELECT sheet_id, layer FROM ent)"),
    "entity_on_layer": rows("entity_id", "ent WHERE layer = '0'"), "layer_is_off": rows("name", "layers WHERE is_off AND name <> 'Defpoints'"),
    "layer_is_frozen": rows("name", "layers WHERE is_frozen"),
    "text_height_lt": height(0.5), "empty_text": rows("entity_id", "ent WHERE dxf_type = 'TEXT' AND trim(label_text) = ''"),
    "block_attr_empty": rows("entity_id", "ent WHERE attr_spec = ''"),
    "unused_block_definition": rows("block_name", "blockdefs WHERE left(block_name, 1) NOT IN ('*', '_') AND (sheet_id, block_name) NOT IN (SELECT sheet_id, block_name FROM ent WHERE block_name IS NOT NULL)"),
    "entity_bbox_overlap": partnered(clash_sql(OVERLAP["a"], OVERLAP["b"])),
    "layer_pair_distance_lt": partnered(distance_sql(DISTANCE["a"], DISTANCE["b"], 1500)),
    "entity_count_gt": "SELECT sheet_id, CAST(NULL AS VARCHAR) AS item, count(*) AS weight FROM ent GROUP BY sheet_id HAVING count(*) > 45",
    "entity_count_lt": "SELECT sheet_id, CAST(NULL AS VARCHAR) AS item, count(*) AS weight FROM ent GROUP BY sheet_id HAVING count(*) < 35",
    "entity_type_count_gt": "SELECT sheet_id, CAST(NULL AS VARCHAR) AS item, count(*) AS weight FROM ent WHERE dxf_type = 'INSERT' GROUP BY sheet_id HAVING count(*) > 9",
    "layer_name_matches": rows("layer", "(SELECT DISTINCT sheet_id, layer FROM ent WHERE regexp_full_match(layer, '门窗表|MYSTERY.*'))"),
    "discipline_mismatch": mismatch("ELEC", ["DUCT", "图例"]),
}
CTES = [sql.ENT, sql.SHEETS, sql.LAYERS, sql.BLOCKDEFS, sql.BOXES, SCALE]


def rule_sql(rule):
    rid, op, p = rule[0], rule[5], rule[6]
    if op == "text_height_lt":
        body = height(p["threshold"])
    elif op == "discipline_mismatch":
        body = mismatch(p["expected"], p["forbidden"])
    elif op == "entity_bbox_overlap":
        body = partnered(clash_sql(p["a"], p["b"]))
    elif op == "layer_pair_distance_lt":
        body = partnered(distance_sql(p["a"], p["b"], p["threshold"]))
    elif op == "layer_name_matches":
        body = rows("layer", "(SELECT DISTINCT sheet_id, layer FROM ent WHERE regexp_matches(layer, '^(图层\\d+|Layer\\d+|新建图层|New Layer)$'))")
    else:
        body = SQL[op]
    return f"SELECT sheet_id, '{rid}' AS rule_id, item, weight FROM ({body})"


HITS = "hits AS MATERIALIZED (" + " UNION ALL ".join(rule_sql(x) for x in ALL_RULES) + ")"
RULEDEF = sql.values("ruledef", "rule_id, severity, message, thr", [(x[0], x[3], x[7], x[6].get("threshold") if x[5] in ("short_line", "text_height_lt") else None) for x in ALL_RULES])
RESULTS = ("results AS (SELECT sheet_id, rule_id, severity, n AS \"count\", replace(replace(message, '{count}', CAST(n AS VARCHAR)), '{threshold}', coalesce(CAST(CAST(thr * k AS DOUBLE) AS VARCHAR), CASE WHEN rule_id = 'FIRE001' THEN '200' ELSE '' END)) AS message "
           "FROM (SELECT sheet_id, rule_id, CAST(sum(weight) AS BIGINT) AS n FROM hits GROUP BY ALL) JOIN ruledef USING (rule_id) JOIN scale USING (sheet_id) WHERE n > 0)")
ALL = [*CTES, HITS, RULEDEF, RESULTS]
ORACLES = {f"rule_{k}": sql.query(v, *CTES) for k, v in SQL.items()}
ORACLES["rule_short_line"] = sql.query(short(0.35), *CTES)
ORACLES |= {
    "rule_results": sql.query("SELECT * FROM results", *ALL),
    "rule_summary": sql.query("SELECT c_custkey AS sheet_id, count(*) FILTER (WHERE severity = 'error') AS total_errors, count(*) FILTER (WHERE severity = 'warning') AS total_warnings, count(*) FILTER (WHERE severity = 'info') AS total_infos, "
                              f"{len(ALL_RULES)}::BIGINT AS rules_executed, {len(ALL_RULES)} - count(rule_id) AS rules_passed FROM customer LEFT JOIN results ON c_custkey = sheet_id GROUP BY c_custkey", *ALL),
    "entity_errors": sql.query("SELECT sheet_id, item, count(*) AS n_errors, string_agg(rule_id || ':' || severity || ':' || message, '；' ORDER BY rule_id || ':' || severity || ':' || message) AS errors FROM hits JOIN results USING (sheet_id, rule_id) WHERE item IS NOT NULL GROUP BY sheet_id, item", *ALL),
    "hit_samples": sql.query("SELECT sheet_id, rule_id, item, row_number() OVER (PARTITION BY sheet_id, rule_id ORDER BY item) AS rank FROM hits WHERE item IS NOT NULL QUALIFY rank <= 50", *ALL),
    "quality_check": sql.query('SELECT sheet_id, level, category, count(*) AS "count" FROM (' + " UNION ALL ".join(
        f"SELECT sheet_id, '{lv}' AS level, '{c}' AS category FROM ({q})" for lv, c, q in (
            ("warn", "零长度直线", SQL["zero_length_line"]), ("warn", "零半径圆", SQL["zero_radius_circle"]), ("info", "实体位于 0 图层", SQL["entity_on_layer"]),
            ("info", "文字高度过小", "SELECT sheet_id FROM ent WHERE dxf_type = 'TEXT' AND text_height > 0 AND text_height < 0.5"),
            ("warn", "图块属性为空", SQL["block_attr_empty"]), ("info", "未使用图层", SQL["layer_entity_count_zero"]), ("info", "图层被关闭", SQL["layer_is_off"]), ("info", "图层被冻结", SQL["layer_is_frozen"]))) + ") GROUP BY ALL", *CTES),
}
