"""Queries of the inspection operators."""
from pyspark.sql import functions as F

from sheetmetric.model import adapter, fixed
from sheetmetric.operators import inspect as i
from sheetmetric.queries import sql
from sheetmetric.queries.rules import SQL as RULE_SQL
from sheetmetric.queries.rules import context

E = adapter.entities
QUERIES = {
    "entity_id": lambda s, d: E(s, d).selectExpr("sheet_id", "seq", "entity_id"),
    "entity_type_stats": lambda s, d: i.entity_type_stats(E(s, d)),
    "layer_summary": lambda s, d: i.layer_summary(E(s, d)),
    "layer_stats": lambda s, d: i.layer_stats(adapter.layers(s, d), E(s, d)),
    "user_blocks": lambda s, d: i.user_blocks(adapter.block_definitions(s, d)).select("sheet_id", "block_name"),
    "block_usage": lambda s, d: i.block_usage(E(s, d), adapter.block_definitions(s, d)),
    "block_samples": lambda s, d: i.block_samples(E(s, d)).withColumn("rank", F.col("rank").cast("long")).drop("attribute_keys"),
    "dimension_kind": lambda s, d: i.dimension_kinds(adapter.dimensions(s, d)).groupBy("dimtype", "kind").agg(F.count("*").alias("n")),
    "dimension_stats": lambda s, d: i.dimension_stats(adapter.dimensions(s, d)),
    "extents": lambda s, d: i.extents(E(s, d)),
    "sheet_overview": lambda s, d: i.sheet_overview(adapter.sheets(s, d), E(s, d), adapter.layers(s, d), adapter.block_definitions(s, d)),
    "empty_layers": lambda s, d: i.empty_layers(context(s, d)),
    "unused_blocks": lambda s, d: i.unused_blocks(context(s, d)),
}

EXT = ("ext AS (SELECT sheet_id, CAST(min(xmin) AS DOUBLE) AS xmin, CAST(min(ymin) AS DOUBLE) AS ymin, CAST(max(xmax) AS DOUBLE) AS xmax, CAST(max(ymax) AS DOUBLE) AS ymax, "
       "CAST(max(xmax) - min(xmin) AS DOUBLE) AS width, CAST(max(ymax) - min(ymin) AS DOUBLE) AS height FROM boxes GROUP BY sheet_id)")
DIM = "dims AS (SELECT CAST(o_custkey AS BIGINT) AS sheet_id, CAST(l_quantity AS BIGINT) * 8 + l_suppkey % 8 AS dimtype, l_quantity AS measurement FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
KIND = "coalesce(CASE dimtype % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fixed.DIMENSION_KINDS.items()) + " END, '其他(' || dimtype % 8 || ')')"
CODE = "CASE WHEN insunits <> 0 THEN insunits WHEN measurement = 1 THEN 4 WHEN measurement = 0 THEN 1 ELSE 0 END"
BASE = [sql.ENT, sql.SHEETS, sql.LAYERS, sql.BLOCKDEFS, sql.BOXES, EXT]
ORACLES = {
    "entity_id": sql.query("SELECT sheet_id, seq, entity_id FROM ent", sql.ENT),
    "entity_type_stats": sql.query(f"SELECT sheet_id, dxf_type, n, {sql.rnd('n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY sheet_id)', 2)} AS ratio FROM (SELECT sheet_id, dxf_type, count(*) AS n FROM ent GROUP BY ALL)", sql.ENT),
    "layer_summary": sql.query("SELECT sheet_id, layer, count(*) AS n FROM ent GROUP BY ALL", sql.ENT),
    "layer_stats": sql.query("SELECT l.sheet_id, l.name, color, is_off, is_frozen, is_locked, CAST(coalesce(sum(n), 0) AS BIGINT) AS entity_count, coalesce(string_agg(dxf_type || '×' || n, '；' ORDER BY dxf_type), '') AS entity_types FROM layers l LEFT JOIN "
                             "(SELECT sheet_id, layer, dxf_type, count(*) AS n FROM ent GROUP BY ALL) e ON l.sheet_id = e.sheet_id AND l.name = e.layer GROUP BY ALL", *BASE),
    "user_blocks": sql.query("SELECT sheet_id, block_name FROM blockdefs WHERE left(block_name, 1) NOT IN ('*', '_')", sql.BLOCKDEFS),
    "block_usage": sql.query("SELECT r.* EXCLUDE (n, attribute_keys), n AS insert_count, (sheet_id, block_name) IN (SELECT sheet_id, block_name FROM blockdefs) AS defined FROM refs r", *BASE, sql.block_refs(5)),
    "block_samples": sql.query("SELECT sheet_id, block_name, rank, concat_ws('；', 'ROOM=' || attr_room, 'SPEC=' || attr_spec) AS attributes FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, block_name ORDER BY seq, entity_id) AS rank FROM ent "
                               "WHERE dxf_type = 'INSERT' AND (attr_spec IS NOT NULL OR attr_room IS NOT NULL)) WHERE rank <= 5", sql.ENT),
    "dimension_kind": sql.query(f"SELECT dimtype, {KIND} AS kind, count(*) AS n FROM dims GROUP BY dimtype", DIM),
    "dimension_stats": sql.query(f"SELECT sheet_id, {KIND} AS kind, count(*) AS n, max(measurement) AS largest FROM dims GROUP BY ALL", DIM),
    "extents": sql.query("SELECT * FROM ext", *BASE),
    "sheet_overview": sql.query(f"SELECT s.sheet_id, CAST({CODE} AS BIGINT) AS units_code, CASE {CODE} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fixed.UNIT_NAMES.items()) + " END AS units_name, "
                                "CASE WHEN insunits <> 0 THEN '' WHEN measurement = 1 THEN '未显式设置，按公制推断为毫米' WHEN measurement = 0 THEN '未显式设置，按英制推断为英寸' ELSE '图纸未设置单位，请人工确认' END AS units_note, "
                                "coalesce(e.n, 0) AS entities, 15::BIGINT AS layers, 7::BIGINT AS block_definitions, width, height FROM sheets s LEFT JOIN (SELECT sheet_id, count(*) AS n FROM ent GROUP BY sheet_id) e USING (sheet_id) LEFT JOIN ext USING (sheet_id)", *BASE),
    "empty_layers": sql.query(f"SELECT sheet_id, item AS name FROM ({RULE_SQL['layer_entity_count_zero']})", *BASE),
    "unused_blocks": sql.query(f"SELECT sheet_id, item AS block_name FROM ({RULE_SQL['unused_block_definition']})", *BASE),
}
