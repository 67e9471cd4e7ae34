"""Queries of the take-off operators."""
from sheetmetric.functions.geometry import AREA, LENGTH, bbox_sql
from sheetmetric.functions.numbers import half_up
from sheetmetric.model import adapter, fixed
from sheetmetric.operators import measure as m
from sheetmetric.plans.quantities import Takeoff
from sheetmetric.queries import sql
from sheetmetric.queries.calibrate import CALIBRATION_CTES
from pyspark.sql import functions as F


def takeoff(spark, sf):
    return Takeoff(adapter.entities(spark, sf), adapter.sheets(spark, sf))


def detail(spark, sf):
    return m.block_detail(adapter.entities(spark, sf))


def _layer_role(spark, sf):
    counts = adapter.entities(spark, sf).groupBy("layer").agg(F.count("*").alias("n"))
    return counts.withColumn("role", m.layer_role())


def _line_length(spark, sf):
    return adapter.entities(spark, sf).withColumn("length", half_up(F.expr(LENGTH), 3)).where("length IS NOT NULL").select("entity_id", "length")


def _polygon_area(spark, sf):
    return adapter.entities(spark, sf).withColumn("area", F.expr(AREA)).where("area > 0").select("entity_id", "area")


def _entity_bbox(spark, sf):
    rows = adapter.entities(spark, sf).select("entity_id", F.expr(bbox_sql(False)).alias("p"), F.expr(bbox_sql(True)).alias("t"))
    return rows.select("entity_id", "p.xmin", "p.ymin", "p.xmax", "p.ymax", F.col("t.xmax").alias("pool_xmax"), F.col("t.ymax").alias("pool_ymax"))


def _spec_attr(spark, sf):
    rows = adapter.entities(spark, sf).where("dxf_type = 'INSERT'")
    return rows.select("entity_id", F.expr(m.spec_from_attribs_sql()).alias("spec"))


def _spec_layer(spark, sf):
    rows = adapter.entities(spark, sf).where("dxf_type = 'INSERT'").groupBy("layer", "block_name").agg(F.count("*").alias("n"))
    return rows.withColumn("spec", F.expr(f"coalesce(nullif({m.spec_from_layer_sql()}, ''), '{fixed.NO_SPEC}')"))


def _spec_text(spark, sf):
    return m.block_texts(detail(spark, sf)).select("sheet_id", "block_name", "spec_text")


def _appendix(spark, sf):
    return takeoff(spark, sf).appendix()


def _first_layer(spark, sf):
    return m.first_layer_of_block(detail(spark, sf))


def _merge(spark, sf):
    return takeoff(spark, sf).totals()


def _audit(spark, sf):
    t = takeoff(spark, sf)
    return m.measure_audit(t.entities, t.calibration)


QUERIES = {
    "layer_role": _layer_role,
    "line_length": _line_length,
    "polygon_area": _polygon_area,
    "entity_bbox": _entity_bbox,
    "spec_from_attribs": _spec_attr,
    "spec_from_layer": _spec_layer,
    "spec_text": _spec_text,
    "block_counts": lambda s, d: m.block_counts(detail(s, d)),
    "block_layers": lambda s, d: m.block_layers(detail(s, d)),
    "block_specs": lambda s, d: m.block_specs(detail(s, d)),
    "layer_length": lambda s, d: takeoff(s, d).lengths,
    "layer_area": lambda s, d: takeoff(s, d).areas,
    "measure_audit": _audit,
    "quantity_summary": lambda s, d: takeoff(s, d).summary(),
    "merge_quantities": _merge,
    "quantity_appendix": _appendix,
    "role_stats": lambda s, d: m.role_stats(adapter.entities(s, d)),
    "quantity_quick": lambda s, d: m.quantity_quick(adapter.entities(s, d)),
    "first_layer_of_block": _first_layer,
}

# a specification attribute, or any attribute whose text looks like one (room marks never do)
SPEC = f"""CASE WHEN coalesce(trim(attr_spec), '') <> '' THEN trim(attr_spec)
  WHEN regexp_matches(layer || ' ' || block_name, '(?i)DN\\d+') THEN regexp_extract(layer || ' ' || block_name, '(?i)DN\\d+')
  WHEN regexp_matches(layer || ' ' || block_name, '(?i)(YJV|BV|VV|KVV|ZR|NH)') THEN regexp_extract(layer || ' ' || block_name, '(?i)(YJV|BV|VV|KVV|ZR|NH)[\\w\\-*×/]*')
  ELSE '{fixed.NO_SPEC}' END"""
EXCLUDED = "(" + ", ".join(sql.lit(r) for r in fixed.EXCLUDED_ROLES) + ")"
DETAIL = (f"detail AS (SELECT sheet_id, block_name, layer, {SPEC} AS spec, seq, entity_id FROM entr "
          f"WHERE dxf_type = 'INSERT' AND role NOT IN {EXCLUDED})")
LENGTHS = (f"lengths AS (SELECT e.sheet_id, layer, {sql.rnd('raw * factor_to_mm', 2)} AS total_length_mm, {sql.rnd('raw * factor_to_mm / 1000', 2)} AS total_length_m "
           f"FROM (SELECT sheet_id, layer, CAST(sum(CAST({sql.LENGTH} AS DECIMAL(28,6))) AS DOUBLE) AS raw FROM entr WHERE role = 'MEASURABLE' GROUP BY ALL) e "
           "JOIN calib USING (sheet_id) WHERE raw > 0)")
AREAS = (f"areas AS (SELECT e.sheet_id, layer, {sql.rnd('raw * factor_to_mm * factor_to_mm', 2)} AS total_area_mm2, "
         f"{sql.rnd('raw * factor_to_mm * factor_to_mm / 1e6', 2)} AS total_area_m2 "
         f"FROM (SELECT sheet_id, layer, CAST(sum(CAST({sql.AREA} AS DECIMAL(28,6))) AS DOUBLE) AS raw FROM entr WHERE role = 'MEASURABLE' GROUP BY ALL) e "
         "JOIN calib USING (sheet_id) WHERE raw > 0)")
TAKEOFF_CTES = [sql.ENT, sql.ENTR, sql.SHEETS, *CALIBRATION_CTES, DETAIL, LENGTHS, AREAS]
MLEN = ("mlen AS (SELECT layer, " + sql.rnd("CAST(sum(CAST(total_length_mm AS DECIMAL(28,6))) AS DOUBLE) / 1000", 3) + " AS q FROM lengths GROUP BY layer)")
MAREA = ("marea AS (SELECT layer, " + sql.rnd("CAST(sum(CAST(total_area_mm2 AS DECIMAL(28,6))) AS DOUBLE) / 1e6", 3) + " AS q FROM areas GROUP BY layer)")

ORACLES = {
    "layer_role": sql.query("SELECT layer, count(*) AS n, role FROM entr GROUP BY layer, role", sql.ENT, sql.ENTR),
    "line_length": sql.query(f"SELECT entity_id, {sql.rnd(sql.LENGTH, 3)} AS length FROM ent WHERE dxf_type IN ('LINE','LWPOLYLINE','ARC','CIRCLE')", sql.ENT),
    "polygon_area": sql.query(f"SELECT entity_id, {sql.AREA} AS area FROM ent WHERE {sql.AREA} > 0", sql.ENT),
    "entity_bbox": sql.query(
        "SELECT entity_id, CAST(xmin AS DOUBLE) AS xmin, CAST(ymin AS DOUBLE) AS ymin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymax AS DOUBLE) AS ymax, "
        "CASE WHEN dxf_type = 'TEXT' THEN x0 + greatest(CAST(text_height AS DOUBLE), length(label_text) * CAST(text_height AS DOUBLE) * 0.7) ELSE xmax END AS pool_xmax, "
        "CAST(CASE WHEN dxf_type = 'TEXT' THEN y0 + text_height ELSE ymax END AS DOUBLE) AS pool_ymax FROM boxes", sql.ENT, sql.BOXES),
    "spec_from_attribs": sql.query("SELECT entity_id, coalesce(trim(attr_spec), '') AS spec FROM ent WHERE dxf_type = 'INSERT'", sql.ENT),
    "spec_from_layer": sql.query(f"SELECT layer, block_name, count(*) AS n, {SPEC.replace('attr_spec', 'NULL')} AS spec FROM ent WHERE dxf_type = 'INSERT' GROUP BY layer, block_name", sql.ENT),
    "spec_text": sql.query(
        f"SELECT sheet_id, block_name, coalesce(string_agg(spec || '×' || n, '；' ORDER BY spec) FILTER (WHERE spec <> '{fixed.NO_SPEC}'), '') AS spec_text FROM "
        "(SELECT sheet_id, block_name, spec, count(*) AS n FROM detail GROUP BY ALL) GROUP BY sheet_id, block_name", sql.ENT, sql.ENTR, DETAIL),
    "block_counts": sql.query("SELECT sheet_id, block_name, count(*) AS quantity, '个' AS unit FROM detail GROUP BY sheet_id, block_name", sql.ENT, sql.ENTR, DETAIL),
    "block_layers": sql.query("SELECT sheet_id, block_name, layer, count(*) AS n FROM detail GROUP BY ALL", sql.ENT, sql.ENTR, DETAIL),
    "block_specs": sql.query("SELECT sheet_id, block_name, spec, count(*) AS n FROM detail GROUP BY ALL", sql.ENT, sql.ENTR, DETAIL),
    "layer_length": sql.query("SELECT * FROM lengths", *TAKEOFF_CTES),
    "layer_area": sql.query("SELECT * FROM areas", *TAKEOFF_CTES),
    "measure_audit": sql.query(
        f"SELECT sheet_id, 'excluded' AS kind, role, layer AS item, count(*) AS n FROM entr WHERE role IN {EXCLUDED} GROUP BY ALL "
        "UNION ALL SELECT sheet_id, 'unclassified', role, layer, count(*) FROM entr WHERE role = 'UNKNOWN' GROUP BY ALL "
        "UNION ALL SELECT sheet_id, 'pending', 'UNKNOWN', 'UNCLASSIFIED_LAYERS', count(*) FROM entr WHERE role = 'UNKNOWN' GROUP BY sheet_id "
        "UNION ALL SELECT sheet_id, 'pending', '', pending, 1 FROM calib WHERE pending IS NOT NULL", *TAKEOFF_CTES),
    "quantity_summary": sql.query(
        "SELECT sheet_id, count(DISTINCT b) AS block_types, CAST(sum(q) AS BIGINT) AS block_total, count(DISTINCT l) AS length_layers, count(DISTINCT a) AS area_layers FROM ("
        "SELECT sheet_id, block_name AS b, 1 AS q, NULL AS l, NULL AS a FROM detail UNION ALL SELECT sheet_id, NULL, 0, layer, NULL FROM lengths "
        "UNION ALL SELECT sheet_id, NULL, 0, NULL, layer FROM areas) GROUP BY sheet_id", *TAKEOFF_CTES),
    "merge_quantities": sql.query(
        "SELECT 'block' AS kind, block_name AS name, '' AS item, CAST(count(*) AS DOUBLE) AS quantity, '个' AS unit FROM detail GROUP BY block_name "
        "UNION ALL SELECT 'block_layer', block_name, layer, CAST(count(*) AS DOUBLE), '个' FROM detail GROUP BY block_name, layer "
        "UNION ALL SELECT 'block_spec', block_name, spec, CAST(count(*) AS DOUBLE), '个' FROM detail GROUP BY block_name, spec "
        "UNION ALL SELECT 'length', layer, '', q, 'm' FROM mlen UNION ALL SELECT 'area', layer, '', q, 'm²' FROM marea", *TAKEOFF_CTES, MLEN, MAREA),
    "quantity_appendix": sql.query(
        "SELECT '构件' AS category, b.block_name AS name, coalesce(s.spec, '') AS spec, CAST(b.q AS DOUBLE) AS quantity, '个' AS unit, b.source FROM "
        "(SELECT block_name, count(*) AS q, string_agg(DISTINCT layer, '、' ORDER BY layer) AS source FROM detail GROUP BY block_name) b LEFT JOIN "
        f"(SELECT block_name, string_agg(spec || '×' || n, '；' ORDER BY spec) AS spec FROM (SELECT block_name, spec, count(*) AS n FROM detail WHERE spec <> '{fixed.NO_SPEC}' GROUP BY ALL) GROUP BY block_name) s "
        "USING (block_name) UNION ALL SELECT '线长', layer, '', q, 'm', layer FROM mlen UNION ALL SELECT '面积', layer, '', q, 'm²', layer FROM marea",
        *TAKEOFF_CTES, MLEN, MAREA),
    "role_stats": sql.query("SELECT sheet_id, role, count(*) AS entity_count, count(DISTINCT layer) AS layer_count FROM entr GROUP BY sheet_id, role", sql.ENT, sql.ENTR),
    "quantity_quick": sql.query(
        "SELECT sheet_id, 'block' AS kind, block_name AS name, CAST(n AS DOUBLE) AS total, layers, attribute_keys, attribute_samples FROM refs "
        f"UNION ALL SELECT sheet_id, 'length', layer, {sql.rnd('v', 2)}, '', '', '' FROM (SELECT sheet_id, layer, sum(CAST({sql.LENGTH} AS DECIMAL(28,6))) AS v FROM ent GROUP BY ALL) WHERE v > 0 "
        "UNION ALL SELECT sheet_id, 'area', layer, CAST(sum(w * h) AS DOUBLE), '', '', '' FROM ent WHERE dxf_type = 'LWPOLYLINE' AND closed GROUP BY ALL HAVING sum(w * h) > 0", sql.ENT, sql.block_refs(3)),
    "first_layer_of_block": sql.query(
        "SELECT sheet_id, block_name, layer AS first_layer FROM detail QUALIFY row_number() OVER (PARTITION BY sheet_id, block_name ORDER BY seq, entity_id) = 1", sql.ENT, sql.ENTR, DETAIL),
}
