"""Queries of the contract checks."""
from pyspark.sql import functions as F

from sheetmetric.functions.geometry import bbox_sql
from sheetmetric.model import adapter
from sheetmetric.operators import contracts as c
from sheetmetric.operators.classify import with_category
from sheetmetric.operators.measure import with_role
from sheetmetric.operators.rules import GEOMETRY_TYPE
from sheetmetric.queries import measure as mq
from sheetmetric.queries import sql
from sheetmetric.queries.graph import CATS

LINE_EXPRS = {
    "line_id": adapter.ENTITY_EXPRS["entity_id"],
    "project_code": "CASE l_partkey % 5 WHEN 0 THEN '010101001' WHEN 1 THEN '010101001B001' WHEN 2 THEN '0101' WHEN 4 THEN '030901001' END",
    "name": "CASE WHEN l_suppkey % 17 = 0 THEN '' ELSE concat('N', CAST(l_partkey AS STRING)) END",
    "feature": "CASE WHEN l_suppkey % 13 = 0 THEN '' WHEN l_suppkey % 13 = 1 THEN NULL ELSE '待确认' END",
    "unit": "CASE l_linenumber % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'm2' WHEN 2 THEN 'foot' ELSE '个' END",
    "quantity": "l_quantity - 2",
    "source_level": "CASE l_suppkey % 5 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'DERIVED' WHEN 2 THEN 'ESTIMATED' WHEN 3 THEN 'PENDING' ELSE 'GUESS' END",
    "etype": "CASE l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'ENTITY' ELSE 'PHOTO' END",
    "confidence": "l_discount * 20",
}


def _lines(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*[f"{e} AS {n}" for n, e in LINE_EXPRS.items()])
    return rows.selectExpr("*", "filter(array(named_struct('type', etype, 'ref', line_id)), e -> e.type IS NOT NULL) AS evidence")


def _entities(spark, sf):
    rows = with_role(adapter.entities(spark, sf)).selectExpr("*", f"{bbox_sql(False)} AS b")
    return rows.selectExpr("entity_id", "dxf_type", "nullif(layer, '0') AS layer", "array(b.xmin, b.ymin, b.xmax, b.ymax) AS bbox", "layer_role",
                           "CASE WHEN closed THEN 'VECTOR' ELSE 'PHOTO' END AS source", "seq % 3 / 1.5D AS confidence")


def _violations(df, contract, ident):
    return c.validate(df, contract, ident).groupBy("contract", "path", "rule").agg(F.count("*").alias("n"))


def _validate_contract(spark, sf):
    return _violations(_lines(spark, sf), "quantity_line", "line_id").unionByName(_violations(_entities(spark, sf), "entity", "entity_id"))


def _cio(spark, sf):
    """Interchange rows; hatches have no interchange geometry type of their own."""
    rows = with_category(adapter.entities(spark, sf)).selectExpr("*", f"{bbox_sql(False)} AS b")
    return rows.selectExpr("entity_id", "nullif(category, 'UNKNOWN') AS category", f"named_struct('type', {GEOMETRY_TYPE}, 'bbox', CASE WHEN dxf_type = 'INSERT' THEN array(b.xmin, b.ymin) ELSE array(b.xmin, b.ymin, b.xmax, b.ymax) END) AS geometry",
                           "CAST(seq % 110 AS DOUBLE) AS discipline_confidence")


QUERIES = {
    "validate_contract": _validate_contract,
    "validate_cio": lambda s, d: _violations(_cio(s, d), "cio", "entity_id"),
    "stamp_version": lambda s, d: c.stamp_version(mq.takeoff(s, d).totals(), "quantities"),
}

QL = "ql AS (" + sql.select(LINE_EXPRS, "lineitem") + ")"


def count(contract, path, rule, source, cond):
    return f"SELECT '{contract}' AS contract, '{path}' AS path, '{rule}' AS rule, count(*) AS n FROM {source} WHERE {cond}"


CHECKS = [("quantity_line", "project_code", "required", "ql", "project_code IS NULL"), ("quantity_line", "feature", "required", "ql", "feature IS NULL"),
          ("quantity_line", "project_code", "pattern", "ql", "project_code = '0101'"), ("quantity_line", "name", "minLength", "ql", "name = ''"), ("quantity_line", "feature", "minLength", "ql", "feature = ''"),
          ("quantity_line", "unit", "enum", "ql", "unit = 'foot'"), ("quantity_line", "quantity", "minimum", "ql", "quantity < 0"), ("quantity_line", "source_level", "enum", "ql", "source_level = 'GUESS'"),
          ("quantity_line", "evidence.type", "enum", "ql", "etype = 'PHOTO'"), ("quantity_line", "confidence", "maximum", "ql", "confidence > 1"),
          ("quantity_line", "evidence", "minItems", "ql", "etype IS NULL AND source_level IN ('DIRECT', 'DERIVED')"),
          ("entity", "layer", "required", "ent", "layer = '0'"), ("entity", "source", "enum", "ent", "NOT closed"), ("entity", "confidence", "maximum", "ent", "seq % 3 = 2")]
CIO = [("cio", "category", "required", "ecat", "category = 'UNKNOWN'"), ("cio", "geometry.type", "enum", "ecat", "dxf_type = 'HATCH'"), ("cio", "geometry.bbox", "items", "ecat", "dxf_type = 'INSERT'"),
       ("cio", "discipline_confidence", "maximum", "ecat", "seq % 110 > 100")]
ORACLES = {
    "validate_contract": sql.query("SELECT * FROM (" + " UNION ALL ".join(count(*x) for x in CHECKS) + ") WHERE n > 0", sql.ENT, QL),
    "validate_cio": sql.query("SELECT * FROM (" + " UNION ALL ".join(count(*x) for x in CIO) + ") WHERE n > 0", sql.ENT, CATS),
    "stamp_version": mq.ORACLES["merge_quantities"].replace("SELECT 'block' AS kind", "SELECT *, 'sheetmetric.quantities/1.0' AS schema FROM (SELECT 'block' AS kind") + ")",
}
