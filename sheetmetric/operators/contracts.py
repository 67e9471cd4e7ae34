"""Data contracts as constraint jobs: every violated constraint of a row becomes one row."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.functions.text import raw
from sheetmetric.model import fixed

NAMESPACE = "sheetmetric"
STAGES = ["inventory", "catalog", "quantities", "wbs", "label_chains", "space", "process", "material", "review", "pdf_quantities",
          "summary", "manifest", "cio", "drawing_index", "perception_bundle"]


def stamp_version(df: DataFrame, stage: str, version: str = "1.0") -> DataFrame:
    """Marks a table with its schema version; an unknown stage is an error."""
    if stage not in STAGES:
        raise KeyError(f"unknown stage: {stage}")
    return df.withColumn("schema", F.lit(f"{NAMESPACE}.{stage}/{version}"))


# a constraint is (path, rule name, SQL condition that holds when it is violated)
def required(col):
    return (col, "required", f"{col} IS NULL")


def enum(col, values):
    return (col, "enum", f"{col} NOT IN ({', '.join(raw(v) for v in values)})")


def pattern(col, regex):
    return (col, "pattern", f"NOT {col} RLIKE {raw(regex)}")


def minimum(col, low):
    return (col, "minimum", f"{col} < {low}")


def maximum(col, high):
    return (col, "maximum", f"{col} > {high}")


def min_length(col, n=1):
    return (col, "minLength", f"length({col}) < {n}")


def items(col, n):
    return (col, "items", f"size({col}) <> {n}")


def min_items(col, n=1):
    return (col, "minItems", f"size({col}) < {n}")


def each_enum(col, field, values):
    return (f"{col}.{field}", "enum", f"exists({col}, i -> i.{field} NOT IN ({', '.join(raw(v) for v in values)}))")


def each_required(col, field):
    return (f"{col}.{field}", "required", f"exists({col}, i -> i.{field} IS NULL)")


def confidence(col="confidence", high=1):
    return [minimum(col, 0), maximum(col, high)]


CONTRACTS = {
    "entity": [required("entity_id"), required("dxf_type"), required("layer"), required("bbox"), items("bbox", 4), enum("layer_role", fixed.LAYER_ROLES),
               enum("source", fixed.ENTITY_SOURCES), *confidence()],
    "cio": [required("entity_id"), required("category"), required("geometry"), required("geometry.type"), enum("geometry.type", fixed.GEOMETRY_TYPES), items("geometry.bbox", 4),
            *confidence("discipline_confidence", 100)],
    "quantity_line": [*[required(c) for c in ("line_id", "project_code", "name", "feature", "unit", "quantity", "source_level", "evidence")],
                      pattern("project_code", fixed.PROJECT_CODE_PATTERN), min_length("name"), min_length("feature"), enum("unit", fixed.QUANTITY_UNITS), minimum("quantity", 0),
                      enum("source_level", fixed.SOURCE_LEVELS), each_required("evidence", "type"), each_required("evidence", "ref"),
                      each_enum("evidence", "type", ["ENTITY", "SHEET", "TABLE", "DIMENSION", "RULE", "FORMULA"]), *confidence(),
                      ("evidence", "minItems", "source_level IN ('DIRECT', 'DERIVED') AND size(evidence) < 1")],
    "label_chain": [*[required(c) for c in ("discipline.code", "discipline.name", "unit_work.name", "division.name", "subitem.name", "confidence", "evidence")],
                    *confidence(), *confidence("discipline.confidence"), *confidence("unit_work.confidence"), *confidence("division.confidence"), *confidence("subitem.confidence"),
                    enum("acceptance_standard", fixed.ACCEPTANCE_STANDARDS), min_items("evidence"), each_required("evidence", "type"), each_required("evidence", "ref"),
                    each_enum("evidence", "type", ["LAYER", "BLOCK_NAME", "TEXT", "TABLE", "DIMENSION", "LEGEND", "SHEET", "RULE"])],
    "material_line": [*[required(c) for c in ("material", "spec", "unit", "quantity", "derivation_path", "source_level")], enum("material", fixed.MATERIAL_NAMES),
                      enum("unit", fixed.MATERIAL_UNITS), min_items("derivation_path"), enum("basis", fixed.MATERIAL_BASES), enum("source_level", fixed.SOURCE_LEVELS)],
    "drawing_index": [required("sheet_id"), required("frame_bbox"), items("frame_bbox", 4), required("status"), enum("status", fixed.SHEET_STATUSES),
                      minimum("entity_count", 0), enum("drawing_unit", ["mm", "cm", "m", "inch", "ft", "unitless"]),
                      ("factor_to_mm", "exclusiveMinimum", "factor_to_mm <= 0"), enum("calibrated_by", ["INSUNITS", "TITLE_BLOCK", "PDF_MEASURE", "ASSUMED"]), *confidence()],
    "perception_bundle": [required("sheet_id"), each_required("texts", "text"), each_required("texts", "entity_id"), each_enum("texts", "source", ["VECTOR", "PDF_VECTOR", "OCR", "SHX_RECOVERED"]),
                          each_required("tables", "table_id"), each_enum("tables", "kind", ["DOOR_WINDOW", "REBAR", "PLANT", "EQUIPMENT", "MEMBER", "GENERAL", "UNKNOWN"]),
                          each_required("semantics", "label"), each_required("semantics", "bbox"), each_enum("semantics", "cross_check_status", fixed.CROSS_CHECKS)],
}


def validate(df: DataFrame, contract: str, ident: str) -> DataFrame:
    """Violations as (id, contract, path, rule).  All constraints of a table share one scan."""
    checks = ", ".join(f"CASE WHEN {cond} THEN named_struct('path', '{path}', 'rule', '{rule}') END" for path, rule, cond in CONTRACTS[contract])
    return df.selectExpr(f"CAST({ident} AS STRING) AS id", f"'{contract}' AS contract", f"inline(array_compact(array({checks})))")
