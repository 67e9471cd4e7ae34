"""Queries of the sources and sinks."""
import uuid

from pyspark.sql import functions as F

from sheetmetric.functions.geometry import bbox_sql
from sheetmetric.model import adapter, fixed, schemas
from sheetmetric.operators.classify import categorized
from sheetmetric.queries import sql
from sheetmetric.queries.graph import CATS
from sheetmetric.session import shared_folder
from sheetmetric.sources import readers as r


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def _read_cio(spark, sf):
    """Every sheet written as an interchange document in the shared folder, and the documents read back."""
    path = _folder(spark, "documents")
    r.write_cio(categorized(adapter.entities(spark, sf)), adapter.sheets(spark, sf), adapter.layers(spark, sf), adapter.block_definitions(spark, sf), path, compression="gzip")
    return r.read_cio(spark, path, lines=True).selectExpr(
        "project_id", "source_file", "seq", "entity_id", "category", "sub_category", "layer", "block_name", "label_text", "CAST(size(points) AS BIGINT) AS n_points",
        "points[0].x AS x", "points[0].y AS y", "radius", "attribs['SPEC'] AS spec")


def _incremental(spark, sf):
    state = adapter.manifest(spark, sf).withColumn("fingerprint", F.expr(r.fingerprint_sql("snap=50")))
    return r.incremental_sheets(adapter.files(spark, sf), state, "snap=50").select("path", "size_bytes", "fingerprint")


CATALOG = "row_id BIGINT, drawing_no STRING, drawing_name STRING"


def _csv(spark, sf):
    path = _folder(spark, "csv")
    r.write_csv_table(adapter.catalog(spark, sf).selectExpr("row_id", "drawing_no", "drawing_name"), path)
    return r.read_csv_table(spark, path, CATALOG)


def _json(spark, sf):
    path = _folder(spark, "json")
    r.write_json_table(adapter.catalog(spark, sf).selectExpr("row_id", "drawing_no", "nullif(drawing_name, '封面') AS drawing_name"), path)
    return r.read_json_table(spark, path, CATALOG)


QUERIES = {
    "read_cio": _read_cio,
    "file_inventory": lambda s, d: r.file_inventory(adapter.files(s, d)),
    "format_counts": lambda s, d: r.format_counts(r.file_inventory(adapter.files(s, d))),
    "incremental_sheets": _incremental,
    "csv_table": _csv,
    "json_table": _json,
}

INV = ("inv AS (SELECT path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS format, " + sql.rnd("size_bytes / 1048576.0::DOUBLE", 2) + " AS size_mb, entity_count, "
       "size_bytes > 52428800 OR coalesce(entity_count, 0) > 50000 AS is_large FROM files WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('dxf', 'dwg', 'pdf'))")
FP = "sha1(concat_ws('|', path, CAST(mtime AS VARCHAR), CAST(size_bytes AS VARCHAR), 'snap=50'))"
ORACLES = {
    "read_cio": sql.query("SELECT project_id, source_file, row_number() OVER (PARTITION BY sheet_id ORDER BY seq, entity_id) - 1 AS seq, entity_id, category, sub_category, layer, block_name, label_text, CAST(CASE WHEN dxf_type IN ('LWPOLYLINE', 'HATCH') THEN 4 WHEN dxf_type = 'LINE' THEN 2 ELSE 1 END AS BIGINT) AS n_points, "
                          "CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y, CASE WHEN dxf_type IN ('CIRCLE', 'ARC') THEN CAST(r AS DOUBLE) END AS radius, attr_spec AS spec FROM ecat JOIN sheets USING (sheet_id)", sql.ENT, sql.SHEETS, CATS),
    "file_inventory": sql.query("SELECT * FROM inv", sql.FILES, INV),
    "format_counts": sql.query("SELECT format, count(*) AS n, count(*) FILTER (WHERE is_large) AS large FROM inv GROUP BY format", sql.FILES, INV),
    "incremental_sheets": sql.query(f"SELECT path, size_bytes, {FP} AS fingerprint FROM files WHERE (path, {FP}) NOT IN (SELECT path, {FP} FROM manifest WHERE outputs_exist)", sql.FILES, sql.MANIFEST),
    "csv_table": sql.query("SELECT row_id, drawing_no, drawing_name FROM catalog", sql.CATALOG),
    "json_table": sql.query("SELECT row_id, drawing_no, nullif(drawing_name, '封面') AS drawing_name FROM catalog", sql.CATALOG),
}
