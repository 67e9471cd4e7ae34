"""Inputs derived from the star-schema test tables.

The real inputs are entity, sheet, layer, catalog and page tables (see ``schemas``).  Here each
of them is a projection of the supplied Parquet tables, so that every query reads whole tables.
The expression texts are plain SQL shared with the reference queries.
"""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmetric.model import schemas
from sheetmetric.session import shared_folder, write_table

ENTITY_EXPRS = {
    "sheet_id": "CAST(o_custkey AS BIGINT)",
    "entity_id": "md5(concat_ws('~', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), "
                 "CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)))",
    "seq": "l_orderkey * 10 + l_linenumber",
    "dxf_type": "CASE l_linenumber % 7 WHEN 0 THEN 'HATCH' WHEN 1 THEN 'LINE' WHEN 2 THEN 'LWPOLYLINE' WHEN 3 THEN 'CIRCLE' "
                "WHEN 4 THEN 'ARC' WHEN 5 THEN 'INSERT' ELSE 'TEXT' END",
    "layer": "CASE l_partkey % 12 WHEN 0 THEN 'A-WALL' WHEN 1 THEN 'A-DOOR' WHEN 2 THEN 'A-FRAME' WHEN 3 THEN 'S-COLUMN' "
             "WHEN 4 THEN 'S-BEAM' WHEN 5 THEN 'P-PIPE' WHEN 6 THEN 'E-LIGHT' WHEN 7 THEN 'H-DUCT' WHEN 8 THEN 'A-AXIS' "
             "WHEN 9 THEN '门窗表' WHEN 10 THEN 'MYSTERY-LAYER' ELSE '0' END",
    "block_name": "CASE WHEN l_linenumber = 5 THEN CASE l_suppkey % 6 WHEN 0 THEN 'KZ1' WHEN 1 THEN 'M1021' WHEN 2 THEN 'C1515' "
                  "WHEN 3 THEN '香樟' WHEN 4 THEN 'LIGHT_LED_PANEL' ELSE 'SWITCH_SINGLE' END END",
    "label_text": "CASE WHEN l_linenumber = 6 THEN CASE l_suppkey % 11 WHEN 0 THEN 'C30混凝土' WHEN 1 THEN 'DN100镀锌钢管' "
                  "WHEN 2 THEN 'Φ12@200' WHEN 3 THEN '1:100' WHEN 4 THEN '建施-01' WHEN 5 THEN '+3.000' WHEN 6 THEN '±0.000' "
                  "WHEN 7 THEN CASE WHEN o_custkey % 4 = 1 THEN '图例' ELSE '一层平面图' END WHEN 8 THEN CASE o_custkey % 5 WHEN 0 THEN '图纸目录' WHEN 1 THEN '工程名称：滨河路综合楼' WHEN 2 THEN '业主单位: 市政公司；    设计院：某院' WHEN 3 THEN '结构形式 ：框架' ELSE '施工图设计 A版' END WHEN 9 THEN 'YJV-4x25' ELSE '' END END",
    "x0": "CAST((l_partkey * 7919) % 84 AS BIGINT) * 500",
    "y0": "CAST((l_suppkey * 6197 + l_orderkey * 13) % 60 AS BIGINT) * 500",
    "w": "CAST(l_quantity AS BIGINT) % 50 * 100",
    "h": "CAST(round(l_discount * 100) AS BIGINT) * 100",
    "r": "CAST(l_quantity AS BIGINT) % 50 * 10",
    "a0": "CAST((l_suppkey * 15) % 360 AS BIGINT)",
    "closed": "l_returnflag = 'A'",
    "text_height": "CAST(round(l_tax * 100) AS BIGINT) * 100",
    # attribute values of block references: a specification and a room mark, either may be missing
    "attr_spec": "CASE WHEN l_linenumber = 5 THEN CASE l_partkey % 5 WHEN 0 THEN 'DN50' WHEN 1 THEN 'YJV-4x25' WHEN 2 THEN '' "
                 "WHEN 3 THEN 'Q235B钢板' END END",
    "attr_room": "CASE WHEN l_linenumber = 5 AND l_partkey % 3 = 0 THEN concat('R', CAST(l_suppkey % 9 AS STRING)) END",
    "revision": "CASE WHEN l_shipdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'old' ELSE 'new' END",
}
LAYER_NAMES = ["A-WALL", "A-DOOR", "A-FRAME", "S-COLUMN", "S-BEAM", "P-PIPE", "E-LIGHT", "H-DUCT", "A-AXIS", "门窗表",
               "MYSTERY-LAYER", "0", "Defpoints", "图层1", "W-DRAIN"]
BLOCK_NAMES = ["KZ1", "M1021", "C1515", "香樟", "LIGHT_LED_PANEL", "SWITCH_SINGLE", "FCU-2", "_ARCHTICK", "*Model_Space"]
SHEET_EXPRS = {
    "sheet_id": "c_custkey",
    "project_id": "concat('PRJ-', CAST(c_nationkey AS STRING))",
    "source_file": "concat('S', CAST(c_custkey AS STRING), '.dxf')",
    "insunits": "CASE c_nationkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 0 END",
    "measurement": "CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END",
    "discipline": "CASE c_mktsegment WHEN 'BUILDING' THEN 'ARCH' WHEN 'MACHINERY' THEN 'STR' WHEN 'HOUSEHOLD' THEN 'PLUMB' "
                  "WHEN 'FURNITURE' THEN 'ELEC' ELSE 'MULTI' END",
}
CATALOG_EXPRS = {
    "row_id": "o_orderkey",
    "sheet_id": "CAST(o_custkey AS BIGINT)",
    "drawing_no": "CASE o_orderkey % 8 WHEN 0 THEN concat('建施-', CAST(o_orderkey % 97 AS STRING)) "
                  "WHEN 1 THEN concat('结施-', CAST(o_orderkey % 97 AS STRING)) WHEN 2 THEN concat('水施', CAST(o_orderkey % 97 AS STRING)) "
                  "WHEN 3 THEN concat('暖施-', CAST(o_orderkey % 97 AS STRING)) WHEN 4 THEN concat('电施-', CAST(o_orderkey % 97 AS STRING)) "
                  "WHEN 5 THEN concat('a-', CAST(o_orderkey % 97 AS STRING)) WHEN 6 THEN concat('XF-', CAST(o_orderkey % 97 AS STRING)) "
                  "ELSE '未识别' END",
    "drawing_name": "CASE o_custkey % 9 WHEN 0 THEN '一层平面图' WHEN 1 THEN '基础梁配筋图' WHEN 2 THEN '给水排水系统图' WHEN 3 THEN '空调风管平面图' "
                    "WHEN 4 THEN '照明插座平面图' WHEN 5 THEN '消火栓喷淋布置' WHEN 6 THEN '总平面绿化' WHEN 7 THEN '弱电综合布线' ELSE '封面' END",
}
PRIMITIVE_EXPRS = {
    "file": "concat('F', CAST(l_suppkey AS STRING), '.pdf')",
    "page": "CAST(l_linenumber AS BIGINT)",
    "kind": "CASE l_partkey % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'rect' ELSE 'curve' END",
    "x0": "CAST(l_partkey % 500 AS DOUBLE)",
    "y0": "CAST(l_orderkey % 700 AS DOUBLE)",
    "dx": "l_quantity",
    "dy": "CAST(round(l_discount * 100) AS DOUBLE)",
    "linewidth": "l_tax",
    "fill": "l_returnflag = 'A'",
    "prim_id": "md5(concat_ws('~', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), "
               "CAST(l_suppkey AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)))",
}
TABLE_EXPRS = {
    "table_id": "p_partkey - p_partkey % 10",
    "row_index": "p_partkey % 10",
    "c1": "CASE WHEN p_partkey % 10 = 0 THEN CASE (p_partkey - p_partkey % 10) % 60 WHEN 0 THEN '序号' WHEN 10 THEN '门窗编号' "
          "WHEN 20 THEN '材质' WHEN 30 THEN '功率' WHEN 40 THEN '图名' ELSE 'name' END ELSE CASE WHEN p_partkey % 7 = 0 THEN ' ' "
          "ELSE CAST(p_partkey % 10 AS STRING) END END",
    "c2": "CASE WHEN p_partkey % 10 = 0 THEN 'no' WHEN p_partkey % 4 = 0 THEN concat('建施-', CAST(p_size AS STRING)) "
          "WHEN p_partkey % 4 = 1 THEN concat('JS', CAST(p_size AS STRING)) WHEN p_partkey % 4 = 2 THEN p_type ELSE '' END",
    "c3": "CASE WHEN p_partkey % 10 = 0 THEN 'title' WHEN p_partkey % 3 = 0 THEN '二层平面图' WHEN p_partkey % 3 = 1 THEN p_name "
          "ELSE '设计说明' END",
}
FILE_EXPRS = {
    "path": "concat('in/', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.dxf' WHEN 1 THEN '.DWG' WHEN 2 THEN '.pdf' ELSE '.txt' END)",
    "size_bytes": "n_chars * 10000",
    "mtime": "doc_id * 3600",
    "entity_count": "CASE WHEN doc_id % 4 = 0 THEN n_chars * 9 END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, exprs: dict) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS `{name}`" for name, sql in exprs.items()])


LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the star schema that entities are derived from."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(*LINE_COLUMNS)
    # merged at every size: what is shuffled grows with the lines, with no jump where orders no longer fit a broadcast
    return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))


def dealt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """These columns, dealt by sheet and position: numbers are shuffled, ids, points and texts are derived behind the shuffles."""
    files = max(-(-table(spark, sf_dir, "lineitem").count() // FILE_ROWS), 3 * spark.sparkContext.defaultParallelism)
    return order_lines(spark, sf_dir).repartitionByRange(files, "o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


FILE_ROWS = 1_000_000
_ENTITY_TABLES: dict[tuple[str, str], str] = {}


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table, written once per application to the shared folder and read from there.

    A drawing corpus is stored as such a table; here it is first derived from the star schema.
    Read as a table, its columns are plain columns again: they prune and push down, instead of
    every query carrying the derivation's nested expressions through its filters and join keys.
    Rows are dealt by sheet and position, into files of ``FILE_ROWS`` at most and three for each core at least, so
    that per-row work is spread and joins on the sheet find their rows close together.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENTITY_TABLES or not _exists(spark, _ENTITY_TABLES[key]):
        path = f"{shared_folder(spark)}/entities-{uuid.uuid4().hex}"
        write_table(derived_entities(dealt_lines(spark, sf_dir)), path)
        _ENTITY_TABLES[key] = path
    return spark.read.schema(f"{schemas.ENTITY}, revision STRING").parquet(_ENTITY_TABLES[key])


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("sheet_id BIGINT").parquet(path)
    except AnalysisException:           # no such folder
        return False
    return True


def derived_entities(lines: DataFrame) -> DataFrame:
    """Entity rows in the library's shape (see ``schemas.ENTITY``), plus ``revision``."""
    pt = "named_struct('x', CAST({} AS DOUBLE), 'y', CAST({} AS DOUBLE))"
    p0, p1, p2, p3 = (pt.format(*a) for a in (("x0", "y0"), ("x0 + w", "y0"), ("x0 + w", "y0 + h"), ("x0", "y0 + h")))
    return _project(lines, ENTITY_EXPRS).selectExpr(
        "sheet_id", "seq", "entity_id", "dxf_type", "layer", "block_name", "label_text", "revision",
        f"CASE WHEN dxf_type IN ('LWPOLYLINE', 'HATCH') THEN array({p0}, {p1}, {p2}, {p3}) "
        f"WHEN dxf_type = 'LINE' THEN array({p0}, {p1}) ELSE array({p0}) END AS points",
        "closed",
        "CASE WHEN dxf_type IN ('CIRCLE', 'ARC') THEN CAST(r AS DOUBLE) END AS radius",
        "CASE WHEN dxf_type = 'ARC' THEN CAST(a0 AS DOUBLE) END AS start_angle",
        "CASE WHEN dxf_type = 'ARC' THEN CAST(a0 + 90 AS DOUBLE) END AS end_angle",
        "CASE WHEN dxf_type = 'TEXT' THEN CAST(text_height AS DOUBLE) END AS height",
        "map_filter(map('SPEC', attr_spec, 'ROOM', attr_room), (k, v) -> v IS NOT NULL) AS attribs")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "customer"), SHEET_EXPRS)


SHEETS_DEALT = 20_000             # sheets that one task unfolds to their layers or blocks


def _each_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet ids, dealt before they unfold: the file is small and would be read by one task."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sheet_id"))
    parts = -(-ids.count() // SHEETS_DEALT)
    return ids.repartition(parts, "sheet_id") if parts > 1 else ids


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer table: every sheet declares the same list; states vary by sheet and position."""
    names = F.array(*[F.lit(n) for n in LAYER_NAMES])
    return (_each_sheet(spark, sf_dir).select("sheet_id", F.posexplode(names).alias("pos", "name"))
            .selectExpr("sheet_id", "CAST(pos AS BIGINT) AS pos", "name", "CAST(pos % 7 + 1 AS BIGINT) AS color",
                        "(sheet_id + pos) % 7 = 0 AS is_off", "(sheet_id + pos) % 11 = 0 AS is_frozen",
                        "(sheet_id + pos) % 13 = 0 AS is_locked"))


def block_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in BLOCK_NAMES])
    return (_each_sheet(spark, sf_dir).select("sheet_id", F.posexplode(names).alias("pos", "block_name"))
            .withColumn("pos", F.col("pos").cast("long")))


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension entities: the line rows read as linear measurements with a type code."""
    return (table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
        .selectExpr("CAST(o_custkey AS BIGINT) AS sheet_id", "CAST(l_quantity AS BIGINT) * 8 + l_suppkey % 8 AS dimtype",
                    "l_quantity AS measurement"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "orders"), CATALOG_EXPRS)


def pdf_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_project(table(spark, sf_dir, "lineitem"), PRIMITIVE_EXPRS)
            .withColumn("x1", F.col("x0") + F.col("dx")).withColumn("y1", F.col("y0") + F.col("dy"))
            .withColumn("pts", F.expr("array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y0), "
                                      "named_struct('x', x1, 'y', y1))")))


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text: blank to long by file and page."""
    return (table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "CAST(l_linenumber AS BIGINT) AS page").distinct()
            .selectExpr("concat('F', CAST(l_suppkey AS STRING), '.pdf') AS file", "page",
                        "concat(' ', repeat('x', CAST((l_suppkey * 7 + page * 13) % 60 AS INT)), ' ') AS text"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_project(table(spark, sf_dir, "part"), TABLE_EXPRS)
            .select("table_id", "row_index", F.array("c1", "c2", "c3").alias("cells")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "documents"), FILE_EXPRS)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of an earlier run: every second file, some of them since changed, some without output."""
    return (table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
            .selectExpr(f"{FILE_EXPRS['path']} AS path", "n_chars * 10000 + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS size_bytes",
                        "doc_id * 3600 AS mtime", "doc_id % 6 <> 0 AS outputs_exist"))
