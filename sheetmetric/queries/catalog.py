"""Queries of the catalog and table operators."""
from sheetmetric.model import adapter, fixed
from sheetmetric.operators import catalog as c
from sheetmetric.queries import sql
from sheetmetric.queries import text as tq


def _cluster(tolerance):
    def run(spark, sf):
        return c.row_cluster(c.drawing_texts(adapter.entities(spark, sf)), tolerance).select("sheet_id", "entity_id", "row_y")
    return run


def pdf_tables(spark, sf):
    """Tables of the parts as tables of PDF pages, every fourth of them on a page that names a catalog."""
    return adapter.table_rows(spark, sf).selectExpr(
        "concat('PRJ-', table_id div 10 % 60) AS project_id", "concat('S', table_id % 3, '.pdf') AS file", "table_id % 7 + 1 AS page", "table_id",
        "CASE WHEN table_id % 40 = 0 THEN '图纸目录' ELSE '说明' END AS page_text", "row_index", "array(cells[1], cells[0], cells[2]) AS cells")


def extracted(spark, sf):
    return c.catalog_extract(adapter.entities(spark, sf), adapter.sheets(spark, sf), tq.title_sheet(spark, sf), pdf_tables(spark, sf))


def _files(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").selectExpr("concat('in/建施-', CAST(doc_id AS STRING), '.dxf') AS path")


QUERIES = {
    "catalog_row": lambda s, d: c.catalog_rows(adapter.table_rows(s, d)),
    "table_type": lambda s, d: c.table_types(adapter.table_rows(s, d)),
    "row_cluster": _cluster(50.0),
    "row_cluster_wide": _cluster(1200.0),
    "catalog_extract": extracted,
    "out_of_catalog": lambda s, d: c.out_of_catalog(_files(s, d), adapter.catalog(s, d)),
}

NO = sql.lit("(?i)(?:[\\x{4e00}-\\x{9fa5}]{2}|[A-Z]{2})[\\-]?\\d{1,3}")


def pick(cond):
    return "CASE " + " ".join(f"WHEN {c} <> '' AND {cond.replace('{}', c)} THEN {c}" for c in ("c1", "c2", "c3")) + " ELSE '' END"


ROWS = ("trimmed AS (SELECT table_id, row_index, trim(c1) AS c1, trim(c2) AS c2, trim(c3) AS c3 FROM tables), "
        f"named AS (SELECT *, {pick('regexp_matches({}, ' + NO + ')')} AS no, {pick(sql.any_of('{}', fixed.CATALOG_NAME_KEYWORDS))} AS name FROM trimmed WHERE row_index > 0 AND c1 || c2 || c3 <> ''), "
        "cells AS (SELECT table_id, row_index, pos, c FROM (SELECT table_id, row_index, no, name, unnest([1, 2, 3]) AS pos, unnest([c1, c2, c3]) AS c FROM named) WHERE c <> '' AND c <> no AND c <> name), "
        "rest AS (SELECT table_id, row_index, arg_min(c, pos) AS r1, count(*) AS k, arg_max(c, pos) AS last, max(CASE WHEN rn = 2 THEN c END) AS r2 FROM "
        "(SELECT *, row_number() OVER (PARTITION BY table_id, row_index ORDER BY pos) AS rn FROM cells) GROUP BY ALL)")
ANCHORS = ("ys AS (SELECT DISTINCT sheet_id, y0 AS y FROM ent WHERE dxf_type = 'TEXT'), "
           "anc AS (SELECT sheet_id, max(y) AS a FROM ys GROUP BY sheet_id UNION SELECT s.sheet_id, (SELECT max(y) FROM ys WHERE ys.sheet_id = s.sheet_id AND y <= s.a - {tol}) FROM anc s "
           "WHERE EXISTS (SELECT 1 FROM ys WHERE ys.sheet_id = s.sheet_id AND y <= s.a - {tol})), "
           "rowed AS (SELECT e.sheet_id, e.entity_id, e.seq, e.x0, trim(label_text) AS text, min(a) AS row_y FROM ent e JOIN anc ON e.sheet_id = anc.sheet_id AND a >= e.y0 WHERE dxf_type = 'TEXT' GROUP BY ALL)")
TEXTCAT = (f"titled AS (SELECT DISTINCT sheet_id FROM rowed WHERE {sql.any_of('text', fixed.CATALOG_TITLES)}), body AS (SELECT * FROM rowed r WHERE sheet_id IN (SELECT sheet_id FROM titled) AND text <> '' "
           "AND row_y < (SELECT max(row_y) FROM rowed q WHERE q.sheet_id = r.sheet_id)), "
           f"cnamed AS (SELECT sheet_id, row_y, coalesce(arg_min(text, (x0, seq, entity_id)) FILTER (WHERE regexp_matches(text, {NO})), '') AS no, coalesce(arg_min(text, (x0, seq, entity_id)) FILTER (WHERE {sql.any_of('text', fixed.CATALOG_NAME_KEYWORDS)}), '') AS name FROM body GROUP BY ALL), "
           "crest AS (SELECT sheet_id, row_y, max(CASE WHEN rn = 1 THEN text END) AS r1, max(CASE WHEN rn = 2 THEN text END) AS r2, arg_max(text, rn) AS last FROM (SELECT b.*, row_number() OVER (PARTITION BY b.sheet_id, b.row_y ORDER BY x0, seq, entity_id) AS rn "
           "FROM body b JOIN cnamed n ON b.sheet_id = n.sheet_id AND b.row_y = n.row_y WHERE text <> no AND text <> name) GROUP BY ALL), "
           "tcat AS (SELECT n.sheet_id, CASE WHEN regexp_full_match(r1, '[0-9]+') THEN r1 ELSE '' END AS item_no, CASE WHEN no = '' THEN '未识别' ELSE no END AS drawing_no, coalesce(nullif(name, ''), r2, last, '未识别') AS drawing_name "
           "FROM cnamed n LEFT JOIN crest r ON n.sheet_id = r.sheet_id AND n.row_y = r.row_y)")
PDF = ("tables AS (SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY row_index) - 1 AS row_index, c2 AS c1, c1 AS c2, c3 FROM alltables WHERE table_id % 40 = 0 AND trim(c1) || trim(c2) || trim(c3) <> ''), "
       f"fit AS (SELECT table_id FROM tables GROUP BY table_id HAVING count(*) >= 2 AND (bool_or(row_index = 0 AND contains(c1 || ' ' || c2 || ' ' || c3, '图号')) OR bool_or(row_index BETWEEN 1 AND 5 AND regexp_matches(trim(c1), {NO})))), "
       "picked AS (SELECT 'PRJ-' || ((table_id // 10) % 60) AS project_id, arg_min(table_id, ('S' || table_id % 3 || '.pdf', table_id % 7 + 1, table_id)) AS table_id FROM fit GROUP BY 1), "
       + ROWS + ", prows AS (SELECT n.table_id, CASE WHEN regexp_full_match(r1, '[0-9]+') THEN r1 ELSE '' END AS item_no, CASE WHEN no = '' THEN '未识别' ELSE no END AS drawing_no, "
       "CASE WHEN name <> '' THEN name ELSE coalesce(r2, last, '未识别') END AS drawing_name FROM named n LEFT JOIN rest r ON n.table_id = r.table_id AND n.row_index = r.row_index), "
       "tfirst AS (SELECT s.project_id, min(t.sheet_id) AS sheet_id FROM tcat t JOIN sheets s ON t.sheet_id = s.sheet_id WHERE s.project_id NOT IN (SELECT project_id FROM picked) GROUP BY s.project_id)")

ORACLES = {
    "catalog_row": sql.query("SELECT n.table_id, n.row_index, CASE WHEN regexp_full_match(r1, '[0-9]+') THEN r1 ELSE '' END AS item_no, CASE WHEN no = '' THEN '未识别' ELSE no END AS drawing_no, "
                             "CASE WHEN name <> '' THEN name ELSE coalesce(r2, last, '未识别') END AS drawing_name FROM named n LEFT JOIN rest r ON n.table_id = r.table_id AND n.row_index = r.row_index", sql.TABLES, ROWS),
    "table_type": sql.query("SELECT table_id, coalesce(CASE min(r) " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(fixed.TABLE_TYPES)) + " END, '通用表') AS table_type FROM "
                            f"(SELECT table_id, CAST({sql.case_of('t', [(str(i), ws) for i, (_, ws) in enumerate(fixed.TABLE_TYPES)], 'NULL')} AS INT) AS r FROM "
                            "(SELECT table_id, trim(c1) || ' ' || trim(c2) || ' ' || trim(c3) AS t, row_number() OVER (PARTITION BY table_id ORDER BY row_index) AS rn FROM tables WHERE trim(c1 || c2 || c3) <> '') WHERE rn <= 4) GROUP BY table_id", sql.TABLES),
    "row_cluster": sql.query("SELECT sheet_id, entity_id, CAST(row_y AS DOUBLE) AS row_y FROM rowed", sql.ENT, ANCHORS.format(tol=50), recursive=True),
    "row_cluster_wide": sql.query("SELECT sheet_id, entity_id, CAST(row_y AS DOUBLE) AS row_y FROM rowed", sql.ENT, ANCHORS.format(tol=1200), recursive=True),
    "catalog_extract": sql.query(
        "SELECT project_id, CAST(NULL AS BIGINT) AS sheet_id, item_no, drawing_no, drawing_name, '' AS spec, '' AS note, 'PDF第' || (table_id % 7 + 1) || '页' AS source FROM prows JOIN picked USING (table_id) "
        "UNION ALL SELECT s.project_id, t.sheet_id, item_no, drawing_no, drawing_name, '', '', 'TEXT_TABLE' FROM tcat t JOIN sheets s ON t.sheet_id = s.sheet_id JOIN tfirst f ON f.sheet_id = t.sheet_id "
        "UNION ALL SELECT s.project_id, s.sheet_id, CAST(row_number() OVER (PARTITION BY s.project_id ORDER BY s.sheet_id) AS VARCHAR), coalesce(f.drawing_no, '未识别'), coalesce(f.drawing_name, '未识别'), coalesce(f.scale, ''), '图框识别补建', s.source_file "
        "FROM sheets s LEFT JOIN tfields f ON s.sheet_id = f.sheet_id WHERE s.project_id NOT IN (SELECT project_id FROM picked) AND s.project_id NOT IN (SELECT project_id FROM tfirst)",
        *tq.ZONE_CTES, f"tfields AS ({tq.TITLE_S})", sql.SHEETS, ANCHORS.format(tol=80), TEXTCAT, sql.TABLES.replace("tables AS", "alltables AS", 1), PDF, recursive=True),
    "out_of_catalog": sql.query("SELECT concat('in/建施-', doc_id, '.dxf') AS path, concat('建施-', doc_id) AS base FROM documents WHERE concat('建施-', doc_id) NOT IN (SELECT drawing_no FROM catalog)", sql.CATALOG),
}
