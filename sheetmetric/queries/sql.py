"""Building blocks of the reference SQL (run by DuckDB on the same Parquet tables)."""
from __future__ import annotations

from sheetmetric.model import adapter, fixed


def select(exprs: dict, source: str) -> str:
    return "SELECT " + ", ".join(f'{sql} AS "{name}"' for name, sql in exprs.items()) + f" FROM {source}"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def case_of(col: str, groups, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(col, [w.upper() for w in ws])} THEN {lit(k)}" for k, ws in groups) + f" ELSE {default} END"


def rnd(expr: str, places: int) -> str:
    """Half up, once, on the shortest decimal form of a double."""
    return f"CAST(CAST(CAST(CAST({expr} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,{places})) AS DOUBLE)"


def norm(col: str) -> str:
    return f"upper(trim(coalesce({col}, '')))"


def values(name: str, cols: str, rows) -> str:
    """CTE with literal rows."""
    def one(v):
        if v is None:
            return "NULL"
        return lit(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"{name}({cols}) AS (VALUES {body})"


ROLE = case_of(norm("layer"), fixed.ROLE_KEYWORDS, "'UNKNOWN'")
ENT = "ent AS (" + select(adapter.ENTITY_EXPRS, "lineitem JOIN orders ON l_orderkey = o_orderkey") + ")"
ENTR = f"entr AS (SELECT *, {ROLE} AS role FROM ent)"
SHEETS = "sheets AS (" + select(adapter.SHEET_EXPRS, "customer") + ")"
LAYERS = ("layers AS (SELECT c_custkey AS sheet_id, CAST(pos AS BIGINT) AS pos, name, CAST(pos % 7 + 1 AS BIGINT) AS color, "
          "(c_custkey + pos) % 7 = 0 AS is_off, (c_custkey + pos) % 11 = 0 AS is_frozen, (c_custkey + pos) % 13 = 0 AS is_locked "
          "FROM customer, (VALUES " + ", ".join(f"({i}, {lit(n)})" for i, n in enumerate(adapter.LAYER_NAMES)) + ") t(pos, name))")
BLOCKDEFS = ("blockdefs AS (SELECT c_custkey AS sheet_id, CAST(pos AS BIGINT) AS pos, block_name FROM customer, (VALUES "
             + ", ".join(f"({i}, {lit(n)})" for i, n in enumerate(adapter.BLOCK_NAMES)) + ") t(pos, block_name))")
CATALOG = "catalog AS (" + select(adapter.CATALOG_EXPRS, "orders") + ")"
PRIMS = "prims AS (" + select(adapter.PRIMITIVE_EXPRS, "lineitem") + ")"
PAGES = ("pdfpages AS (SELECT DISTINCT concat('F', CAST(l_suppkey AS STRING), '.pdf') AS file, CAST(l_linenumber AS BIGINT) AS page, "
         "concat(' ', repeat('x', CAST((l_suppkey * 7 + l_linenumber * 13) % 60 AS INT)), ' ') AS text FROM lineitem)")
TABLES = "tables AS (SELECT table_id, row_index, c1, c2, c3 FROM (" + select(adapter.TABLE_EXPRS, "part") + "))"
FILES = "files AS (" + select(adapter.FILE_EXPRS, "documents") + ")"
MANIFEST = (f"manifest AS (SELECT {adapter.FILE_EXPRS['path']} AS path, n_chars * 10000 + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS size_bytes, "
            "doc_id * 3600 AS mtime, doc_id % 6 <> 0 AS outputs_exist FROM documents WHERE doc_id % 2 = 0)")

LENGTH = ("CASE dxf_type WHEN 'LINE' THEN CAST(w AS DOUBLE) WHEN 'LWPOLYLINE' THEN CAST(w + h + w + CASE WHEN closed THEN h ELSE 0 END AS DOUBLE) "
          "WHEN 'ARC' THEN radians(90.0) * r WHEN 'CIRCLE' THEN 2.0 * pi() * r END")
AREA = "CASE WHEN dxf_type = 'HATCH' OR (dxf_type = 'LWPOLYLINE' AND closed) THEN CAST(w * h AS DOUBLE) ELSE 0.0 END"
# box of an entity in the interchange form: texts are points
XMIN = "CASE WHEN dxf_type IN ('CIRCLE', 'ARC') THEN x0 - r ELSE x0 END"
YMIN = "CASE WHEN dxf_type IN ('CIRCLE', 'ARC') THEN y0 - r ELSE y0 END"
XMAX = "CASE WHEN dxf_type IN ('CIRCLE', 'ARC') THEN x0 + r WHEN dxf_type IN ('LINE', 'LWPOLYLINE', 'HATCH') THEN x0 + w ELSE x0 END"
YMAX = "CASE WHEN dxf_type IN ('CIRCLE', 'ARC') THEN y0 + r WHEN dxf_type IN ('LWPOLYLINE', 'HATCH') THEN y0 + h ELSE y0 END"
BOXES = f"boxes AS (SELECT *, {XMIN} AS xmin, {YMIN} AS ymin, {XMAX} AS xmax, {YMAX} AS ymax FROM ent)"


def query(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body}" if ctes else body


def block_refs(keep):
    """References per block with layers, attributed ones and the first attribute sets, as CTEs over ent."""
    attributed = "(attr_spec IS NOT NULL OR attr_room IS NOT NULL)"
    return (f"attrsets AS (SELECT sheet_id, block_name, concat_ws('；', 'ROOM=' || attr_room, 'SPEC=' || attr_spec) AS one, concat_ws('；', CASE WHEN attr_room IS NOT NULL THEN 'ROOM' END, CASE WHEN attr_spec IS NOT NULL THEN 'SPEC' END) AS keys, "
            f"row_number() OVER (PARTITION BY sheet_id, block_name ORDER BY seq, entity_id) AS i FROM ent WHERE dxf_type = 'INSERT' AND {attributed}), "
            "samples AS (SELECT sheet_id, block_name, max(keys) FILTER (WHERE i = 1) AS attribute_keys, string_agg(one, ' | ' ORDER BY i) AS attribute_samples FROM attrsets "
            f"WHERE i <= {keep} GROUP BY ALL), "
            "refs AS (SELECT sheet_id, block_name, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_layers, CAST(sum(wa) AS BIGINT) AS with_attribs, string_agg(layer || '×' || k, '；' ORDER BY layer) AS layers, "
            "coalesce(any_value(attribute_keys), '') AS attribute_keys, coalesce(any_value(attribute_samples), '') AS attribute_samples "
            f"FROM (SELECT sheet_id, block_name, layer, count(*) AS k, count(*) FILTER (WHERE {attributed}) AS wa FROM ent WHERE dxf_type = 'INSERT' GROUP BY ALL) LEFT JOIN samples USING (sheet_id, block_name) GROUP BY sheet_id, block_name)")
