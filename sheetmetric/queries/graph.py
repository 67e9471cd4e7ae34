"""Queries of the graph operators."""
import re
import uuid

from pyspark.sql import functions as F

from sheetmetric.functions.text import expand_keyword, token_match_sql
from sheetmetric.model import adapter, fixed
from sheetmetric.operators import graph as g
from sheetmetric.operators.places import place_graph
from sheetmetric.queries import sql
from sheetmetric.queries import spatial as sq
from sheetmetric.queries.classify import SUB_ALL, SUB_OWN, category_case
from sheetmetric.session import scratch, shared_folder


def nodes(spark, sf, physical=None):
    return g.graph_nodes(adapter.entities(spark, sf), adapter.sheets(spark, sf), physical)


def physical(spark, sf, listed=False):
    return place_graph(adapter.entities(spark, sf), listed=listed)


def edges(spark, sf, places=None):
    return g.graph_edges(adapter.entities(spark, sf), adapter.sheets(spark, sf), places or physical(spark, sf))


def _khop(spark, sf):
    return g.graph_khop(g.graph_find(nodes(spark, sf), "灯具", ["Component"]), physical(spark, sf, listed=True))


def _connected(spark, sf):
    return g.graph_connected_query(nodes(spark, sf), physical(spark, sf, listed=True), "灯具", "门")


def _io(spark, sf):
    """Nodes and edges written to the shared folder and read back, all columns of both."""
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4()}"
    with scratch(spark):
        places = physical(spark, sf, listed=True)
        g.save_graph(nodes(spark, sf, places), edges(spark, sf, places), path)
    read_nodes, read_edges = g.load_graph(spark, path)
    return read_nodes.unionByName(read_edges, allowMissingColumns=True)


WORDS = ["LIGHT", "PANEL", "SWITCH", "DN100", "M10", "板", "平面图", "YJV"]


def _token_match(spark, sf):
    """Words in every text of the entities: labels, block names and layers, each distinct text tested once."""
    texts = adapter.entities(spark, sf).selectExpr("explode(array_compact(array(label_text, block_name, layer))) AS text").groupBy("text").agg(F.count("*").alias("n"))
    flags = ", ".join(f"CASE WHEN {token_match_sql('text', [w])} THEN '{w}' END" for w in WORDS)
    return texts.selectExpr("text", "n", f"array_join(array_compact(array({flags})), '|') AS words")


def _expand(spark, sf):
    names = adapter.catalog(spark, sf).groupBy("drawing_name").agg(F.count("*").alias("n"))
    return names.selectExpr("drawing_name", "n", f"array_join({g.expand_keywords_sql('drawing_name')}, '|') AS words")


QUERIES = {
    "graph_nodes": lambda s, d: nodes(s, d, physical(s, d)),
    "graph_edges": edges,
    "graph_find": lambda s, d: g.graph_find(nodes(s, d), "灯具").select("node_id", "sheet_id", "node_type"),
    "graph_count": lambda s, d: g.graph_count(nodes(s, d), "管道"),
    "graph_khop": _khop,
    "graph_connected_query": _connected,
    "graph_io": _io,
    "graph_stats": lambda s, d: g.graph_stats(adapter.entities(s, d), adapter.sheets(s, d), physical(s, d)),
    "token_match": _token_match,
    "keyword_expand": _expand,
}

CATS = (f"ecat AS MATERIALIZED (SELECT *, coalesce(own, by_layer, 'UNKNOWN') AS category, CASE WHEN own IS NOT NULL THEN {SUB_OWN} WHEN by_layer IS NOT NULL THEN {SUB_ALL} END AS sub_category FROM "
        f"(SELECT *, coalesce({category_case('block_name')}, {category_case('label_text')}) AS own, {category_case('layer')} AS by_layer FROM ent))")
ATTR = ("attr AS (SELECT sheet_id, entity_id, 'SPEC' AS key, attr_spec AS value FROM ent WHERE trim(attr_spec) <> '' UNION ALL SELECT sheet_id, entity_id, 'ROOM', attr_room FROM ent WHERE trim(attr_room) <> '')")
N = "CAST(NULL AS VARCHAR)"
NODES = (f"nodes AS (SELECT DISTINCT project_id AS node_id, CAST(NULL AS BIGINT) AS sheet_id, 'Project' AS node_type, {N} AS name, {N} AS category, {N} AS sub_category, {N} AS layer, {N} AS block_name, {N} AS label, {N} AS key, {N} AS value FROM sheets "
         f"UNION ALL SELECT 'DRAWING::' || source_file, sheet_id, 'Drawing', source_file, {N}, {N}, {N}, {N}, {N}, {N}, {N} FROM sheets "
         f"UNION ALL SELECT DISTINCT 'LAYER::' || source_file || '::' || layer, sheet_id, 'Layer', layer, {N}, {N}, {N}, {N}, {N}, {N}, {N} FROM ent JOIN sheets USING (sheet_id) "
         f"UNION ALL SELECT entity_id, sheet_id, 'Component', {N}, category, sub_category, layer, block_name, coalesce(nullif(label_text, ''), nullif(block_name, ''), category), {N}, {N} FROM ecat "
         f"UNION ALL SELECT 'ATTR::' || entity_id || '::' || key, sheet_id, 'Attribute', {N}, {N}, {N}, {N}, {N}, {N}, key, value FROM attr)")
# every link of entities (no list is cut), and the places it comes from
LINKS = sq.TOPO.replace(" QUALIFY rank <= 15", "").replace(" QUALIFY rank <= 10", "")
assert "QUALIFY" not in LINKS
TOPOLOGY = "topo AS MATERIALIZED (SELECT src, dst, 'CONNECTED' AS relation FROM conn UNION ALL SELECT src, dst, 'NEAR' FROM near)"
PLACES = ("member AS MATERIALIZED (SELECT DISTINCT entity_id, sheet_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, 'ENDS_AT' AS role FROM ends UNION ALL "
          "SELECT entity_id, sheet_id, CAST(x0 AS DOUBLE), CAST(y0 AS DOUBLE), 'STANDS_AT' FROM cand WHERE dxf_type IN ('INSERT', 'CIRCLE', 'ARC') UNION ALL "
          "SELECT entity_id, sheet_id, CAST(x AS DOUBLE), CAST(y AS DOUBLE), 'FREE_AT' FROM rest), "
          "spot AS MATERIALIZED (SELECT DISTINCT sheet_id, x, y, role, 'PLACE::' || sheet_id || '::' || x || '::' || y AS id FROM member), "
          "spots AS MATERIALIZED (SELECT DISTINCT a.id AS src, b.id AS dst, CASE a.role WHEN 'FREE_AT' THEN 'NEAR' ELSE 'CONNECTED' END AS relation FROM spot a JOIN spot b ON a.sheet_id = b.sheet_id "
          "AND ((a.role = 'ENDS_AT' AND b.role <> 'FREE_AT') OR (a.role = 'FREE_AT' AND b.role = 'FREE_AT')) WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9000000)")
EDGES = ("edges AS (SELECT project_id AS src, 'DRAWING::' || source_file AS dst, 'CONTAINS' AS relation FROM sheets UNION ALL SELECT DISTINCT 'DRAWING::' || source_file, 'LAYER::' || source_file || '::' || layer, 'HAS_LAYER' FROM ent JOIN sheets USING (sheet_id) "
         "UNION ALL SELECT entity_id, 'LAYER::' || source_file || '::' || layer, 'LOCATED_IN' FROM ent JOIN sheets USING (sheet_id) UNION ALL SELECT entity_id, 'DRAWING::' || source_file, 'BELONGS_TO' FROM ent JOIN sheets USING (sheet_id) "
         "UNION ALL SELECT entity_id, 'ATTR::' || entity_id || '::' || key, 'HAS_ATTRIBUTE' FROM attr "
         "UNION ALL SELECT entity_id, 'PLACE::' || sheet_id || '::' || x || '::' || y, role FROM member UNION ALL SELECT * FROM spots)")
ALL_NODES = f"all_nodes AS (SELECT * FROM nodes UNION ALL SELECT DISTINCT id, sheet_id, 'Place', {N}, {N}, {N}, {N}, {N}, {N}, {N}, {N} FROM spot)"
BASE = [sql.ENT, sql.SHEETS, CATS, ATTR, NODES]
FULL = [*BASE, LINKS, TOPOLOGY, PLACES, ALL_NODES, EDGES]


def token_sql(col, words):
    return "(" + " OR ".join(f"contains(upper({col}), {sql.lit(w.upper())})" if any("一" <= c <= "鿿" for c in w)
                             else f"regexp_matches(upper({col}), {sql.lit('(^|[^A-Z0-9])' + re.escape(w.upper()) + '([^A-Z0-9]|$)')})" for w in words) + ")"


STRICT = "concat_ws(' ', coalesce(block_name, ''), coalesce(category, ''), coalesce(sub_category, ''), coalesce(name, ''), coalesce(key, ''))"
FREE = "concat_ws(' ', coalesce(label, ''), coalesce(value, ''))"


def find_sql(keyword, types=""):
    words = expand_keyword(keyword)
    return (f"SELECT * FROM (SELECT *, bool_or(strict) OVER (PARTITION BY sheet_id) AS any_strict FROM (SELECT *, {token_sql(STRICT, words)} AS strict, {token_sql(FREE, words)} AS free FROM nodes WHERE sheet_id IS NOT NULL {types}) WHERE strict OR free) WHERE strict = any_strict")


REACH = (f"anchors AS ({find_sql('灯具', chr(65) + 'ND node_type = ' + sql.lit('Component'))}), "
         "links AS MATERIALIZED (SELECT a, b, arg_min(relation, back) AS relation FROM (SELECT src AS a, dst AS b, relation, 0 AS back FROM topo UNION ALL SELECT dst, src, relation, 1 FROM topo) GROUP BY a, b), "
         "walk AS (SELECT node_id AS anchor, node_id AS node, 0 AS hop FROM anchors UNION SELECT anchor, b, hop + 1 FROM walk JOIN links ON a = node WHERE hop < 3), "
         "shortest AS (SELECT anchor, node, min(hop) AS hop FROM walk GROUP BY ALL), "
         "reach AS (SELECT s.anchor, s.node, CAST(s.hop AS BIGINT) AS hop, min(l.relation) AS relation FROM shortest s JOIN shortest p ON p.anchor = s.anchor AND p.hop = s.hop - 1 JOIN links l ON l.a = p.node AND l.b = s.node GROUP BY ALL)")
SYN = sql.values("syn", "i, j, k, term", [(i, j, k, t) for i, (k, ts) in enumerate(fixed.SYNONYMS) for j, t in enumerate(ts)])
TARGET = "concat_ws(' ', coalesce(block_name, ''), coalesce(category, ''), coalesce(sub_category, ''), coalesce(name, ''))"
ORACLES = {
    "graph_nodes": sql.query("SELECT * FROM all_nodes", *FULL),
    "graph_edges": sql.query("SELECT * FROM edges", *FULL),
    "graph_find": sql.query(f"SELECT node_id, sheet_id, node_type FROM ({find_sql('灯具')})", *BASE),
    "graph_count": sql.query(f"SELECT sheet_id, category, count(*) AS n FROM ({find_sql('管道', chr(65) + 'ND node_type = ' + sql.lit('Component'))}) GROUP BY ALL", *BASE),
    "graph_khop": sql.query("SELECT * FROM reach", *FULL, REACH, recursive=True),
    "graph_connected_query": sql.query(f"SELECT anchor AS anchor_id, node AS target_id, label AS target, hop AS hops, relation AS edge_type FROM reach JOIN nodes ON node = node_id WHERE {token_sql(TARGET, expand_keyword('门'))}", *FULL, REACH, recursive=True),
    "graph_io": sql.query("SELECT * FROM all_nodes UNION ALL BY NAME SELECT * FROM edges", *FULL),
    "graph_stats": sql.query("SELECT 'total_nodes' AS metric, '' AS item, count(*) AS n FROM all_nodes UNION ALL SELECT 'total_edges', '', count(*) FROM edges UNION ALL SELECT 'node_type', node_type, count(*) FROM all_nodes GROUP BY node_type "
                             "UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY relation UNION ALL SELECT * FROM (SELECT 'category', category, count(*) AS n FROM all_nodes WHERE node_type = 'Component' GROUP BY category ORDER BY n DESC, category LIMIT 15)", *FULL),
    "token_match": sql.query("SELECT text, count(*) AS n, concat_ws('|', " + ", ".join(f"CASE WHEN {token_sql('text', [w])} THEN '{w}' END" for w in WORDS) + ") AS words FROM (SELECT label_text AS text FROM ent UNION ALL SELECT block_name FROM ent UNION ALL SELECT layer FROM ent) WHERE text IS NOT NULL GROUP BY text", sql.ENT),
    "keyword_expand": sql.query("SELECT drawing_name, n, string_agg(term, '|' ORDER BY o) AS words FROM (SELECT drawing_name, n, min((i, j)) AS o, arg_min(term, (i, j)) AS term FROM (SELECT drawing_name, n, -1 AS i, 0 AS j, drawing_name AS term FROM names "
                                "UNION ALL SELECT drawing_name, n, i, j, term FROM names JOIN syn ON contains(drawing_name, k)) GROUP BY drawing_name, n, upper(term)) GROUP BY ALL", sql.CATALOG, "names AS (SELECT drawing_name, count(*) AS n FROM catalog GROUP BY drawing_name)", SYN),
}
