"""Queries of the spatial operators."""
from pyspark.sql import functions as F

from sheetmetric.model import adapter, fixed
from sheetmetric.operators import spatial as sp
from sheetmetric.queries import sql
from sheetmetric.queries.classify import category_case

CLASH_A, CLASH_B = ["风管", "DUCT", "给水", "排水", "PIPE"], ["梁", "BEAM", "柱", "COLUMN"]


def _relation(name):
    def run(spark, sf):
        return sp.topology(adapter.entities(spark, sf), relations=[name]).select("src", "dst", F.col("rank").cast("long").alias("rank"), "dist")
    return run


def _nearest_k(spark, sf):
    edges, _ = sp.topology_ranks(adapter.entities(spark, sf))
    return edges.groupBy("relation", F.col("rank").cast("long").alias("rank")).agg(F.count("*").alias("n"))


QUERIES = {
    "cross_layer_proximity": lambda s, d: sp.cross_layer_proximity(adapter.entities(s, d)),
    "top_pairs_per_layer_pair": lambda s, d: sp.top_pairs_per_layer_pair(adapter.entities(s, d)),
    "top_layer_pairs": lambda s, d: sp.top_layer_pairs(sp.cross_layer_proximity(adapter.entities(s, d))).withColumn("rank", F.col("rank").cast("long")),
    "legend_entries": lambda s, d: sp.legend_entries(adapter.entities(s, d)),
    "dedup_legend": lambda s, d: sp.legend_entries(adapter.entities(s, d)).groupBy("sheet_id").agg(F.count("*").alias("entry_count")),
    "nearby_text": lambda s, d: sp.nearby_text(adapter.entities(s, d)),
    "topology_connected": _relation("CONNECTED"),
    "topology_near": _relation("NEAR"),
    "nearest_k": _nearest_k,
    "bbox_clash": lambda s, d: sp.bbox_clash(adapter.entities(s, d), CLASH_A, CLASH_B),
    "pair_distance": lambda s, d: sp.pair_distance(adapter.entities(s, d), ["PIPE", "LIGHT"], ["BEAM", "COLUMN"], 2000.0),
}

POINTS = "pts AS (SELECT sheet_id, layer, x0, y0, entity_id FROM ent WHERE dxf_type = 'INSERT' OR (dxf_type = 'TEXT' AND trim(label_text) <> ''))"
PAIRS = ("pairs AS (SELECT a.sheet_id, a.layer AS layer_a, b.layer AS layer_b, a.entity_id AS entity_a, b.entity_id AS entity_b, sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)) AS dist "
         "FROM pts a JOIN pts b ON a.sheet_id = b.sheet_id AND a.layer < b.layer WHERE (a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) <= 9000000)")
LEGEND = ("ltext AS (SELECT DISTINCT sheet_id, trim(label_text) AS text, x0, y0 FROM ent WHERE dxf_type = 'TEXT' AND label_text <> ''), "
          f"legend AS (SELECT DISTINCT b.sheet_id, b.text, b.x0, b.y0 FROM ltext b JOIN ltext a ON a.sheet_id = b.sheet_id AND {sql.any_of('upper(a.text)', fixed.LEGEND_TITLES)} "
          "AND abs(b.x0 - a.x0) < 8000 AND b.y0 - a.y0 > -6000 AND b.y0 - a.y0 < 500 AND upper(a.text) <> upper(b.text))")
NEARTEXT = ("neartext AS (SELECT e.entity_id, t.label_text, count(*) AS n, min(t.seq) AS f FROM ent e JOIN ent t ON e.sheet_id = t.sheet_id AND t.dxf_type = 'TEXT' AND t.label_text <> '' "
            "WHERE (e.x0 - t.x0) * (e.x0 - t.x0) + (e.y0 - t.y0) * (e.y0 - t.y0) <= 64000000 GROUP BY ALL)")
CATS = (f"ecat AS MATERIALIZED (SELECT *, coalesce({category_case('block_name')}, {category_case('label_text')}, {category_case('layer')}, 'UNKNOWN') AS category FROM ent)")
TOPO = ("cand AS (SELECT * FROM ecat WHERE category NOT IN ('TEXT', 'DIMENSION', 'AXIS', 'UNKNOWN') AND dxf_type <> 'HATCH'), "
        "ends AS (SELECT sheet_id, entity_id, x0 AS x, y0 AS y FROM cand WHERE dxf_type IN ('LINE', 'LWPOLYLINE') UNION ALL "
        "SELECT sheet_id, entity_id, CASE WHEN dxf_type = 'LINE' THEN x0 + w ELSE x0 END, CASE WHEN dxf_type = 'LINE' THEN y0 ELSE y0 + h END FROM cand WHERE dxf_type IN ('LINE', 'LWPOLYLINE')), "
        "targets AS (SELECT * FROM ends UNION ALL SELECT sheet_id, entity_id, x0, y0 FROM cand WHERE dxf_type IN ('INSERT', 'CIRCLE', 'ARC')), "
        "conn AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (SELECT a.entity_id AS src, b.entity_id AS dst, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS dist "
        "FROM ends a JOIN targets b ON a.sheet_id = b.sheet_id AND a.entity_id <> b.entity_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9000000 GROUP BY ALL) QUALIFY rank <= 15), "
        "rest AS (SELECT sheet_id, entity_id, x0 AS x, y0 AS y FROM cand WHERE entity_id NOT IN (SELECT src FROM conn)), "
        "near AS (SELECT a.entity_id AS src, b.entity_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, "
        "row_number() OVER (PARTITION BY a.entity_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.entity_id) AS rank FROM rest a JOIN rest b ON a.sheet_id = b.sheet_id AND a.entity_id <> b.entity_id "
        "WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9000000 QUALIFY rank <= 10)")
TOPO_CTES = [sql.ENT, CATS, TOPO]


def clash_sql(a_words, b_words):
    u = "upper({}.layer || ' ' || coalesce({}.block_name, ''))"
    return (f"SELECT a.sheet_id, a.entity_id, arg_min(b.entity_id, (b.seq, b.entity_id)) AS partner FROM boxes a JOIN boxes b ON a.sheet_id = b.sheet_id AND {sql.any_of(u.format('a', 'a'), a_words)} AND {sql.any_of(u.format('b', 'b'), b_words)} "
            "AND a.dxf_type <> 'HATCH' AND b.dxf_type <> 'HATCH' AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin GROUP BY ALL")


def distance_sql(a_words, b_words, threshold):
    return (f"SELECT a.sheet_id, a.entity_id, arg_min(b.entity_id, (b.seq, b.entity_id)) AS partner FROM ent a JOIN ent b ON a.sheet_id = b.sheet_id AND {sql.any_of('upper(a.layer)', a_words)} AND {sql.any_of('upper(b.layer)', b_words)} "
            f"AND a.dxf_type <> 'HATCH' AND b.dxf_type <> 'HATCH' AND sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)) < {threshold} GROUP BY ALL")


ORACLES = {
    "cross_layer_proximity": sql.query("SELECT sheet_id, layer_a, layer_b, count(*) AS pair_count FROM pairs GROUP BY ALL", sql.ENT, POINTS, PAIRS),
    "top_pairs_per_layer_pair": sql.query("SELECT sheet_id, layer_a, layer_b, entity_a, entity_b, dist, row_number() OVER (PARTITION BY sheet_id, layer_a, layer_b ORDER BY dist, entity_a, entity_b) AS rank FROM pairs QUALIFY rank <= 10", sql.ENT, POINTS, PAIRS),
    "top_layer_pairs": sql.query("SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY pair_count DESC, layer_a, layer_b) AS rank FROM (SELECT sheet_id, layer_a, layer_b, count(*) AS pair_count FROM pairs GROUP BY ALL) QUALIFY rank <= 30", sql.ENT, POINTS, PAIRS),
    "legend_entries": sql.query("SELECT sheet_id, text, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y FROM legend", sql.ENT, LEGEND),
    "dedup_legend": sql.query("SELECT sheet_id, count(*) AS entry_count FROM legend GROUP BY sheet_id", sql.ENT, LEGEND),
    "nearby_text": sql.query("SELECT entity_id, CAST(sum(n) AS BIGINT) AS n_texts, string_agg(label_text, ' ' ORDER BY f, label_text) AS nearby_text FROM neartext GROUP BY entity_id", sql.ENT, NEARTEXT),
    "topology_connected": sql.query("SELECT src, dst, rank, dist FROM conn", *TOPO_CTES),
    "topology_near": sql.query("SELECT src, dst, rank, dist FROM near", *TOPO_CTES),
    "nearest_k": sql.query("SELECT relation, rank, count(*) AS n FROM (SELECT 'CONNECTED' AS relation, rank FROM conn UNION ALL SELECT 'NEAR', rank FROM near) GROUP BY ALL", *TOPO_CTES),
    "bbox_clash": sql.query(clash_sql(CLASH_A, CLASH_B), sql.ENT, sql.BOXES),
    "pair_distance": sql.query(distance_sql(["PIPE", "LIGHT"], ["BEAM", "COLUMN"], 2000), sql.ENT),
}
