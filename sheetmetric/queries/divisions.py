"""Queries of the construction-division operators."""
from pyspark.sql import functions as F

from sheetmetric.model import adapter, fixed
from sheetmetric.operators import divisions as d
from sheetmetric.queries import sql
from sheetmetric.queries import measure as mq


def entries(spark, sf, keys=()):
    t = mq.takeoff(spark, sf)
    return d.wbs_entries(t.detail, t.lengths, t.areas, keys)


def _length_discipline(spark, sf):
    counts = adapter.layers(spark, sf).groupBy(F.col("name").alias("layer")).agg(F.count("*").alias("n"))
    return counts.withColumn("discipline", d.length_discipline())


def _by_discipline(spark, sf):
    t = mq.takeoff(spark, sf)
    return d.discipline_quantities(t.detail, t.lengths, t.areas)


QUERIES = {
    "wbs_map": lambda s, f: entries(s, f, ("sheet_id",)).select("sheet_id", "label", "quantity", "unit", "division", "sub_division", "item"),
    "wbs_length_discipline": _length_discipline,
    "wbs_tree": lambda s, f: d.wbs_tree(entries(s, f, ("sheet_id",))),
    "label_chain": lambda s, f: d.label_chains(entries(s, f)),
    "sheet_label_chain": lambda s, f: d.label_chains(entries(s, f, ("sheet_id",)), ("sheet_id",)),
    "anchors_sample": lambda s, f: d.anchors_sample(entries(s, f, ("sheet_id",)), keys=("sheet_id",)).withColumn("rank", F.col("rank").cast("long")),
    "discipline_quantities": _by_discipline,
}

LDISC = "CASE WHEN regexp_matches(upper(layer), 'PIPE|WATER|DRAIN') THEN '给排水' WHEN regexp_matches(upper(layer), 'DUCT|HVAC') THEN '暖通' WHEN regexp_matches(upper(layer), 'CABLE|WIRE|ELEC') THEN '电气' ELSE '其他' END"
BDISC = sql.case_of("upper(layer)", fixed.LAYER_KEYWORDS, "''")
DIVS = sql.values("divs", "dprio, division, sub_division", [(i, n, s) for i, (n, s, _) in enumerate(fixed.DIVISIONS)])
CAND = sql.values("cand", "discipline, cprio, division", [(k, i, v) for k, vs in fixed.DISCIPLINE_DIVISIONS.items() for i, v in enumerate(vs)]
                  + [(x, i, n) for x in ("", "其他") for i, (n, _, _) in enumerate(fixed.DIVISIONS)])
ITEMS = sql.values("items", "division, iprio, item, kw", [(n, i, it, w) for n, _, its in fixed.DIVISIONS for i, (it, ws) in enumerate(its) for w in ws])


def entries_sql(per_sheet):
    k = "sheet_id, " if per_sheet else ""
    blocks = (f"SELECT {k}block_name AS name, block_name AS label, CAST(count(*) AS DOUBLE) AS quantity, '个' AS unit, arg_min(layer, (seq, entity_id)) AS layer, 0 AS kind FROM detail GROUP BY {k}block_name")
    lengths = (f"SELECT sheet_id, layer, total_length_m AS q FROM lengths" if per_sheet else "SELECT layer, q FROM mlen")
    areas = (f"SELECT sheet_id, layer, total_area_m2 AS q FROM areas" if per_sheet else "SELECT layer, q FROM marea")
    raw = (f"rawentries AS MATERIALIZED (SELECT *, {BDISC} AS discipline FROM ({blocks}) UNION ALL SELECT {k}layer, '管线(' || layer || ')', q, 'm', layer, 1, {LDISC} FROM ({lengths}) "
           f"UNION ALL SELECT {k}layer, '面积(' || layer || ')', q, 'm²', layer, 2, '建筑' FROM ({areas}))")
    # each distinct name of a discipline meets the keywords once
    best = ("wbest AS MATERIALIZED (SELECT discipline, name, i.division, item FROM (SELECT DISTINCT discipline, name FROM rawentries) r JOIN cand c USING (discipline) JOIN items i ON i.division = c.division AND contains(r.name, i.kw) "
            "QUALIFY row_number() OVER (PARTITION BY discipline, name ORDER BY cprio, iprio) = 1)")
    final = (f"entries AS MATERIALIZED (SELECT r.*, v.division, v.sub_division, coalesce(b.item, '{fixed.NO_ITEM}') AS item FROM rawentries r LEFT JOIN wbest b ON r.discipline = b.discipline AND r.name = b.name "
             "JOIN cand c ON c.discipline = r.discipline AND c.cprio = 0 JOIN divs v ON v.division = coalesce(b.division, c.division))")
    return [*mq.TAKEOFF_CTES, mq.MLEN, mq.MAREA, DIVS, CAND, ITEMS, raw, best, final]


REG = sql.values("reg", "code, name, unit_work, standard", fixed.DISCIPLINE_REGISTRY)


def chain_sql(per_sheet):
    k = "sheet_id, division, sub_division, item" if per_sheet else "division, sub_division, item"
    return (f"SELECT {k}, entries, coalesce(r.code, 'UNKNOWN') AS discipline_code, dn AS discipline_name, coalesce(r.unit_work, '未分类工程') AS unit_work, coalesce(r.standard, 'GB50300') AS acceptance_standard, c AS discipline_confidence, "
            f"CASE WHEN item <> '{fixed.NO_ITEM}' THEN c ELSE 0.5::DOUBLE END AS item_confidence, CASE WHEN item <> '{fixed.NO_ITEM}' THEN c ELSE least(c, 0.5::DOUBLE) END AS confidence, "
            "'RULE:GB50300#' || division || '/' || sub_division || '/' || item || '；' || layers AS evidence FROM (SELECT *, CASE WHEN dn = '未识别' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS c FROM "
            f"(SELECT {k}, entries, coalesce(dname, '未识别') AS dn, layers FROM (SELECT {k}, count(*) AS entries FROM entries GROUP BY ALL) JOIN "
            f"(SELECT {k}, string_agg('LAYER:' || layer || ':' || n || ' 项', '；' ORDER BY layer) AS layers FROM (SELECT * FROM (SELECT {k}, layer, count(*) AS n FROM entries GROUP BY ALL)) GROUP BY ALL) USING ({k}) "
            f"LEFT JOIN (SELECT {k}, dname FROM (SELECT * FROM (SELECT {k}, {BDISC} AS dname, count(*) AS n, min((kind, label)) AS f FROM entries GROUP BY ALL)) WHERE dname <> '' QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY n DESC, f) = 1) USING ({k}))) LEFT JOIN reg r ON r.name = dn")


ORACLES = {
    "wbs_map": sql.query("SELECT sheet_id, label, quantity, unit, division, sub_division, item FROM entries", *entries_sql(True)),
    "wbs_length_discipline": sql.query(f"SELECT layer, count(*) AS n, {LDISC} AS discipline FROM (SELECT name AS layer FROM layers) GROUP BY layer", sql.LAYERS),
    "wbs_tree": sql.query("SELECT division, sub_division, item, count(*) AS entries FROM entries GROUP BY ALL", *entries_sql(True)),
    "label_chain": sql.query(chain_sql(False), *entries_sql(False), REG),
    "sheet_label_chain": sql.query(chain_sql(True), *entries_sql(True), REG),
    "anchors_sample": sql.query("SELECT sheet_id, division, sub_division, item, rank, label, unit, quantity FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, division, sub_division, item ORDER BY kind, label) AS rank FROM entries) WHERE rank <= 10", *entries_sql(True)),
    "discipline_quantities": sql.query(f"SELECT discipline, count(*) AS block_types, CAST(sum(n) AS BIGINT) AS block_total, (SELECT count(DISTINCT layer) FROM lengths) AS length_layers, (SELECT count(DISTINCT layer) FROM areas) AS area_layers FROM "
                                       f"(SELECT n, coalesce(nullif({BDISC}, ''), '其他') AS discipline FROM (SELECT block_name, count(*) AS n, arg_min(layer, (seq, entity_id)) AS layer FROM detail GROUP BY block_name)) GROUP BY discipline", *mq.TAKEOFF_CTES),
}
