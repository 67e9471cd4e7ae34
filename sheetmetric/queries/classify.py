"""Queries of the classification operators."""
import re
import uuid

from pyspark.sql import functions as F

from sheetmetric.functions.text import norm_sql
from sheetmetric.model import adapter, fixed
from sheetmetric.operators import classify as c
from sheetmetric.queries import sql
from sheetmetric.session import shared_folder
from sheetmetric.sources import packs


def _layer_counts(spark, sf):
    return adapter.entities(spark, sf).groupBy("layer").agg(F.count("*").alias("n"))


def sources(spark, sf):
    return c.vote_sources(adapter.entities(spark, sf), adapter.layers(spark, sf), adapter.block_definitions(spark, sf))


def _loaded_dictionaries(spark, sf):
    """Dictionaries written to a file and loaded from it, with the entities that each keyword meets."""
    path = f"{shared_folder(spark)}/dictionaries-{uuid.uuid4()}"
    packs.save_dictionaries(spark, c.DICTIONARIES, path)
    return c.keyword_usage(_layer_counts(spark, sf), packs.load_dictionaries(spark, path))


def classified(spark, sf):
    return c.classify_sheets(adapter.catalog(spark, sf))


def vote_codes(spark, sf):
    return c.discipline_vote_codes(sources(spark, sf), adapter.layers(spark, sf), adapter.sheets(spark, sf))


def project_disciplines(spark, sf):
    sheets = adapter.sheets(spark, sf)
    names = classified(spark, sf).join(sheets.select("sheet_id", "project_id"), "sheet_id").select("project_id", "discipline").distinct()
    return c.detected_disciplines(names, sheets.select("project_id", F.col("discipline").alias("code")).distinct())


def _norm(spark, sf):
    texts = adapter.entities(spark, sf).where("dxf_type = 'TEXT'")
    return texts.groupBy(F.expr(norm_sql("label_text")).alias("text")).agg(F.count("*").alias("n"))


def _sub(spark, sf):
    return c.category_counts(adapter.entities(spark, sf)).groupBy("category", "sub_category").agg(F.sum("n").alias("n"))


QUERIES = {
    "norm": _norm,
    "layer_discipline": lambda s, d: _layer_counts(s, d).withColumn("discipline", c.layer_discipline()),
    "drawing_no_discipline": lambda s, d: adapter.catalog(s, d).select("row_id", c.drawing_no_discipline().alias("discipline")),
    "drawing_name_discipline": lambda s, d: adapter.catalog(s, d).select("row_id", c.drawing_name_discipline().alias("discipline")),
    "classify_sheet": lambda s, d: classified(s, d).select("row_id", "discipline", "confidence"),
    "sheet_discipline_stats": lambda s, d: c.sheet_discipline_stats(classified(s, d)),
    "layer_prefix_discipline": lambda s, d: c.layer_prefix_discipline(adapter.layers(s, d)),
    "drawing_type": lambda s, d: c.drawing_type(adapter.entities(s, d), adapter.layers(s, d)),
    "entity_category": lambda s, d: c.category_counts(adapter.entities(s, d)).drop("sub_category"),
    "entity_sub_category": _sub,
    "discipline_vote": lambda s, d: c.discipline_vote(sources(s, d)),
    "discipline_ranking": lambda s, d: c.discipline_ranking(sources(s, d)),
    "discipline_vote_codes": vote_codes,
    "vote_evidence": lambda s, d: c.vote_evidence(sources(s, d)),
    "detected_disciplines": project_disciplines,
    "vote_evidence_codes": lambda s, d: c.vote_evidence_codes(sources(s, d), adapter.layers(s, d)),
    "load_dictionaries": _loaded_dictionaries,
}

BY_NO = "CASE WHEN drawing_no IN ('', '未识别') THEN NULL " + " ".join(
    f"WHEN starts_with(upper(drawing_no), {sql.lit(p.upper())}) THEN {sql.lit(d)}" for p, d in sorted(fixed.DRAWING_NO_PREFIX, key=lambda x: -len(x[0]))) + " END"
NAMEKW = sql.values("namekw", "prio, disc, kw", [(i, d, w) for i, (d, ws) in enumerate(fixed.NAME_KEYWORDS) for w in ws])
BYNAME = ("byname AS (SELECT row_id, disc AS by_name FROM (SELECT row_id, prio, disc, count(*) AS n FROM catalog JOIN namekw ON contains(drawing_name, kw) GROUP BY ALL) "
          "QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, prio) = 1)")
CLASSIFIED = (f"classified AS (SELECT row_id, sheet_id, drawing_no, drawing_name, coalesce(by_no, by_name, '其他') AS discipline, CASE WHEN by_no = by_name THEN '高' WHEN by_no IS NOT NULL AND by_name IS NOT NULL THEN '中（图号与图名不一致）' "
              f"WHEN by_no IS NOT NULL THEN '中（仅图号）' WHEN by_name IS NOT NULL THEN '中（仅图名）' ELSE '低' END AS confidence FROM (SELECT *, {BY_NO} AS by_no FROM catalog) LEFT JOIN byname USING (row_id))")
CAT_CTES = [sql.CATALOG, NAMEKW, BYNAME, CLASSIFIED]
ORDER = sql.values("disc_order", "discipline, rank", [(d, i) for i, d in enumerate(fixed.DISCIPLINE_ORDER)])
PREFIXES = sql.values("prefixes", "key, code", fixed.LAYER_PREFIX_CODES)
PREFIXED = ("prefixed AS (SELECT sheet_id, pos, name, coalesce(p.code, q.code) AS code FROM layers LEFT JOIN prefixes p ON regexp_matches(upper(name), '^[^-_\\s]+[-_\\s]') "
            "AND p.key = regexp_extract(upper(name), '^[^-_\\s]+') LEFT JOIN prefixes q ON q.key = upper(name)), "
            "prefix_best AS (SELECT sheet_id, code, n AS n_layers FROM (SELECT sheet_id, code, count(*) AS n, min(pos) AS f FROM prefixed WHERE code IS NOT NULL GROUP BY ALL) "
            "QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, f) = 1)")


def _kw_regex(word):
    if any("一" <= ch <= "鿿" for ch in word):
        before = fixed.EXCLUDED_PRECEDING.get(word)
        return f"(^|[^{before}]){word}" if before else word
    return f"(^|[^A-Z0-9]){re.escape(word)}([^A-Z0-9]|$)"


def category_case(col):
    body = " ".join("WHEN " + " OR ".join(f"regexp_matches(upper({col}), {sql.lit(_kw_regex(w))})" for w in ws) + f" THEN {sql.lit(n)}" for n, ws in fixed.CATEGORIES)
    return f"CASE WHEN coalesce({col}, '') = '' THEN NULL {body} END"


SUB_OWN = sql.case_of("upper(coalesce(block_name, '') || ' ' || coalesce(label_text, ''))", fixed.SUB_CATEGORIES, "NULL")
SUB_ALL = sql.case_of("upper(layer || ' ' || coalesce(block_name, '') || ' ' || coalesce(label_text, ''))", fixed.SUB_CATEGORIES, "NULL")
CATEGORY = (f"cats AS (SELECT layer, block_name, label_text, coalesce(own, by_layer, 'UNKNOWN') AS category, CASE WHEN own IS NOT NULL THEN {SUB_OWN} WHEN by_layer IS NOT NULL THEN {SUB_ALL} END AS sub_category, n FROM "
            f"(SELECT *, coalesce({category_case('block_name')}, {category_case('label_text')}) AS own, {category_case('layer')} AS by_layer FROM "
            "(SELECT layer, block_name, label_text, count(*) AS n FROM ent GROUP BY ALL)))")
CONTENT = sql.values("content", "disc, prio, kind, kw, wt", [(d, i, k, w.upper(), wt) for i, (d, kinds) in enumerate(fixed.CONTENT_WEIGHTS.items()) for k, ws in kinds.items() for w, wt in ws.items()])
CODES = sql.values("codes", "disc, prio, kind, kw, wt", [(d, i, k, w.upper(), fixed.CODE_HIT_WEIGHT[k]) for i, (d, ws) in enumerate(fixed.CODE_KEYWORDS) for k in ("layer", "block", "text") for w in ws])
VOTERS = ("voters AS (SELECT sheet_id, 'layer' AS kind, name, pos AS first FROM layers UNION ALL SELECT sheet_id, 'block', block_name, pos FROM blockdefs WHERE left(block_name, 1) NOT IN ('*', '_') "
          "UNION ALL SELECT sheet_id, 'text', label_text, seq FROM ent WHERE dxf_type = 'TEXT' AND label_text <> '')")


def scored(table):
    return (f"scored AS (SELECT sheet_id, disc, prio, CAST(sum(wt) AS BIGINT) AS score, min(CASE v.kind WHEN 'layer' THEN 0 WHEN 'block' THEN 1 ELSE 2 END * 1000000000000 + first) AS hit FROM voters v JOIN {table} k ON v.kind = k.kind AND contains(upper(v.name), kw) GROUP BY ALL), "
            "totals AS (SELECT *, sum(score) OVER (PARTITION BY sheet_id) AS total, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, hit, prio) AS rank FROM scored)")


VOTE = [sql.ENT, sql.LAYERS, sql.BLOCKDEFS, VOTERS, CONTENT, scored("content")]
BONUS = ("allscores AS (SELECT sheet_id, disc, prio, CAST(sum(wt) AS BIGINT) AS score, min(hit) AS hit FROM (SELECT sheet_id, disc, prio, wt, CASE v.kind WHEN 'layer' THEN 0 WHEN 'block' THEN 1 ELSE 2 END * 1000000000000 + first AS hit FROM voters v JOIN codes k ON v.kind = k.kind AND contains(upper(v.name), kw) "
         "UNION ALL SELECT sheet_id, disc, prio, 5 * n_layers, NULL FROM prefix_best JOIN (SELECT DISTINCT disc, prio FROM codes) ON disc = code) GROUP BY ALL), "
         "ranked AS (SELECT *, sum(score) OVER (PARTITION BY sheet_id) AS total, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, hit NULLS LAST, prio) AS rank FROM allscores), "
         f"votecodes AS (SELECT sheet_id, CASE WHEN count(*) FILTER (WHERE score / total > 0.25) > 1 AND max(CASE WHEN rank = 1 THEN {sql.rnd('score * 100.0 / total', 1)} END) < 60 THEN 'MULTI' ELSE max(CASE WHEN rank = 1 THEN disc END) END AS code, "
         f"max(CASE WHEN rank = 1 THEN {sql.rnd('score * 100.0 / total', 1)} END) AS confidence FROM ranked GROUP BY sheet_id), "
         "sheetcodes AS (SELECT c_custkey AS sheet_id, coalesce(code, 'UNKNOWN') AS code, coalesce(confidence, 0.0::DOUBLE) AS confidence FROM customer LEFT JOIN votecodes ON c_custkey = sheet_id)")
VOTECODES_CTES = [sql.ENT, sql.LAYERS, sql.BLOCKDEFS, VOTERS, CODES, PREFIXES, PREFIXED, BONUS]
REGISTRY = sql.values("registry", "rank, code, name, unit_work, standard", [(i, *r) for i, r in enumerate(fixed.DISCIPLINE_REGISTRY)])
DETECTED = ("detected AS (SELECT DISTINCT project_id, r.code, r.name, CAST(r.rank AS BIGINT) AS rank FROM (SELECT project_id, discipline AS dname, NULL AS dcode FROM classified JOIN sheets USING (sheet_id) "
            "UNION ALL SELECT project_id, NULL, discipline FROM sheets) x JOIN registry r ON (r.name = x.dname OR r.code = x.dcode) WHERE r.code <> 'UNKNOWN')")
CATALOG2 = "classified2 AS (SELECT row_id, sheet_id, discipline FROM classified)"
DETECTED_CTES = [*CAT_CTES, sql.SHEETS, REGISTRY,
                 DETECTED.replace("SELECT project_id, discipline AS dname, NULL AS dcode FROM classified JOIN sheets USING (sheet_id)",
                                  "SELECT s.project_id, c.discipline AS dname, NULL AS dcode FROM classified c JOIN sheets s ON c.sheet_id = s.sheet_id")]
DICT = sql.values("dict", "dictionary, label, priority, keyword", [(d, k, i, w) for d, groups in (("role", fixed.ROLE_KEYWORDS), ("discipline", fixed.LAYER_KEYWORDS), ("category", fixed.CATEGORIES))
                                                                  for i, (k, ws) in enumerate(groups) for w in ws])

ORACLES = {
    "norm": sql.query("SELECT upper(trim(label_text)) AS text, count(*) AS n FROM ent WHERE dxf_type = 'TEXT' GROUP BY ALL", sql.ENT),
    "layer_discipline": sql.query(f"SELECT layer, count(*) AS n, {sql.case_of(sql.norm('layer'), fixed.LAYER_KEYWORDS, sql.lit(''))} AS discipline FROM ent GROUP BY layer", sql.ENT),
    "drawing_no_discipline": sql.query(f"SELECT row_id, {BY_NO} AS discipline FROM catalog", sql.CATALOG),
    "drawing_name_discipline": sql.query("SELECT row_id, by_name AS discipline FROM catalog LEFT JOIN byname USING (row_id)", *CAT_CTES),
    "classify_sheet": sql.query("SELECT row_id, discipline, confidence FROM classified", *CAT_CTES),
    "sheet_discipline_stats": sql.query("SELECT discipline, sheets, low_confidence, CAST(coalesce(rank, 12) AS BIGINT) AS rank FROM (SELECT discipline, count(*) AS sheets, count(*) FILTER (WHERE confidence = '低') AS low_confidence "
                                        "FROM classified GROUP BY discipline) LEFT JOIN disc_order USING (discipline)", *CAT_CTES, ORDER),
    "layer_prefix_discipline": sql.query("SELECT * FROM prefix_best", sql.LAYERS, PREFIXES, PREFIXED),
    "drawing_type": sql.query(
        f"SELECT sheet_id, coalesce(CASE min(r) " + " ".join(f"WHEN {i} THEN {sql.lit(n)}" for i, (n, _) in enumerate(fixed.DRAWING_TYPES)) + " END, 'UNKNOWN') AS drawing_type FROM "
        f"(SELECT sheet_id, CAST({sql.case_of('upper(s)', [(str(i), ws) for i, (_, ws) in enumerate(fixed.DRAWING_TYPES)], 'NULL')} AS INT) AS r FROM "
        "(SELECT sheet_id, label_text AS s FROM ent WHERE dxf_type = 'TEXT' UNION ALL SELECT sheet_id, name FROM layers)) GROUP BY sheet_id", sql.ENT, sql.LAYERS),
    "entity_category": sql.query("SELECT layer, block_name, label_text, category, n FROM cats", sql.ENT, CATEGORY),
    "entity_sub_category": sql.query("SELECT category, sub_category, CAST(sum(n) AS BIGINT) AS n FROM cats GROUP BY ALL", sql.ENT, CATEGORY),
    "discipline_vote": sql.query(f"SELECT sheet_id, max(CASE WHEN rank = 1 THEN disc END) AS primary_discipline, max(CASE WHEN rank = 1 THEN {sql.rnd('score * 100.0 / total', 1)} END) AS confidence, "
                                 "count(*) FILTER (WHERE score / total > 0.2) > 1 AS is_multi FROM totals GROUP BY sheet_id", *VOTE),
    "discipline_ranking": sql.query(f"SELECT sheet_id, rank, disc AS discipline, score, {sql.rnd('score * 100.0 / total', 1)} AS ratio FROM totals", *VOTE),
    "discipline_vote_codes": sql.query("SELECT * FROM sheetcodes", *VOTECODES_CTES),
    "vote_evidence": sql.query("SELECT sheet_id, disc AS discipline, kind, name, rank FROM (SELECT sheet_id, disc, kind, name, row_number() OVER (PARTITION BY sheet_id, disc, kind ORDER BY f, name) AS rank FROM "
                               "(SELECT sheet_id, disc, v.kind, name, min(first) AS f FROM voters v JOIN content k ON v.kind = k.kind AND contains(upper(v.name), kw) GROUP BY ALL)) WHERE rank <= 10", *VOTE),
    "vote_evidence_codes": sql.query(
        "SELECT sheet_id, code, kind, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, kind ORDER BY f, name) AS rank FROM (SELECT v.sheet_id, r.disc AS code, v.kind, v.name, min(v.first) AS f "
        "FROM voters v JOIN codes k ON v.kind = k.kind AND contains(upper(v.name), kw) JOIN ranked r ON r.sheet_id = v.sheet_id AND r.disc = k.disc AND r.rank = 1 GROUP BY ALL "
        "UNION ALL SELECT p.sheet_id, p.code, 'layer_prefix', p.name, min(p.pos) FROM prefixed p JOIN prefix_best b ON p.sheet_id = b.sheet_id AND p.code = b.code "
        "JOIN ranked r ON r.sheet_id = p.sheet_id AND r.disc = p.code AND r.rank = 1 GROUP BY ALL)) WHERE rank <= 8", *VOTECODES_CTES),
    "detected_disciplines": sql.query("SELECT * FROM detected", *DETECTED_CTES),
    "load_dictionaries": sql.query("SELECT dictionary, label, CAST(priority AS BIGINT) AS priority, keyword, CAST(count(*) AS BIGINT) AS entities FROM ent JOIN dict ON contains(upper(layer), upper(keyword)) GROUP BY ALL", sql.ENT, DICT),
}
