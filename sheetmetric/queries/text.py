"""Queries of the text operators."""
import re

from pyspark.sql import functions as F

from sheetmetric.functions.text import tokens_sql
from sheetmetric.model import adapter, fixed
from sheetmetric.operators import texts as t
from sheetmetric.queries import sql

FIELDS = "array_join(transform(array_sort(map_entries(fields)), e -> concat(e.key, '=', e.value)), '；') AS fields"


def hits(spark, sf):
    return t.material_hits(adapter.entities(spark, sf))


def _tokenize(spark, sf):
    texts = adapter.entities(spark, sf).where("dxf_type = 'TEXT'").groupBy("label_text").agg(F.count("*").alias("n"))
    return texts.selectExpr("label_text", f"array_join({tokens_sql('label_text')}, '|') AS tokens", "n")


def _title_fields(spark, sf):
    e = adapter.entities(spark, sf)
    zone = t.title_fields_zone(t.title_zone_text(e)).selectExpr("sheet_id", "'zone' AS variant", "drawing_no", "drawing_name", "scale", "discipline_hint AS extra")
    return zone.unionByName(title_sheet(spark, sf).selectExpr("sheet_id", "'sheet' AS variant", "drawing_no", "drawing_name", "scale", "revision AS extra"))


def title_sheet(spark, sf):
    return t.title_fields_sheet(t.title_zone_text(adapter.entities(spark, sf), 1 / 3, 0.25, fall_back=True))


def _zones(spark, sf):
    e = adapter.entities(spark, sf)
    a = t.title_zone_text(e).selectExpr("'zone' AS variant", "sheet_id", "entity_id", "text")
    return a.unionByName(t.title_zone_text(e, 1 / 3, 0.25, fall_back=True).selectExpr("'sheet' AS variant", "sheet_id", "entity_id", "text"))


def _paper(spark, sf):
    return t.rectangles(adapter.entities(spark, sf)).select("entity_id", t.paper_guess("width * 20", "height * 20").alias("paper"))


QUERIES = {
    "tokenize": _tokenize,
    "text_extract": lambda s, d: t.text_extract(adapter.entities(s, d)).drop("seq"),
    "keyword_freq": lambda s, d: t.keyword_freq(adapter.table(s, d, "documents")),
    "drawing_keyword_freq": lambda s, d: t.keyword_freq(t.text_extract(adapter.entities(s, d)), "content"),
    "elevation_parse": lambda s, d: t.elevations(adapter.entities(s, d)).select("entity_id", "raw", "value"),
    "elevation_levels": lambda s, d: t.elevation_levels(adapter.entities(s, d)),
    "elevation_list": lambda s, d: t.elevation_list(adapter.entities(s, d)),
    "frame_detect": lambda s, d: t.frame_detect(adapter.entities(s, d)).withColumn("rank", F.col("rank").cast("long")),
    "paper_guess": _paper,
    "title_zone_text": _zones,
    "title_fields": _title_fields,
    "material_extract": lambda s, d: hits(s, d).selectExpr("entity_id", "CAST(pattern AS BIGINT) AS pattern", "category", "matched_text", FIELDS),
    "dedup_hits": lambda s, d: t.dedup_hits(hits(s, d)).drop("raw", "sheet_id"),
    "material_summary": lambda s, d: t.material_summary(hits(s, d)),
    "top_specs": lambda s, d: t.top_specs(hits(s, d)).withColumn("rank", F.col("rank").cast("long")),
}

CJK = "[\\x{4e00}-\\x{9fff}]+"
ATTRS = ("attrs AS (SELECT sheet_id, entity_id, layer, 'SPEC' AS tag, attr_spec AS content FROM ent WHERE attr_spec IS NOT NULL "
         "UNION ALL SELECT sheet_id, entity_id, layer, 'ROOM', attr_room FROM ent WHERE attr_room IS NOT NULL)")
ALLTEXT = ("alltext AS (SELECT sheet_id, entity_id, layer, label_text AS content FROM ent WHERE dxf_type = 'TEXT' UNION ALL SELECT sheet_id, entity_id, layer, content FROM attrs)")
ELEV = ("elev AS (SELECT sheet_id, entity_id, x0, y0, raw, CAST(replace(replace(raw, '±', ''), '+', '') AS DOUBLE) AS value FROM (SELECT sheet_id, entity_id, x0, y0, "
        "replace(unnest(regexp_extract_all(label_text, '[+\\-±]\\s?\\d+\\.\\d{3}')), ' ', '') AS raw FROM ent WHERE dxf_type = 'TEXT'))")
RECTS = "rects AS (SELECT *, w * h AS area FROM ent WHERE dxf_type = 'LWPOLYLINE' AND closed AND w > 0 AND h > 0)"
PAPEROPT = sql.values("opts", "i, pw, ph, label", [(i, float(w), float(h), lab) for i, (w, h, lab) in enumerate(
    (a * s, b * s, f"{n}（1:{s}）" if s > 1 else n) for n, lo, sh in fixed.PAPERS for a, b in ((lo, sh), (sh, lo)) for s in fixed.PAPER_SCALES)])


def guess(w, h):
    return f"(SELECT CASE WHEN min(err) < 0.05 THEN arg_min(label, err) ELSE '未知' END FROM (SELECT label, abs({w} - pw) / pw + abs({h} - ph) / ph AS err FROM opts))"


OUTER = "outers AS (SELECT sheet_id, x0 AS ax, y0 AS ay, x0 + w AS bx, y0 + h AS by_ FROM rects QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY area DESC, seq, entity_id) = 1)"
EXT = ("exts AS (SELECT * FROM outers UNION ALL SELECT sheet_id, min(x0), min(y0), max(CASE WHEN dxf_type = 'LINE' THEN x0 + w ELSE x0 END), max(y0) FROM ent "
       "WHERE dxf_type NOT IN ('LWPOLYLINE', 'HATCH') AND sheet_id NOT IN (SELECT sheet_id FROM outers) GROUP BY sheet_id)")
ZONES = ("zones AS (SELECT 'zone' AS variant, e.sheet_id, seq, entity_id, trim(label_text) AS text FROM ent e JOIN outers o ON e.sheet_id = o.sheet_id "
         "WHERE dxf_type = 'TEXT' AND trim(label_text) <> '' AND x0 BETWEEN bx - (bx - ax) * 0.4 AND bx AND y0 BETWEEN ay AND ay + (by_ - ay) * 0.25 "
         "UNION ALL SELECT 'sheet', e.sheet_id, seq, entity_id, trim(label_text) FROM ent e JOIN exts o ON e.sheet_id = o.sheet_id "
         "WHERE dxf_type = 'TEXT' AND trim(label_text) <> '' AND x0 BETWEEN bx - (bx - ax) / 3 AND bx AND y0 BETWEEN ay AND ay + (by_ - ay) / 4)")
ZONE_CTES = [sql.ENT, RECTS, OUTER, EXT, ZONES]


def _first(value, cond, how="arg_min"):
    return f"{how}({value}, (seq, entity_id)) FILTER (WHERE {cond})"


Z, S = fixed.TITLE_ZONE, fixed.TITLE_SHEET
HINT = "CASE " + " ".join(f"WHEN contains(text, '{k}') THEN '{v}'" for k, v in reversed(Z["hint"])) + " END"
TITLE_Z = (f"SELECT sheet_id, variant, {_first('text', 'regexp_matches(text, ' + sql.lit(Z['no']) + ')')} AS drawing_no, {_first('text', 'regexp_matches(text, ' + sql.lit(Z['name']) + ')')} AS drawing_name, "
           f"{_first('text', 'contains(text, ' + sql.lit('1:') + ')')} AS scale, {_first(HINT, HINT + ' IS NOT NULL', 'arg_max')} AS extra FROM zones WHERE variant = 'zone' GROUP BY ALL")
TITLE_S = (f"SELECT sheet_id, variant, {_first('regexp_extract(text, ' + sql.lit(S['no']) + ')', 'regexp_matches(text, ' + sql.lit(S['no']) + ')')} AS drawing_no, {_first('text', sql.any_of('text', S['name']))} AS drawing_name, "
           f"{_first('text', 'contains(text, ' + sql.lit('1:') + ')')} AS scale, CAST(NULL AS VARCHAR) AS extra FROM zones WHERE variant = 'sheet' GROUP BY ALL")
HITS = "mathits AS (" + " UNION ALL ".join(
    f"SELECT sheet_id, entity_id, {i} AS pattern, '{c}' AS category, trim(m) AS matched_text, concat_ws('；', " + ", ".join(
        f"CASE WHEN coalesce(g{g + 1}, '') <> '' THEN '{n}=' || g{g + 1} END" for g, n in sorted(enumerate(names), key=lambda x: x[1])) +
    ") AS fields FROM (SELECT sheet_id, entity_id, " + ", ".join(
        f"unnest(regexp_extract_all(content, {sql.lit(p)}, {g})) AS {'m' if g == 0 else f'g{g}'}" for g in range(len(names) + 1)) +
    " FROM alltext)" for i, (c, p, names) in enumerate(fixed.MATERIALS)) + "), mat AS (SELECT * FROM mathits WHERE fields <> '')"
MAT = [sql.ENT, ATTRS, ALLTEXT, HITS]
FREQ = "SELECT word, count(*) AS n FROM words WHERE NOT regexp_full_match(word, '[0-9]+') GROUP BY word ORDER BY n DESC, word LIMIT 30"


def words(src, text):
    grams = ("SELECT CASE WHEN length(run) <= 2 THEN run ELSE substring(run, i, 2) END AS word FROM (SELECT run, unnest(range(1, greatest(length(run), 2))) AS i "
             "FROM (SELECT unnest(regexp_extract_all(" + text + ", '" + CJK + "')) AS run FROM " + src + "))")
    return f"words AS (SELECT unnest(regexp_extract_all({text}, '[A-Za-z0-9_\\-]{{2,}}')) AS word FROM {src} UNION ALL {grams})"


ORACLES = {
    "tokenize": sql.query(
        "SELECT t.label_text, concat_ws('|', nullif(array_to_string(regexp_extract_all(t.label_text, '[A-Za-z0-9_\\-]{2,}'), '|'), ''), g.grams) AS tokens, t.n FROM "
        "(SELECT label_text, count(*) AS n FROM ent WHERE dxf_type = 'TEXT' GROUP BY label_text) t LEFT JOIN (SELECT label_text, string_agg(word, '|' ORDER BY r, i) AS grams FROM ("
        "SELECT label_text, r, i, CASE WHEN length(run) <= 2 THEN run ELSE substring(run, i, 2) END AS word FROM (SELECT label_text, r, run, unnest(range(1, greatest(length(run), 2))) AS i FROM "
        f"(SELECT label_text, unnest(regexp_extract_all(label_text, '{CJK}')) AS run, generate_subscripts(regexp_extract_all(label_text, '{CJK}'), 1) AS r FROM (SELECT DISTINCT label_text FROM ent WHERE dxf_type = 'TEXT')))) GROUP BY label_text) g USING (label_text)", sql.ENT),
    "text_extract": sql.query(
        "SELECT sheet_id, entity_id, 'TEXT' AS type, '' AS tag, label_text AS content, layer, CAST(text_height AS DOUBLE) AS height FROM ent WHERE dxf_type = 'TEXT' "
        "UNION ALL SELECT sheet_id, entity_id, 'ATTRIB', tag, content, layer, 0.0 FROM attrs", sql.ENT, ATTRS),
    "keyword_freq": sql.query(FREQ, words("documents", "text")),
    "drawing_keyword_freq": sql.query(FREQ, sql.ENT, ATTRS, ALLTEXT, words("alltext", "content")),
    "elevation_parse": sql.query("SELECT entity_id, raw, value FROM elev", sql.ENT, ELEV),
    "elevation_levels": sql.query("SELECT sheet_id, count(*) AS total, count(DISTINCT value) AS level_count, count(DISTINCT value) - 1 AS intervals, max(value) AS highest, min(value) AS lowest "
                                  "FROM (SELECT DISTINCT sheet_id, raw, x0, y0, value FROM elev) GROUP BY sheet_id", sql.ENT, ELEV),
    "elevation_list": sql.query("SELECT sheet_id, value, count(*) AS n, row_number() OVER (PARTITION BY sheet_id ORDER BY value DESC) AS rank FROM (SELECT DISTINCT sheet_id, raw, x0, y0, value FROM elev) GROUP BY sheet_id, value", sql.ENT, ELEV),
    "frame_detect": sql.query(f"SELECT sheet_id, rank, layer, CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height, CAST(area AS DOUBLE) AS area, {guess('w', 'h')} AS paper FROM "
                              "(SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY area DESC, seq, entity_id) AS rank FROM rects) r WHERE rank <= 10", sql.ENT, RECTS, PAPEROPT),
    "paper_guess": sql.query(f"SELECT entity_id, {guess('w * 20', 'h * 20')} AS paper FROM rects r", sql.ENT, RECTS, PAPEROPT),
    "title_zone_text": sql.query("SELECT variant, sheet_id, entity_id, text FROM zones", *ZONE_CTES),
    "title_fields": sql.query(f"{TITLE_Z} UNION ALL {TITLE_S}", *ZONE_CTES),
    "material_extract": sql.query("SELECT entity_id, CAST(pattern AS BIGINT) AS pattern, category, matched_text, fields FROM mat", *MAT),
    "dedup_hits": sql.query("SELECT DISTINCT category, entity_id, matched_text FROM mat", *MAT),
    "material_summary": sql.query('SELECT sheet_id, category, count(DISTINCT (entity_id, matched_text)) AS "count", count(*) AS raw_hits, count(DISTINCT matched_text) AS specs FROM mat GROUP BY sheet_id, category', *MAT),
    "top_specs": sql.query("SELECT category, matched_text, n, rank FROM (SELECT category, matched_text, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, matched_text) AS rank FROM "
                           "(SELECT category, matched_text, count(DISTINCT entity_id) AS n FROM mat GROUP BY ALL)) WHERE rank <= 50", *MAT),
}
