"""Queries of the scale calibration operators."""
from pyspark.sql import functions as F

from sheetmetric.functions.numbers import half_up
from sheetmetric.model import adapter, fixed
from sheetmetric.operators import calibrate as c
from sheetmetric.queries import sql


def _scale_text(spark, sf):
    return c.scale_texts(adapter.entities(spark, sf)).select("entity_id", "scale_text", "scale_ratio")


def _paper_match(spark, sf):
    frames = c.frame_bbox(adapter.entities(spark, sf)).select(
        "sheet_id", F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).alias("long"),
        F.least(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).alias("short"))
    with_ratio = frames.join(c.scale_mode(adapter.entities(spark, sf)).select("sheet_id", "scale_ratio"), "sheet_id", "left")
    return with_ratio.withColumn("m", c.paper_match("long", "short", "scale_ratio")).select("sheet_id", "m.*")


QUERIES = {
    "unit_factor": lambda s, d: c.unit_factor(adapter.sheets(s, d)),
    "scale_text": _scale_text,
    "scale_mode": lambda s, d: c.scale_mode(adapter.entities(s, d)),
    "frame_bbox": lambda s, d: c.frame_bbox(adapter.entities(s, d)),
    "paper_match": _paper_match,
    "scale_calibration": lambda s, d: c.scale_calibration(adapter.sheets(s, d), adapter.entities(s, d)),
}

UNITS = ("units AS (SELECT sheet_id, CASE insunits WHEN 1 THEN 'inch' WHEN 2 THEN 'ft' WHEN 4 THEN 'mm' WHEN 5 THEN 'cm' WHEN 6 THEN 'm' ELSE 'unitless' END AS drawing_unit, "
         "CASE insunits WHEN 1 THEN 25.4 WHEN 2 THEN 304.8 WHEN 5 THEN 10.0 WHEN 6 THEN 1000.0 ELSE 1.0 END::DOUBLE AS unit_factor_to_mm FROM sheets)")
SCALES = ("scales AS (SELECT sheet_id, seq, entity_id, role, regexp_extract(label_text, '(?:^|[^\\d.])(1\\s*[:：]\\s*\\d+(?:\\.\\d+)?)', 1) AS scale_text, "
          "CAST(regexp_extract(label_text, '(?:^|[^\\d.])1\\s*[:：]\\s*(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS scale_ratio FROM entr "
          "WHERE dxf_type = 'TEXT' AND regexp_matches(label_text, '(?:^|[^\\d.])1\\s*[:：]\\s*(\\d+(?:\\.\\d+)?)'))")
MODE = ("smode AS (SELECT sheet_id, scale_ratio, scale_text, n AS occurrences FROM (SELECT sheet_id, scale_ratio, count(*) AS n, max(CASE WHEN role = 'FRAME' THEN 1 ELSE 0 END) AS f, "
        "min(seq) AS s, arg_min(scale_text, seq) AS scale_text FROM scales WHERE scale_ratio >= 1 GROUP BY ALL) "
        "QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, f DESC, s) = 1)")
POOLX = "CASE WHEN dxf_type = 'TEXT' THEN x0 + greatest(text_height, length(label_text) * text_height * 0.7) ELSE {} END"
FRAME = (f"fr AS (SELECT *, {sql.XMIN} AS xmin, {sql.YMIN} AS ymin, {POOLX.format(sql.XMAX)} AS xmax, "
         f"CASE WHEN dxf_type = 'TEXT' THEN y0 + text_height ELSE {sql.YMAX} END AS ymax FROM entr WHERE role = 'FRAME'), "
         "best AS (SELECT sheet_id, xmin, ymin, xmax, ymax FROM fr WHERE dxf_type = 'LWPOLYLINE' AND closed AND w * h > 0 "
         "QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY w * h DESC, seq, entity_id) = 1), "
         "frames AS (SELECT u.sheet_id, CAST(coalesce(b.xmin, u.a) AS DOUBLE) AS xmin, CAST(coalesce(b.ymin, u.b) AS DOUBLE) AS ymin, CAST(coalesce(b.xmax, u.c) AS DOUBLE) AS xmax, CAST(coalesce(b.ymax, u.d) AS DOUBLE) AS ymax "
         "FROM (SELECT sheet_id, min(xmin) AS a, min(ymin) AS b, max(xmax) AS c, max(ymax) AS d FROM fr GROUP BY sheet_id) u LEFT JOIN best b USING (sheet_id))")
PAPERS = sql.values("papers", "i, paper, pl, ps", [(i, n, float(a), float(b)) for i, (n, a, b) in enumerate(fixed.PAPERS[::-1])])
SIDES = ("sides AS (SELECT f.sheet_id, greatest(xmax - xmin, ymax - ymin) AS long, least(xmax - xmin, ymax - ymin) AS short, s.scale_ratio FROM frames f LEFT JOIN smode s USING (sheet_id))")
MATCH = ("fits AS (SELECT sheet_id, scale_ratio, paper, long / pl AS fpr FROM sides, papers WHERE short > 0 AND abs(long / short / (pl / ps) - 1.0) <= 0.05 "
         "QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY CASE WHEN scale_ratio IS NULL THEN -pl ELSE abs(long / pl - scale_ratio) END, i) = 1), "
         "pmatch AS (SELECT s.sheet_id, CASE WHEN f.scale_ratio IS NULL OR abs(fpr / f.scale_ratio - 1.0) <= 0.05 THEN paper END AS paper, "
         f"{sql.rnd('fpr', 3)} AS frame_paper_ratio, f.sheet_id IS NOT NULL AS aspect_matched FROM sides s LEFT JOIN fits f USING (sheet_id))")
CASES = ("cases AS (SELECT u.*, m.scale_text, m.scale_ratio, CASE WHEN s.long IS NOT NULL AND m.scale_ratio IS NOT NULL THEN p.paper END AS paper, "
         "CASE WHEN s.long IS NOT NULL AND m.scale_ratio IS NOT NULL THEN p.frame_paper_ratio END AS frame_paper_ratio, CASE WHEN s.long IS NOT NULL AND m.scale_ratio IS NOT NULL THEN "
         "CASE WHEN p.paper IS NOT NULL AND abs(p.frame_paper_ratio / m.scale_ratio - 1.0) <= 0.05 THEN 'MODEL' WHEN p.aspect_matched AND abs(p.frame_paper_ratio - 1.0) <= 0.05 THEN 'PAPER' ELSE 'CONFLICT' END "
         "WHEN s.long IS NOT NULL THEN CASE WHEN s.long >= 2378 THEN 'FRAME_SIZE' ELSE 'FRAME_ONLY' END WHEN m.scale_ratio IS NOT NULL THEN 'TEXT_ONLY' ELSE 'NONE' END AS c "
         "FROM units u LEFT JOIN sides s USING (sheet_id) LEFT JOIN smode m USING (sheet_id) LEFT JOIN pmatch p USING (sheet_id))")
CALIB = ("calib AS (SELECT sheet_id, drawing_unit, unit_factor_to_mm, scale_text, scale_ratio, CASE WHEN c IN ('MODEL', 'FRAME_SIZE') THEN 'MODEL_1_TO_1' WHEN c = 'PAPER' THEN 'PAPER_SCALED' ELSE 'UNKNOWN' END AS geometry_state, "
         "CAST(CASE WHEN c = 'PAPER' THEN scale_ratio ELSE 1.0 END AS DOUBLE) AS model_factor, unit_factor_to_mm * CASE WHEN c = 'PAPER' THEN scale_ratio ELSE 1.0 END AS factor_to_mm, "
         "CASE WHEN c IN ('MODEL', 'PAPER', 'TEXT_ONLY') THEN 'TITLE_BLOCK' WHEN c = 'FRAME_SIZE' THEN 'INSUNITS' ELSE 'ASSUMED' END AS calibrated_by, "
         "CASE c WHEN 'MODEL' THEN 'FRAME_VS_PAPER' WHEN 'PAPER' THEN 'FRAME_VS_PAPER' WHEN 'CONFLICT' THEN 'FRAME_SCALE_CONFLICT' WHEN 'TEXT_ONLY' THEN 'TITLE_SCALE_TEXT_ONLY' WHEN 'NONE' THEN 'NO_SCALE_EVIDENCE' ELSE c END AS calibrated_by_detail, "
         "CASE WHEN c = 'CONFLICT' THEN 'PENDING_CONFLICT' WHEN c IN ('MODEL', 'PAPER', 'FRAME_SIZE') AND drawing_unit <> 'unitless' THEN 'OK' ELSE 'PENDING_ASSUMED' END AS status, "
         "CAST(CASE c WHEN 'CONFLICT' THEN 0.2 WHEN 'FRAME_ONLY' THEN 0.35 WHEN 'TEXT_ONLY' THEN 0.4 WHEN 'NONE' THEN 0.3 ELSE CASE WHEN drawing_unit = 'unitless' THEN 0.6 WHEN c = 'MODEL' THEN 0.95 WHEN c = 'PAPER' THEN 0.9 ELSE 0.75 END END AS DOUBLE) AS confidence, "
         "paper, frame_paper_ratio, CASE c WHEN 'CONFLICT' THEN 'FRAME_SCALE_CONFLICT' WHEN 'FRAME_ONLY' THEN 'FRAME_ONLY' WHEN 'TEXT_ONLY' THEN 'TITLE_SCALE_TEXT_ONLY' WHEN 'NONE' THEN 'NO_SCALE_EVIDENCE' END AS pending FROM cases)")
CALIBRATION_CTES = [UNITS, SCALES, MODE, FRAME, PAPERS, SIDES, MATCH, CASES, CALIB]
BASE = [sql.ENT, sql.ENTR, sql.SHEETS, *CALIBRATION_CTES]

ORACLES = {
    "unit_factor": sql.query("SELECT * FROM units", *BASE),
    "scale_text": sql.query("SELECT entity_id, scale_text, scale_ratio FROM scales", *BASE),
    "scale_mode": sql.query("SELECT * FROM smode", *BASE),
    "frame_bbox": sql.query("SELECT * FROM frames", *BASE),
    "paper_match": sql.query("SELECT * FROM pmatch", *BASE),
    "scale_calibration": sql.query("SELECT * FROM calib", *BASE),
}
