"""Queries of the project profile operators."""
from pyspark.sql import functions as F

from sheetmetric.model import adapter, fixed
from sheetmetric.operators import measure as m
from sheetmetric.operators import profile as p
from sheetmetric.operators import texts as t
from sheetmetric.operators.calibrate import scale_calibration
from sheetmetric.plans.quantities import Takeoff
from sheetmetric.queries import classify as cq
from sheetmetric.queries import measure as mq
from sheetmetric.queries import sql
from sheetmetric.queries import text as tq
from sheetmetric.session import cut_lineage

RAW = ("CASE WHEN turn % 2 = 0 THEN text END AS text", "CASE WHEN turn % 2 = 1 THEN concat(' ', text) END AS content",
       "CASE WHEN turn % 3 = 0 THEN upper(role) END AS source_type", "CASE WHEN turn % 4 = 0 THEN concat('c', CAST(conv_id AS STRING)) END AS source_ref")


def texts(spark, sf):
    return p.cio_text_source(adapter.entities(spark, sf), adapter.sheets(spark, sf))


def catalog_sizes(spark, sf):
    rows = adapter.catalog(spark, sf).join(adapter.sheets(spark, sf).select("sheet_id", "project_id"), "sheet_id")
    return rows.groupBy("project_id").agg(F.count("*").alias("total_sheets"))


def profile(spark, sf):
    return p.project_profile(texts(spark, sf), adapter.sheets(spark, sf), cut_lineage(cq.project_disciplines(spark, sf)), catalog_sizes(spark, sf))


def _text_source(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("conv_id", "turn", *RAW)
    return p.text_source(rows, ("conv_id", "turn"))


def _work(spark, sf):
    """Inputs of a profile by origin: catalog (classified where possible), texts, drawing labels, materials."""
    loose = _text_source(spark, sf).selectExpr("concat(conv_id, ':', turn) AS item", "text", "source_type", "source_ref")
    return p.work_sources(cq.classified(spark, sf), loose, texts(spark, sf), t.material_hits(adapter.entities(spark, sf)))


def _indicators(spark, sf):
    """The scales and the fields to supply are asked for several times in a plan: they are stored first."""
    entities, sheets = adapter.entities(spark, sf), adapter.sheets(spark, sf)
    takeoff = Takeoff(entities, sheets, cut_lineage(scale_calibration(sheets, entities)))
    missing = cut_lineage(p.missing_items(profile(spark, sf)))
    return p.indicators(takeoff.summary(), m.measure_audit(entities, takeoff.calibration), catalog_sizes(spark, sf), missing)


def _run_counts(spark, sf):
    detail = mq.detail(spark, sf)
    stats = cq.classified(spark, sf).agg(F.count("*").alias("sheets"), F.countDistinct("discipline").alias("disciplines"))
    blocks = detail.agg(F.countDistinct("block_name").alias("t"), F.sum("n").alias("q"))
    return stats.select("sheets", "disciplines", blocks.select("t").scalar().alias("block_types"), blocks.select("q").scalar().alias("block_total"))


def _confidence(spark, sf):
    return texts(spark, sf).groupBy("source_type").agg(F.count("*").alias("n")).withColumn("confidence", p.source_confidence())


QUERIES = {
    "text_source": _text_source,
    "cio_text_source": lambda s, d: texts(s, d).select("entity_id", "text", "source_type", "source_ref"),
    "work_sources": _work,
    "alias_extract": lambda s, d: p.alias_extract(p.text_lines(texts(s, d))),
    "value_pattern": lambda s, d: p.value_pattern(p.text_lines(texts(s, d))),
    "source_confidence": _confidence,
    "project_profile": lambda s, d: profile(s, d).drop("required"),
    "profile_stats": lambda s, d: p.profile_stats(profile(s, d)),
    "review_flag": lambda s, d: p.review_flag(profile(s, d)),
    "missing_items": lambda s, d: p.missing_items(profile(s, d)),
    "indicators": _indicators,
    "pipeline_counts": _run_counts,
}

TEXTS = "texts AS MATERIALIZED (SELECT project_id, seq, entity_id, trim(label_text) AS text, CASE WHEN role = 'FRAME' THEN 'TITLE_BLOCK' ELSE 'CIO_TEXT' END AS source_type, source_file || ':' || layer AS source_ref FROM entr JOIN sheets USING (sheet_id) WHERE trim(coalesce(label_text, '')) <> '')"
ALIAS = sql.values("aliases", "field_id, alias_pos, alias", p.ALIASES)
REST = "regexp_extract(rest, '^\\s*[:：]\\s*(.+)', 1)"
CLEAN = f"trim(regexp_replace(trim({REST}), '\\s{{3,}}.*$', ''), ' \t;；,，')"
FOUND = ("tried AS MATERIALIZED (SELECT t.*, field_id, alias_pos, substr(text, strpos(text, alias) + length(alias)) AS rest FROM texts t JOIN aliases ON contains(text, alias)), "
         f"byalias AS (SELECT project_id, field_id, value, source_type, source_ref FROM (SELECT *, {CLEAN} AS value FROM tried) WHERE value <> '' "
         "QUALIFY row_number() OVER (PARTITION BY project_id, field_id ORDER BY alias_pos, seq, entity_id) = 1), "
         f"bypattern AS (SELECT project_id, 'design_stage' AS field_id, regexp_extract(text, {sql.lit(p.PATTERNS[0][1])}, 1) AS value, source_type, source_ref FROM texts WHERE regexp_matches(text, {sql.lit(p.PATTERNS[0][1])}) "
         "QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY seq, entity_id) = 1)")
LOOSE = "loose AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE ' ' || text END AS text, CASE WHEN turn % 3 = 0 THEN upper(role) ELSE 'TEXT' END AS source_type, CASE WHEN turn % 4 = 0 THEN 'c' || conv_id ELSE 'texts.json' END AS source_ref FROM conversations WHERE trim(text) <> '')"
FIELDS = sql.values("fieldlist", "scope, field_id, name, required", [("common", f[0], f[1], str(f[2]).lower()) for f in fixed.PROFILE_COMMON] + [(c, f[0], f[1], "false") for c, fs in fixed.PROFILE_BY_DISCIPLINE.items() for f in fs])
SIZES = "sizes AS (SELECT project_id, count(*) AS total_sheets FROM catalog c JOIN sheets s ON c.sheet_id = s.sheet_id GROUP BY project_id)"
PROFILE = ("vals AS (SELECT * FROM byalias UNION ALL SELECT * FROM bypattern b WHERE (project_id, field_id) NOT IN (SELECT project_id, field_id FROM byalias) "
           "UNION ALL SELECT project_id, 'discipline_scope', string_agg(name, '、' ORDER BY rank), 'DERIVED', 'catalog' FROM detected GROUP BY project_id UNION ALL SELECT project_id, 'drawing_count', total_sheets || ' 张', 'DERIVED', 'catalog.total_sheets' FROM sizes), "
           "prof AS (SELECT f.project_id, f.scope, f.field_id, f.name, f.required = 'true' AS required, v.value, v.source_type, v.source_ref, CAST(CASE WHEN v.value IS NULL THEN 0.0 ELSE CASE v.source_type "
           + " ".join(f"WHEN '{k}' THEN {c}" for k, c in fixed.SOURCE_CONFIDENCE.items()) + " ELSE 0.5 END END AS DOUBLE) AS confidence FROM "
           "(SELECT project_id, l.* FROM (SELECT DISTINCT project_id FROM sheets), fieldlist l WHERE scope = 'common' UNION ALL SELECT project_id, l.* FROM detected d JOIN fieldlist l ON l.scope = d.code) f LEFT JOIN vals v ON f.project_id = v.project_id AND f.field_id = v.field_id), "
           "missing AS (SELECT project_id, scope, field_id, name, CASE WHEN value IS NULL THEN 'MISSING' ELSE 'LOW_CONFIDENCE' END AS status, CASE WHEN required THEN 'high' ELSE 'medium' END AS severity, confidence FROM prof WHERE value IS NULL OR confidence < 0.6)")
TEXT_CTES = [sql.ENT, sql.ENTR, sql.SHEETS, TEXTS]
FULL = [*cq.DETECTED_CTES, sql.ENT, sql.ENTR, TEXTS, ALIAS, FOUND, FIELDS, SIZES, PROFILE]
IND_CTES = [c for c in mq.TAKEOFF_CTES if c not in FULL]
AUDIT = f"audit AS ({mq.ORACLES['measure_audit'].split(mq.AREAS, 1)[1].strip()})"
METRICS = ["block_total", "length_layers", "area_layers"]
ORACLES = {
    "text_source": sql.query("SELECT * FROM loose", LOOSE),
    "cio_text_source": sql.query("SELECT entity_id, text, source_type, source_ref FROM texts", *TEXT_CTES),
    "work_sources": sql.query("SELECT 'catalog' AS origin, CAST(row_id AS VARCHAR) AS item, discipline AS source_type, drawing_no AS source_ref, drawing_name AS text FROM classified UNION ALL SELECT 'texts', conv_id || ':' || turn, source_type, source_ref, text FROM loose "
                              "UNION ALL SELECT 'drawings', entity_id, source_type, source_ref, text FROM texts UNION ALL SELECT 'materials', m.entity_id, category, e.layer, matched_text FROM mat m JOIN (SELECT entity_id, layer FROM ent) e USING (entity_id)",
                              *cq.CAT_CTES, LOOSE, *TEXT_CTES, *tq.MAT[1:]),
    "alias_extract": sql.query("SELECT * FROM byalias", *TEXT_CTES, ALIAS, FOUND),
    "value_pattern": sql.query("SELECT * FROM bypattern", *TEXT_CTES, ALIAS, FOUND),
    "source_confidence": sql.query("SELECT source_type, count(*) AS n, CAST(CASE source_type WHEN 'TITLE_BLOCK' THEN 0.9 ELSE 0.75 END AS DOUBLE) AS confidence FROM texts GROUP BY source_type", *TEXT_CTES),
    "project_profile": sql.query("SELECT project_id, scope, field_id, name, value, source_type, source_ref, confidence FROM prof", *FULL),
    "profile_stats": sql.query("SELECT project_id, count(*) AS field_total, count(value) AS filled, count(*) FILTER (WHERE value IS NULL) AS missing, count(*) FILTER (WHERE value IS NOT NULL AND confidence > 0 AND confidence < 0.6) AS low_confidence FROM prof GROUP BY project_id", *FULL),
    "review_flag": sql.query("SELECT project_id, scope, field_id, CASE WHEN value IS NULL THEN '未识别（需复核）' WHEN confidence < 0.6 THEN value || '（需复核）' ELSE value END AS display FROM prof", *FULL),
    "missing_items": sql.query("SELECT * FROM missing", *FULL),
    "indicators": sql.query(
        "SELECT metric, CAST(v AS DOUBLE) AS value FROM (SELECT 'block_total' AS metric, (SELECT count(*) FROM detail) AS v UNION ALL SELECT 'length_layers', (SELECT count(*) FROM lengths) UNION ALL SELECT 'area_layers', (SELECT count(*) FROM areas) "
        "UNION ALL SELECT 'sheets', (SELECT sum(total_sheets) FROM sizes) UNION ALL SELECT 'pending', (SELECT count(*) FROM audit WHERE kind = 'pending') UNION ALL SELECT 'unclassified_layers', (SELECT count(*) FROM audit WHERE kind = 'unclassified') "
        "UNION ALL SELECT 'unclassified_entities', (SELECT sum(n) FROM audit WHERE kind = 'unclassified') UNION ALL SELECT 'low_confidence', (SELECT count(*) FROM missing WHERE status = 'LOW_CONFIDENCE') "
        "UNION ALL SELECT 'required_missing', (SELECT count(*) FROM missing WHERE status = 'MISSING' AND severity = 'high')) "
        f"UNION ALL SELECT 'blocks_per_sheet', {sql.rnd('(SELECT count(*) FROM detail) / (SELECT sum(total_sheets) FROM sizes)', 1)}", *FULL, *IND_CTES, AUDIT),
    "pipeline_counts": sql.query("SELECT (SELECT count(*) FROM classified) AS sheets, (SELECT count(DISTINCT discipline) FROM classified) AS disciplines, (SELECT count(DISTINCT block_name) FROM detail) AS block_types, (SELECT count(*) FROM detail) AS block_total",
                            *cq.CAT_CTES, sql.ENT, sql.ENTR, mq.DETAIL),
}
