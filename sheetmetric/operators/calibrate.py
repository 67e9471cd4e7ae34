"""Scale calibration of a sheet from its unit, scale text and title frame."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmetric.functions.geometry import bbox_sql
from sheetmetric.functions.numbers import half_up
from sheetmetric.functions.text import map_sql
from sheetmetric.model import fixed
from sheetmetric.operators.measure import layer_role


def lookup(values: dict, key: str) -> Column:
    """Value of ``key`` in a literal map, null when absent."""
    return F.expr(f"try_element_at({map_sql(values)}, {key})")


def unit_factor(sheets: DataFrame) -> DataFrame:
    named = sheets.select("sheet_id", F.coalesce(lookup(fixed.INSUNITS, "CAST(insunits AS INT)"), F.lit("unitless")).alias("drawing_unit"))
    return named.withColumn("unit_factor_to_mm", lookup(fixed.UNIT_FACTOR_MM, "drawing_unit"))


def scale_texts(entities: DataFrame) -> DataFrame:
    """Every '1:N' with N >= 1 in the texts, in drawing order."""
    texts = entities.where(F.col("dxf_type").isin("TEXT", "MTEXT") & F.col("label_text").rlike(fixed.SCALE_PATTERN))
    whole = F.regexp_extract_all("label_text", F.lit(fixed.SCALE_PATTERN), 0)
    ratio = F.regexp_extract_all("label_text", F.lit(fixed.SCALE_PATTERN), 1)
    return (texts.select("sheet_id", "seq", "entity_id", "layer", F.posexplode(F.arrays_zip(whole.alias("m"), ratio.alias("v"))).alias("pos", "hit"))
            .select("sheet_id", "seq", "entity_id", "layer", "pos", F.translate("hit.m", " ", "").alias("scale_text"),
                    F.col("hit.v").cast("double").alias("scale_ratio"))
            .where("scale_ratio >= 1"))


def scale_mode(entities: DataFrame) -> DataFrame:
    """Most frequent ratio per sheet; ties go to one seen on a frame layer, then to the first."""
    is_frame = (layer_role() == "FRAME").cast("int")
    counted = scale_texts(entities).groupBy("sheet_id", "scale_ratio").agg(
        F.count("*").alias("n"), F.max(is_frame).alias("frame"), F.min(F.struct("seq", "entity_id", "pos")).alias("first"),
        F.min_by("scale_text", F.struct("seq", "entity_id", "pos")).alias("scale_text"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("frame")).alias("f"), "first", "scale_ratio", "scale_text"))
    return counted.groupBy("sheet_id").agg(best.alias("b")).select(
        "sheet_id", "b.scale_ratio", "b.scale_text", (-F.col("b.n")).alias("occurrences"))


def frame_bbox(entities: DataFrame) -> DataFrame:
    """Box of the largest closed frame polyline, else of everything on frame layers."""
    rows = entities.where(layer_role() == "FRAME").withColumn("box", F.expr(bbox_sql(text_extent=True))).where("box.xmin IS NOT NULL")
    closed = F.col("dxf_type").isin("LWPOLYLINE", "POLYLINE") & F.col("closed")
    area = (F.col("box.xmax") - F.col("box.xmin")) * (F.col("box.ymax") - F.col("box.ymin"))
    largest = F.min(F.when(closed & (area > 0), F.struct((-area).alias("k"), "seq", "entity_id", "box")))
    grouped = rows.groupBy("sheet_id").agg(
        largest.alias("best"), F.min("box.xmin").alias("a"), F.min("box.ymin").alias("b"), F.max("box.xmax").alias("c"), F.max("box.ymax").alias("d"))
    pick = lambda f, alt: F.coalesce(F.col(f"best.box.{f}"), F.col(alt)).alias(f)
    return grouped.select("sheet_id", pick("xmin", "a"), pick("ymin", "b"), pick("xmax", "c"), pick("ymax", "d"))


def paper_match(long: str, short: str, ratio: str) -> Column:
    """Struct(paper, frame_paper_ratio, aspect_matched) for a frame; five papers, an array expression.

    With a scale ratio the paper whose long-side ratio is closest wins and must be within
    tolerance; without one the largest paper of matching aspect wins.
    """
    papers = ", ".join(f"named_struct('i', {i}, 'paper', '{n}', 'long', {a}D, 'aspect', {a}D / {b}D)" for i, (n, a, b) in enumerate(fixed.PAPERS[::-1]))
    fitting = (f"filter(array({papers}), p -> abs(CASE WHEN {short} > 0 THEN {long} / {short} ELSE 0D END / p.aspect - 1) <= {fixed.ASPECT_TOLERANCE}D)")
    best = (f"array_min(transform({fitting}, p -> named_struct('k', CASE WHEN {ratio} IS NULL THEN -p.long ELSE abs({long} / p.long - {ratio}) END, "
            f"'i', p.i, 'paper', p.paper, 'fpr', {long} / p.long)))")
    fpr = f"CAST(CAST(CAST(b.fpr AS DECIMAL(38,6)) AS DECIMAL(38,3)) AS DOUBLE)"
    return F.expr(f"transform(array({best}), b -> named_struct('paper', CASE WHEN {ratio} IS NULL OR abs(b.fpr / {ratio} - 1) <= {fixed.RATIO_TOLERANCE}D THEN b.paper END, "
                  f"'frame_paper_ratio', {fpr}, 'aspect_matched', b IS NOT NULL))[0]")


def scale_calibration(sheets: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per sheet: geometry state, factor to millimetres, evidence, status, confidence, pending reason."""
    frame = frame_bbox(entities).select("sheet_id", F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).alias("long"),
                                        F.least(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")).alias("short"))
    base = (unit_factor(sheets).join(frame, "sheet_id", "left").join(scale_mode(entities), "sheet_id", "left")
            .withColumn("m", F.when(F.expr("long IS NOT NULL AND scale_ratio IS NOT NULL"), paper_match("long", "short", "scale_ratio"))))
    has_frame, has_scale = F.col("long").isNotNull(), F.col("scale_ratio").isNotNull()
    fpr = F.col("m.frame_paper_ratio")
    tol = fixed.RATIO_TOLERANCE
    case = (F.when(has_frame & has_scale,
                   F.when(F.col("m.paper").isNotNull() & (F.abs(fpr / F.col("scale_ratio") - 1.0) <= tol), "MODEL")
                   .when(F.col("m.aspect_matched") & (F.abs(fpr - 1.0) <= tol), "PAPER").otherwise("CONFLICT"))
            .when(has_frame, F.when(F.col("long") >= fixed.MODEL_MIN_FRAME_LONG_MM, "FRAME_SIZE").otherwise("FRAME_ONLY"))
            .when(has_scale, "TEXT_ONLY").otherwise("NONE"))
    outcome = {  # case: state, evidence, detail, status, confidence, pending
        "MODEL": ("MODEL_1_TO_1", "TITLE_BLOCK", "FRAME_VS_PAPER", "OK", 0.95, None),
        "PAPER": ("PAPER_SCALED", "TITLE_BLOCK", "FRAME_VS_PAPER", "OK", 0.9, None),
        "CONFLICT": ("UNKNOWN", "ASSUMED", "FRAME_SCALE_CONFLICT", "PENDING_CONFLICT", 0.2, "FRAME_SCALE_CONFLICT"),
        "FRAME_SIZE": ("MODEL_1_TO_1", "INSUNITS", "FRAME_SIZE", "OK", 0.75, None),
        "FRAME_ONLY": ("UNKNOWN", "ASSUMED", "FRAME_ONLY", "PENDING_ASSUMED", 0.35, "FRAME_ONLY"),
        "TEXT_ONLY": ("UNKNOWN", "TITLE_BLOCK", "TITLE_SCALE_TEXT_ONLY", "PENDING_ASSUMED", 0.4, "TITLE_SCALE_TEXT_ONLY"),
        "NONE": ("UNKNOWN", "ASSUMED", "NO_SCALE_EVIDENCE", "PENDING_ASSUMED", 0.3, "NO_SCALE_EVIDENCE"),
    }
    field = lambda i: lookup({k: v[i] for k, v in outcome.items() if v[i] is not None}, "case")
    unitless = F.col("drawing_unit") == "unitless"
    status, confidence = field(3), field(4)
    model = F.when(F.col("case") == "PAPER", F.col("scale_ratio")).otherwise(1.0)
    return base.withColumn("case", case).select(
        "sheet_id", "drawing_unit", "unit_factor_to_mm", "scale_text", "scale_ratio", field(0).alias("geometry_state"),
        model.alias("model_factor"), half_up(F.col("unit_factor_to_mm") * model, 6).alias("factor_to_mm"),
        field(1).alias("calibrated_by"), field(2).alias("calibrated_by_detail"),
        F.when(unitless & (status == "OK"), "PENDING_ASSUMED").otherwise(status).alias("status"),
        F.when(unitless, F.least(confidence, F.lit(0.6))).otherwise(confidence).alias("confidence"),
        F.col("m.paper").alias("paper"), fpr.alias("frame_paper_ratio"), field(5).alias("pending"))


def factors(calibration: DataFrame) -> DataFrame:
    return calibration.select("sheet_id", "factor_to_mm")
