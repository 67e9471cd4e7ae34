"""Vector pages: text channel and measured line work (PDF points at a drawing scale)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.functions.geometry import polygon_area_sql, polyline_length_sql
from sheetmetric.functions.numbers import exact_sum, half_up
from sheetmetric.model import fixed
from sheetmetric.operators.spatial import keep_first

TOTALS = ["pages", "vector_pages", "scanned_pages", "text_char_count", "line_count", "line_length_m", "rect_count", "rect_perimeter_m",
          "rect_area_m2", "curve_count", "curve_length_m", "curve_area_m2"]


def length_m(points: str, scale: float) -> str:
    return f"({points} * {fixed.POINT_MM * scale / 1000.0!r}D)"


def area_m2(points2: str, scale: float) -> str:
    mm = fixed.POINT_MM * scale
    return f"({points2} * {mm * mm / 1e6!r}D)"


def page_channels(pages: DataFrame) -> DataFrame:
    """Vector page if its stripped text is longer than the threshold, else scanned."""
    return pages.selectExpr("file", "page", "CAST(length(trim(text)) AS BIGINT) AS char_count",
                            f"CASE WHEN length(trim(text)) > {fixed.VECTOR_TEXT_CHARS} THEN 'vector' ELSE 'scanned' END AS channel")


def file_channels(channels: DataFrame) -> DataFrame:
    return channels.groupBy("file").agg(F.count("*").alias("total_pages"), F.expr("count_if(channel = 'vector') AS vector_pages"),
                                        F.expr("count_if(channel = 'scanned') AS scanned_pages"),
                                        F.expr("count_if(channel = 'vector') BETWEEN 1 AND count(*) - 1 AS is_mixed"))


def measured(primitives: DataFrame) -> DataFrame:
    """Length, perimeter and area of every primitive in points."""
    w, h = "abs(x1 - x0)", "abs(y1 - y0)"
    return primitives.selectExpr(
        "file", "page", "kind", "prim_id", "linewidth",
        f"CASE kind WHEN 'line' THEN sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) WHEN 'rect' THEN 2 * ({w} + {h}) ELSE {polyline_length_sql('pts', 'false')} END AS len",
        f"CASE kind WHEN 'rect' THEN {w} * {h} WHEN 'curve' THEN CASE WHEN fill THEN {polygon_area_sql('pts')} ELSE 0D END ELSE 0D END AS area")


def on_vector_pages(primitives: DataFrame, channels: DataFrame) -> DataFrame:
    return primitives.join(channels.where("channel = 'vector'").select("file", "page"), ["file", "page"], "left_semi")


def page_measure(primitives: DataFrame, channels: DataFrame, scale: float = 1.0) -> DataFrame:
    """Counts, lengths and areas per page; scanned pages and pages without line work give zeros."""
    total = lambda kind, col: exact_sum(F.expr(f"CASE WHEN kind = '{kind}' THEN {col} END")).cast("double")
    sums = measured(primitives).groupBy("file", "page").agg(
        *[F.expr(f"count_if(kind = '{k}') AS {k}_count") for k in ("line", "rect", "curve")],
        total("line", "len").alias("line_len"), total("rect", "len").alias("rect_len"), total("rect", "area").alias("rect_area"),
        total("curve", "len").alias("curve_len"), total("curve", "area").alias("curve_area"))
    pages = channels.join(sums, ["file", "page"], "left")
    seen = lambda c: f"CASE WHEN channel = 'vector' THEN coalesce({c}, 0) ELSE 0 END"
    metres = lambda c: half_up(F.expr(length_m(f"CAST({seen(c)} AS DOUBLE)", scale)), 3)
    square = lambda c: half_up(F.expr(area_m2(f"CAST({seen(c)} AS DOUBLE)", scale)), 3)
    return pages.select("file", "page", "channel", "char_count", F.expr(f"{seen('line_count')} AS line_count"), metres("line_len").alias("line_length_m"),
                        F.expr(f"{seen('rect_count')} AS rect_count"), metres("rect_len").alias("rect_perimeter_m"), square("rect_area").alias("rect_area_m2"),
                        F.expr(f"{seen('curve_count')} AS curve_count"), metres("curve_len").alias("curve_length_m"), square("curve_area").alias("curve_area_m2"))


def line_widths(primitives: DataFrame, scale: float = 1.0, keep: int = 10) -> DataFrame:
    """Longest line widths per page (three decimals)."""
    stats = (measured(primitives.where("kind = 'line'")).groupBy("file", "page", half_up(F.coalesce("linewidth", F.lit(0.0)), 3).alias("width_pt"))
             .agg(F.count("*").alias("n"), exact_sum(F.col("len")).cast("double").alias("len")))
    rows = stats.select("file", "page", "width_pt", "n", half_up(F.expr(length_m("len", scale)), 3).alias("length_m"))
    return keep_first(rows, ["file", "page"], [F.desc("length_m"), "width_pt"], keep)


def top_areas(primitives: DataFrame, scale: float = 1.0, keep: int = 10) -> DataFrame:
    """Largest rectangles per page."""
    rects = measured(primitives.where("kind = 'rect'")).where("area > 0")
    best = keep_first(rects, ["file", "page"], [F.desc("area"), "prim_id"], keep)
    return best.select("file", "page", "rank", "prim_id", half_up(F.expr(area_m2("area", scale)), 3).alias("area_m2"))


def totals(page_rows: DataFrame, keys=("file",)) -> DataFrame:
    """Twelve totals over pages; ``keys=()`` gives the total over all files."""
    rows = page_rows.selectExpr(*keys, "1L AS pages", "CASE WHEN channel = 'vector' THEN 1L ELSE 0L END AS vector_pages", "CASE WHEN channel = 'scanned' THEN 1L ELSE 0L END AS scanned_pages",
                                "char_count AS text_char_count", *[c for c in TOTALS[4:]])
    agg = [half_up(exact_sum(F.col(c)), 3).alias(c) if c.endswith(("_m", "_m2")) else F.sum(c).alias(c) for c in TOTALS]
    return rows.groupBy(*keys).agg(*agg)
