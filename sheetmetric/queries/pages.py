"""Queries of the vector-page operators."""
from pyspark.sql import functions as F

from sheetmetric.functions.numbers import half_up
from sheetmetric.model import adapter, fixed
from sheetmetric.operators import pages as p
from sheetmetric.queries import sql

SCALE = 100.0


def page_rows(spark, sf):
    return p.page_measure(adapter.pdf_primitives(spark, sf), p.page_channels(adapter.pdf_pages(spark, sf)), SCALE)


def vector(spark, sf):
    return p.on_vector_pages(adapter.pdf_primitives(spark, sf), p.page_channels(adapter.pdf_pages(spark, sf)))


def _units(spark, sf):
    rows = p.measured(adapter.pdf_primitives(spark, sf))
    return rows.select("prim_id", half_up(F.expr(p.length_m("len", 50.0)), 3).alias("length_m"), half_up(F.expr(p.area_m2("area", 50.0)), 3).alias("area_m2"))


QUERIES = {
    "page_channel": lambda s, d: p.file_channels(p.page_channels(adapter.pdf_pages(s, d))),
    "page_units": _units,
    "pdf_page_measure": page_rows,
    "pdf_line_width": lambda s, d: p.line_widths(vector(s, d), SCALE).withColumn("rank", F.col("rank").cast("long")),
    "top_areas": lambda s, d: p.top_areas(vector(s, d), SCALE).withColumn("rank", F.col("rank").cast("long")),
    "pdf_totals": lambda s, d: p.totals(page_rows(s, d)),
    "pdf_grand_totals": lambda s, d: p.totals(page_rows(s, d), ()),
}

M = ("meas AS (SELECT file, page, kind, prim_id, linewidth, CASE kind WHEN 'line' THEN sqrt(dx * dx + dy * dy) WHEN 'rect' THEN 2 * (dx + dy) ELSE dx + dy END AS len, "
     "CASE WHEN kind = 'rect' THEN dx * dy WHEN kind = 'curve' AND fill THEN dx * dy / 2 ELSE 0.0 END AS area FROM prims), "
     "chan AS (SELECT file, page, length(trim(text)) AS char_count, CASE WHEN length(trim(text)) > 20 THEN 'vector' ELSE 'scanned' END AS channel FROM pdfpages)")


def lm(x, scale):
    return sql.rnd(f"({x}) * {fixed.POINT_MM * scale / 1000.0!r}::DOUBLE", 3)


def am(x, scale):
    return sql.rnd(f"({x}) * {fixed.POINT_MM * scale * fixed.POINT_MM * scale / 1e6!r}::DOUBLE", 3)


def total(kind, col):
    return f"CASE WHEN channel = 'vector' THEN coalesce(CAST(sum(CAST(CASE WHEN kind = '{kind}' THEN {col} END AS DECIMAL(28,6))) AS DOUBLE), 0) ELSE 0 END"


PAGE = ("pg AS (SELECT c.file, c.page, channel, char_count, " + ", ".join(
    f"CASE WHEN channel = 'vector' THEN count(*) FILTER (WHERE kind = '{k}') ELSE 0 END AS {k}_count" for k in ("line", "rect", "curve")) +
    f", {lm(total('line', 'len'), SCALE)} AS line_length_m, {lm(total('rect', 'len'), SCALE)} AS rect_perimeter_m, {am(total('rect', 'area'), SCALE)} AS rect_area_m2, "
    f"{lm(total('curve', 'len'), SCALE)} AS curve_length_m, {am(total('curve', 'area'), SCALE)} AS curve_area_m2 FROM chan c LEFT JOIN meas m ON c.file = m.file AND c.page = m.page GROUP BY c.file, c.page, channel, char_count)")
CTES = [sql.PRIMS, sql.PAGES, M, PAGE]
VEC = "meas JOIN chan USING (file, page)"
SUMS = ("count(*) AS pages, count(*) FILTER (WHERE channel = 'vector') AS vector_pages, count(*) FILTER (WHERE channel = 'scanned') AS scanned_pages, CAST(sum(char_count) AS BIGINT) AS text_char_count, " + ", ".join(
    f"CAST(CAST(sum(CAST({c} AS DECIMAL(28,6))) AS DECIMAL(38,3)) AS DOUBLE) AS {c}" if c.endswith(("_m", "_m2")) else f"CAST(sum({c}) AS BIGINT) AS {c}" for c in p.TOTALS[4:]))
ORACLES = {
    "page_channel": sql.query("SELECT file, count(*) AS total_pages, count(*) FILTER (WHERE channel = 'vector') AS vector_pages, count(*) FILTER (WHERE channel = 'scanned') AS scanned_pages, count(DISTINCT channel) > 1 AS is_mixed FROM chan GROUP BY file", *CTES),
    "page_units": sql.query(f"SELECT prim_id, {lm('len', 50.0)} AS length_m, {am('area', 50.0)} AS area_m2 FROM meas", *CTES),
    "pdf_page_measure": sql.query("SELECT * FROM pg", *CTES),
    "pdf_line_width": sql.query(f"SELECT file, page, width_pt, n, length_m, row_number() OVER (PARTITION BY file, page ORDER BY length_m DESC, width_pt) AS rank FROM (SELECT file, page, {sql.rnd('linewidth', 3)} AS width_pt, count(*) AS n, {lm('CAST(sum(CAST(len AS DECIMAL(28,6))) AS DOUBLE)', SCALE)} AS length_m "
                                f"FROM {VEC} WHERE kind = 'line' AND channel = 'vector' GROUP BY file, page, {sql.rnd('linewidth', 3)}) QUALIFY rank <= 10", *CTES),
    "top_areas": sql.query(f"SELECT file, page, rank, prim_id, {am('area', SCALE)} AS area_m2 FROM (SELECT *, row_number() OVER (PARTITION BY file, page ORDER BY area DESC, prim_id) AS rank FROM {VEC} WHERE kind = 'rect' AND area > 0 AND channel = 'vector') WHERE rank <= 10", *CTES),
    "pdf_totals": sql.query(f"SELECT file, {SUMS} FROM pg GROUP BY file", *CTES),
    "pdf_grand_totals": sql.query(f"SELECT {SUMS} FROM pg", *CTES),
}
