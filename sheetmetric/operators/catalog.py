"""Drawing catalogs and text tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetmetric.functions.text import contains_any_sql, first_group_sql, nonblank_sql, raw
from sheetmetric.model import fixed
from sheetmetric.session import cut_lineage


def _structured(df: DataFrame) -> DataFrame:
    """From no, name, r1, r2, last (first, second and last remaining cell) to the catalog fields."""
    return df.selectExpr(
        "*", "CASE WHEN r1 RLIKE r'^[0-9]+$' THEN r1 ELSE '' END AS item_no", "coalesce(no, '未识别') AS drawing_no",
        "coalesce(name, r2, last, '未识别') AS drawing_name").drop("no", "name", "r1", "r2", "last")


def catalog_rows(rows: DataFrame) -> DataFrame:
    """Cells of a catalog table row to item number, drawing number and drawing name; row 0 is the header."""
    cells = rows.where("row_index > 0").withColumn("c", F.expr("filter(transform(cells, c -> trim(c)), c -> c <> '')")).where("size(c) > 0")
    named = cells.withColumns({
        "no": F.expr(f"get(filter(c, v -> v RLIKE {raw(fixed.CATALOG_NO_PATTERN)}), 0)"),
        "name": F.expr(f"get(filter(c, v -> {contains_any_sql('v', fixed.CATALOG_NAME_KEYWORDS)}), 0)")})
    rest = named.withColumn("rest", F.expr("filter(c, v -> v <> coalesce(no, '') AND v <> coalesce(name, ''))"))
    out = rest.selectExpr("table_id", "row_index", "no", "name", "get(rest, 0) AS r1", "get(rest, 1) AS r2", "try_element_at(rest, -1) AS last")
    return _structured(out)


def table_types(rows: DataFrame) -> DataFrame:
    """Kind of every table by keywords in its header and first three rows (blank rows dropped)."""
    w = Window.partitionBy("table_id").orderBy("row_index")
    texts = rows.selectExpr("table_id", "row_index", "array_join(transform(cells, c -> trim(c)), ' ') AS t").where(nonblank_sql("t"))
    ranks = first_group_sql("t", [(str(i), words) for i, (_, words) in enumerate(fixed.TABLE_TYPES)])
    head = texts.withColumn("rn", F.row_number().over(w)).where("rn <= 4")
    return head.groupBy("table_id").agg(F.expr(f"min(int({ranks})) AS r")).selectExpr(
        "table_id", "CASE r " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(fixed.TABLE_TYPES)) + " ELSE '通用表' END AS table_type")


def row_anchors(texts: DataFrame, tolerance: float) -> DataFrame:
    """Row of every distinct y of a sheet: (sheet_id, y, row_y).

    Reading downwards, a row goes on while its distance to the row's first y is under the tolerance: the next row
    starts at the highest y at least a tolerance below.  That successor is found in tolerance-wide buckets (in the
    bucket of ``y - tolerance``, else at the top of the bucket below), and the first ys are what is reached from the
    top of each gap-free run by successors, in rounds that double the steps.  No run is gathered anywhere.
    """
    at = ["sheet_id", "b"]
    bucket = lambda y: F.expr(f"floor({y} / {tolerance}D)").alias("b")
    ys = texts.select("sheet_id", "y").where("y IS NOT NULL").distinct().select("*", bucket("y"))
    down = Window.partitionBy("sheet_id").orderBy(F.desc("b"))
    buckets = (ys.groupBy(*at).agg(F.min("y").alias("lo"), F.max("y").alias("hi")).withColumn("above", F.lag("lo").over(down))
               .selectExpr("sheet_id", "b", "hi", f"above IS NULL OR hi <= above - {tolerance}D AS top"))
    buckets = cut_lineage(buckets)
    tops = buckets.where("top").selectExpr("sheet_id", "hi AS y")
    found = F.last("y", ignorenulls=True).over(Window.partitionBy(*at).orderBy("v", F.expr("y IS NULL")).rowsBetween(Window.unboundedPreceding, 0))
    asked = ys.selectExpr("sheet_id", f"y - {tolerance}D AS v", "y AS source").select("sheet_id", bucket("v"), "v", F.lit(None).cast("double").alias("y"), "source")
    same = ys.selectExpr("sheet_id", "b", "y AS v", "y", "CAST(NULL AS DOUBLE) AS source").unionByName(asked).withColumn("next", found).where("source IS NOT NULL")
    below = buckets.selectExpr("sheet_id", "b + 1 AS b", "hi AS below")
    steps = (same.join(below, at, "left").selectExpr("sheet_id", "source AS y", "coalesce(next, below) AS next").where("next IS NOT NULL")
             .join(tops.withColumnRenamed("y", "next"), ["sheet_id", "next"], "left_anti").select("sheet_id", "y", "next"))
    firsts = _reached(cut_lineage(tops), cut_lineage(steps))
    near = firsts.select("sheet_id", F.col("y").alias("row_y"), F.expr(f"explode(sequence(floor((y - {tolerance}D) / {tolerance}D), floor(y / {tolerance}D)))").alias("b"))
    return ys.join(near, at).where("row_y >= y").groupBy("sheet_id", "y").agg(F.min("row_y").alias("row_y"))


def _reached(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """Ys that successors lead to from the starts: after k rounds all within 2^k steps, while a jump grows to 2^k steps."""
    while True:
        jumped = starts.join(steps, ["sheet_id", "y"]).selectExpr("sheet_id", "next AS y").distinct()
        new = cut_lineage(jumped.join(starts, ["sheet_id", "y"], "left_anti"))
        if new.isEmpty():
            return starts
        starts = starts.unionByName(new)
        further = steps.selectExpr("sheet_id", "y AS next", "next AS further")
        steps = cut_lineage(steps.join(further, ["sheet_id", "next"]).selectExpr("sheet_id", "y", "further AS next"))


def row_cluster(texts: DataFrame, tolerance: float) -> DataFrame:
    """Texts with the row they belong to; rows read by descending row_y, cells by x."""
    return texts.join(row_anchors(texts, tolerance), ["sheet_id", "y"])


def drawing_texts(entities: DataFrame) -> DataFrame:
    return entities.where("dxf_type IN ('TEXT', 'MTEXT')").selectExpr(
        "sheet_id", "seq", "entity_id", "trim(coalesce(label_text, '')) AS text", "points[0].x AS x", "points[0].y AS y")


def text_catalog(entities: DataFrame, tolerance: float = 80.0) -> DataFrame:
    """Catalog rows of the sheets whose texts carry a catalog title.

    Works on single cells with aggregates; a row is never gathered into one array.
    """
    texts = drawing_texts(entities)
    titled = texts.where(contains_any_sql("text", fixed.CATALOG_TITLES)).select("sheet_id").distinct()
    cells = row_cluster(texts.join(titled, "sheet_id", "left_semi"), tolerance)
    header = cells.groupBy("sheet_id").agg(F.max("row_y").alias("top"))
    body = cells.join(header, "sheet_id").where("row_y < top AND text <> ''")
    key = "struct(x, seq, entity_id)"
    named = body.groupBy("sheet_id", "row_y").agg(
        F.expr(f"min_by(text, {key}) FILTER (WHERE text RLIKE {raw(fixed.CATALOG_NO_PATTERN)}) AS no"),
        F.expr(f"min_by(text, {key}) FILTER (WHERE {contains_any_sql('text', fixed.CATALOG_NAME_KEYWORDS)}) AS name"))
    rest = body.join(named, ["sheet_id", "row_y"]).where("text <> coalesce(no, '') AND text <> coalesce(name, '')")
    w = Window.partitionBy("sheet_id", "row_y").orderBy("x", "seq", "entity_id")
    first_two = (rest.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("sheet_id", "row_y")
                 .agg(F.expr("max(CASE WHEN rn = 1 THEN text END) AS r1"), F.expr("max(CASE WHEN rn = 2 THEN text END) AS r2")))
    last = rest.groupBy("sheet_id", "row_y").agg(F.expr(f"max_by(text, {key}) AS last"))
    joined = named.join(first_two, ["sheet_id", "row_y"], "left").join(last, ["sheet_id", "row_y"], "left")
    return _structured(joined).select("sheet_id", "row_y", "item_no", "drawing_no", "drawing_name")


def pdf_catalog(tables: DataFrame) -> DataFrame:
    """First catalog table among the PDF tables of every set: (project_id, page, item_no, drawing_no, drawing_name).

    ``tables``: project_id, file, page, table_id, page_text, row_index, cells.  A table counts if its page names a
    catalog, two of its rows hold text, and its header names drawing numbers or its first column shows one in the
    next five rows.  Rows are numbered within a table, which a page bounds.
    """
    filled = tables.where(contains_any_sql("page_text", fixed.CATALOG_TITLES)).withColumn("cells", F.expr("transform(cells, c -> trim(coalesce(c, '')))")).where("exists(cells, c -> c <> '')")
    rows = filled.withColumn("row_index", F.row_number().over(Window.partitionBy("table_id").orderBy("row_index")) - 1)
    headed, numbered = "row_index = 0 AND contains(array_join(cells, ' '), '图号')", f"row_index > 0 AND cells[0] RLIKE {raw(fixed.CATALOG_NO_PATTERN)}"
    fit = rows.where("row_index <= 5").groupBy("project_id", "file", "page", "table_id").agg(F.count("*").alias("n"), F.expr(f"bool_or(({headed}) OR ({numbered})) AS fits"))
    first = fit.where("n >= 2 AND fits").groupBy("project_id").agg(F.min(F.struct("file", "page", "table_id")).alias("t")).selectExpr("project_id", "t.page", "t.table_id")
    return catalog_rows(rows.join(first.select("table_id"), "table_id", "left_semi")).join(first, "table_id").select(
        "project_id", "page", "item_no", "drawing_no", "drawing_name")


NUMBERED_AT_ONCE = 4096           # sheet ids that are numbered in one task


def _numbered(sheets: DataFrame) -> DataFrame:
    """Sheets with their number ``i`` within the set, from 1 by sheet id; a large set is numbered in blocks of ids."""
    blocks = sheets.withColumn("block", F.expr(f"floor(sheet_id / {NUMBERED_AT_ONCE})"))
    before = blocks.groupBy("project_id", "block").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("project_id").orderBy("block")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("project_id", "block").orderBy("sheet_id"))
    return blocks.withColumn("place", place).join(before, ["project_id", "block"]).withColumn("i", F.expr("before + place")).drop("block", "place", "before")


def catalog_extract(entities: DataFrame, sheets: DataFrame, title_fields: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Catalog of every drawing set (project): its first PDF catalog table, else its first sheet with a text table, else rebuilt from title blocks.

    Rebuilt rows are numbered by sheet; rows of PDF tables belong to no sheet.  ``tables`` as ``pdf_catalog`` takes them.
    """
    columns = ["project_id", "sheet_id", "item_no", "drawing_no", "drawing_name", "spec", "note", "source"]
    sets = sheets.select("project_id", "sheet_id", "source_file")
    found = []
    if tables is not None:
        pdf = cut_lineage(pdf_catalog(tables))
        found.append(pdf.selectExpr("project_id", "CAST(NULL AS BIGINT) AS sheet_id", "item_no", "drawing_no", "drawing_name", "'' AS spec", "'' AS note", "concat('PDF第', page, '页') AS source"))
        sets = sets.join(pdf.select("project_id").distinct(), "project_id", "left_anti")
    # sheets of sets that have a catalog already are not searched
    texts = cut_lineage(text_catalog(entities.join(sets.select("sheet_id"), "sheet_id", "left_semi")).join(sets, "sheet_id"))
    first = texts.groupBy("project_id").agg(F.min("sheet_id").alias("sheet_id"))
    found.append(texts.join(first, ["project_id", "sheet_id"], "left_semi").selectExpr(
        "project_id", "sheet_id", "item_no", "drawing_no", "drawing_name", "'' AS spec", "'' AS note", "'TEXT_TABLE' AS source"))
    rebuilt = _numbered(sets.join(first, "project_id", "left_anti")).join(title_fields, "sheet_id", "left")
    found.append(rebuilt.selectExpr("project_id", "sheet_id", "CAST(i AS STRING) AS item_no", "coalesce(drawing_no, '未识别') AS drawing_no", "coalesce(drawing_name, '未识别') AS drawing_name",
                                    "coalesce(scale, '') AS spec", "'图框识别补建' AS note", "source_file AS source"))
    out = found[0].select(*columns)
    for part in found[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def out_of_catalog(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose base name is no catalog number."""
    base = files.withColumn("base", F.expr(r"regexp_extract(path, r'([^/]*?)(?:\.[^./]*)?$', 1)"))
    numbers = catalog.where("drawing_no <> '未识别'").select(F.col("drawing_no").alias("base")).distinct()
    return base.join(numbers, "base", "left_anti").select("path", "base")
