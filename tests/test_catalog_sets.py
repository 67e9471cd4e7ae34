"""Catalog of a drawing set: PDF table first, then the first sheet with a text table, else title blocks."""
from drawing import frame, row, sheet
from sheetmetric.operators import catalog

TABLE = "project_id STRING, file STRING, page INT, table_id BIGINT, page_text STRING, row_index INT, cells ARRAY<STRING>"
FIELDS = "sheet_id BIGINT, drawing_no STRING, drawing_name STRING, scale STRING"


def _tables(spark, project="P1"):
    rows = [(project, "b.pdf", 1, 1, "图纸目录", i, c) for i, c in enumerate([["图号", "图名"], ["B-1", "x"]])]
    rows += [(project, "a.pdf", 2, 2, "图纸目录", i, c) for i, c in enumerate([["", None], ["序号", "图号", "图名"], ["1", "建施-01", "一层平面图"], [" ", "", ""], ["2", "建施-02", "楼梯详图"]])]
    rows += [(project, "a.pdf", 1, 3, "说明", i, c) for i, c in enumerate([["图号"], ["建施-09"]])]          # no catalog page
    rows += [(project, "a.pdf", 1, 4, "图纸目录", i, c) for i, c in enumerate([["a", "b"], ["c", "d"]])]      # no drawing numbers
    rows += [(project, "a.pdf", 1, 5, "图纸目录", 0, ["图号"])]                                               # a header alone
    return spark.createDataFrame(rows, TABLE)


def _texts(sheet_id, cells):
    return [row(i, "TEXT", "T", [(x, y)], sheet_id=sheet_id, label_text=t, height=100.0) for i, (x, y, t) in enumerate(cells)]


def _catalog(spark, rows, tables, ids=(1, 2, 3)):
    fields = spark.createDataFrame([(2, "建施-05", "屋面图", "1:100")], FIELDS)
    found = catalog.catalog_extract(frame(spark, rows), sheet(spark, ids=ids), fields, tables)
    return sorted((r.sheet_id or 0, r.item_no, r.drawing_no, r.drawing_name, r.spec, r.source) for r in found.collect())


TEXT = _texts(2, [(0, 1000, "图纸目录"), (0, 500, "1"), (100, 500, "建施-03"), (200, 500, "二层平面图")]) + _texts(
    3, [(0, 1000, "图纸目录"), (0, 500, "9"), (100, 500, "建施-09"), (200, 500, "三层平面图")])


def test_first_pdf_table_stands_for_the_set(spark):
    assert _catalog(spark, TEXT, _tables(spark)) == [(0, "1", "建施-01", "一层平面图", "", "PDF第2页"), (0, "2", "建施-02", "楼梯详图", "", "PDF第2页")]


def test_text_table_of_the_first_sheet_without_pdf(spark):
    want = [(2, "1", "建施-03", "二层平面图", "", "TEXT_TABLE")]
    assert _catalog(spark, TEXT, _tables(spark).where("false")) == want
    assert _catalog(spark, TEXT, None) == want


def test_rebuilt_rows_are_numbered_over_blocks_of_sheets(spark):
    ids = (1, 2, 5000, 9000)
    got = _catalog(spark, _texts(1, [(0, 0, "x")]), _tables(spark, "P2").where("table_id = 4"), ids)
    assert [(r[0], r[1]) for r in got] == [(1, "1"), (2, "2"), (5000, "3"), (9000, "4")]
    assert got[1] == (2, "2", "建施-05", "屋面图", "1:100", "S2.dxf") and got[0][2:4] == ("未识别", "未识别")


def test_no_sheets_and_no_tables(spark):
    empty = catalog.catalog_extract(frame(spark, TEXT).where("false"), sheet(spark).where("false"), spark.createDataFrame([], FIELDS), _tables(spark).where("false"))
    assert empty.collect() == []
