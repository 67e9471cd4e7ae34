"""Rounding, sums beyond decimals, box candidates, ties of the vote, long labels."""
import random

from pyspark.sql import functions as F

from drawing import frame, quantity_drawing, row, sheet
from sheetmetric.functions import grid, numbers
from sheetmetric.operators import classify, graph, inspect, measure, profile
from sheetmetric.operators.calibrate import scale_calibration
from sheetmetric.plans.quantities import Takeoff
from sheetmetric.session import cut_lineage


def test_rounded_once(spark):
    df = spark.createDataFrame([(2.4949996,), (2.495,), (-2.495,), (1e40,), (None,)], "v double")
    assert [r[0] for r in df.select(numbers.half_up(F.col("v"), 2)).collect()] == [2.49, 2.5, -2.5, 1e40, None]


def test_sums_leave_out_what_no_decimal_holds(spark):
    df = spark.createDataFrame([(1.5,), (1e30,), (2.25,), (None,)], "v double")
    assert df.select(numbers.exact_sum(F.col("v")).cast("double"), numbers.out_of_range(F.col("v"))).first() == (3.75, 1)


def boxes(spark, rows, p):
    return spark.createDataFrame(rows, f"sheet_id long, {p}id long, {p}xmin double, {p}ymin double, {p}xmax double, {p}ymax double")


def test_dense_sheet_has_few_candidates(spark):
    draw = random.Random(1)

    def small(n):
        return [(1, i, x, y, x + 100.0, y + 100.0) for i in range(n) for x, y in [(draw.uniform(0, 42_000), draw.uniform(0, 30_000))]]
    left, right = boxes(spark, small(2000), "l"), boxes(spark, small(2000), "r")
    met = sum(grid._with_cells(left, "l", *a).join(grid._with_cells(right, "r", *b), ["sheet_id", "level", "cx", "cy"]).count() for a, b in (((0, 0), (0, None)), ((1, None), (0, 0))))
    assert met < 40 * 2000


def test_mixed_boxes_against_brute_force(spark):
    draw = random.Random(2)

    def mixed(n):
        rows = []
        for i in range(n):
            x, y, w, h = draw.uniform(-1e5, 1e5), draw.uniform(-1e5, 1e5), 10 ** draw.uniform(0, 6), 10 ** draw.uniform(0, 6)
            rows.append((i % 2, i, x, y, x + w, y + h))
        return rows + [(0, n, 1e12, 1e12, 1e12, 1e12), (0, n + 1, -1e12, -1e12, 1e12, 1e12)]
    left, right = mixed(120), mixed(120)
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= b[4] and a[4] >= b[2] and a[3] <= b[5] and a[5] >= b[3])
    found = grid.overlapping_boxes(boxes(spark, left, "l"), boxes(spark, right, "r")).select("lid", "rid")
    assert sorted(map(tuple, found.collect())) == want


def test_vote_ties_go_to_the_first_hit(spark):
    first, second = list(classify.fixed.CONTENT_WEIGHTS)[:2]

    def word(discipline, weight):
        return next(w for w, v in classify.fixed.CONTENT_WEIGHTS[discipline]["layer"].items() if v == weight)
    weight = next(v for v in classify.fixed.CONTENT_WEIGHTS[first]["layer"].values() if v in classify.fixed.CONTENT_WEIGHTS[second]["layer"].values())
    rows = [(1, "layer", word(second, weight), 1, 0), (1, "layer", word(first, weight), 1, 5), (2, "layer", word(first, weight), 1, 0), (2, "layer", word(second, weight), 1, 5)]
    df = spark.createDataFrame(rows, "sheet_id long, kind string, name string, n long, first long")
    votes = {r["sheet_id"]: r["primary_discipline"] for r in classify.discipline_vote(df).collect()}
    assert votes == {1: second, 2: first}


def test_words_late_in_a_label_are_found(spark):
    rows = [("e1", "Component", "x " * 60 + "照明灯具")]
    nodes = spark.createDataFrame(rows, "node_id string, node_type string, label string").selectExpr(*[c if c in ("node_id", "node_type", "label") else ("1L AS sheet_id" if c == "sheet_id" else f"CAST(NULL AS STRING) AS {c}") for c in graph.NODE_COLUMNS])
    assert graph.graph_find(nodes, "灯具", ["Component"]).count() == 1


def test_audit_tells_of_values_beyond_a_sum(spark):
    rows = [row(1, "LINE", "A-WALL", [(0, 0), (1e23, 0)]), row(2, "LINE", "A-WALL", [(0, 0), (5, 0)]), row(3, "LWPOLYLINE", "S-BEAM", [(0, 0), (1e12, 0), (1e12, 1e12), (0, 1e12)], closed=True)]
    calibration = spark.createDataFrame([(1, None)], "sheet_id BIGINT, pending STRING")
    audit = measure.measure_audit(frame(spark, rows), calibration).where("kind = 'out_of_range'").collect()
    assert sorted((r.role, r.item, r.n) for r in audit) == [("AREA", "S-BEAM", 1), ("LENGTH", "A-WALL", 1)]


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_indicators_read_every_input_once(spark, tmp_path):
    """Entities are read at most six times for all ten numbers; an empty drawing set gives zeros and no ratio."""
    frame(spark, quantity_drawing()).write.parquet(str(tmp_path / "e"))
    entities, sheets = spark.read.parquet(str(tmp_path / "e")), sheet(spark)
    take = Takeoff(entities, sheets, cut_lineage(scale_calibration(sheets, entities)))
    missing = spark.createDataFrame([("P1", "MISSING", "high"), ("P1", "LOW_CONFIDENCE", "medium")], "project_id STRING, status STRING, severity STRING")
    sizes = spark.createDataFrame([("P1", 4)], "project_id STRING, total_sheets BIGINT")
    found = profile.indicators(take.summary(), measure.measure_audit(entities, take.calibration), sizes, missing)
    assert _scans(found) <= 6
    got = {r.metric: r.value for r in found.collect()}
    assert len(got) == 10 and (got["sheets"], got["low_confidence"], got["required_missing"]) == (4.0, 1.0, 1.0)
    assert got["block_total"] > 0 and got["blocks_per_sheet"] == round(got["block_total"] / 4 + 1e-9, 1)
    none = Takeoff(entities.where("false"), sheets.where("false"))
    empty = {r.metric: r.value for r in profile.indicators(none.summary(), measure.measure_audit(none.entities, none.calibration), sizes.where("false"), missing.where("false")).collect()}
    assert empty.pop("blocks_per_sheet") is None and set(empty.values()) == {0.0} and len(empty) == 9


def test_block_references_keep_layers_keys_and_first_samples(spark):
    rows = [row(i, "INSERT", "L1" if i % 3 else "L0", [(i, i)], block_name="B" if i < 8 else None, attribs={"B": str(i), "A": "x"} if i in (2, 3, 5, 6) else {}) for i in range(10)]
    got = {r.block_name: r for r in inspect.block_references(frame(spark, rows), 3).collect()}
    assert (got["B"].n, got["B"].layers, got["B"].with_attribs, got["B"].attribute_keys) == (8, "L0×3；L1×5", 4, "A；B")
    assert got["B"].attribute_samples == "A=x；B=2 | A=x；B=3 | A=x；B=5"
    assert (got["UNKNOWN"].n, got["UNKNOWN"].attribute_keys, got["UNKNOWN"].attribute_samples) == (2, "", "")
    quick = {(r.kind, r.name): r for r in measure.quantity_quick(frame(spark, rows)).collect()}
    assert quick["block", "B"].layers == "L0×3；L1×5" and quick["block", "UNKNOWN"].total == 2.0


def test_work_sources_take_a_raw_catalog_too(spark):
    catalog = spark.createDataFrame([(1, "A-01", "Plan")], "row_id BIGINT, drawing_no STRING, drawing_name STRING")
    texts = spark.createDataFrame([("t", "x", "TEXT", "f")], "item STRING, text STRING, source_type STRING, source_ref STRING")
    labels = spark.createDataFrame([("e1", "label", "CIO_TEXT", "f:L")], "entity_id STRING, text STRING, source_type STRING, source_ref STRING")
    materials = spark.createDataFrame([("e1", "STEEL", "L", "HRB400")], "entity_id STRING, category STRING, layer STRING, matched_text STRING")
    got = {(r.origin, r.item, r.source_type, r.source_ref, r.text) for r in profile.work_sources(catalog, texts, labels, materials).collect()}
    assert got == {("catalog", "1", "", "A-01", "Plan"), ("texts", "t", "TEXT", "f", "x"), ("drawings", "e1", "CIO_TEXT", "f:L", "label"), ("materials", "e1", "STEEL", "L", "HRB400")}
