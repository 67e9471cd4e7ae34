"""Known results of small drawings."""
import math

import pytest
from pyspark.sql import functions as F

from drawing import frame, quantity_drawing, rect, row, sheet
from sheetmetric.functions.geometry import AREA, LENGTH
from sheetmetric.operators import calibrate, classify, contracts, measure, process, revise, rules, spaces, texts
from sheetmetric.plans.quantities import Takeoff


@pytest.fixture(scope="module")
def takeoff(spark):
    return Takeoff(frame(spark, quantity_drawing()), sheet(spark))


def test_quantities(takeoff):
    assert {r.block_name: r.quantity for r in takeoff.blocks.collect()} == {"KZ1": 4, "香樟": 3, "M1021": 2, "C1515": 2}
    assert {r.layer: r.total_length_m for r in takeoff.lengths.collect()} == {"A-WALL": 31.0, "S-BEAM": 13.0, "P-PIPE": 8.0}
    assert {r.layer: r.total_area_m2 for r in takeoff.areas.collect()} == {"A-WALL": 40.0}
    s = takeoff.summary().collect()[0]
    assert (s.block_types, s.block_total, s.length_layers, s.area_layers) == (4, 11, 3, 1)


def test_calibration(takeoff):
    c = takeoff.calibration.collect()[0]
    assert (c.geometry_state, c.scale_ratio, c.factor_to_mm, c.paper, c.calibrated_by, c.status) == ("MODEL_1_TO_1", 100.0, 1.0, "A3", "TITLE_BLOCK", "OK")


def test_no_scale_evidence(spark):
    c = calibrate.scale_calibration(sheet(spark), frame(spark, [row(1, "LINE", "A-WALL", [(0, 0), (1000, 0)])])).collect()[0]
    assert (c.geometry_state, c.status, c.factor_to_mm, c.pending) == ("UNKNOWN", "PENDING_ASSUMED", 1.0, "NO_SCALE_EVIDENCE")


def test_paper_scaled_sheet(spark):
    rows = [rect(1, "A-FRAME", 0, 0, 297, 210), row(2, "TEXT", "A-FRAME", [(1, 1)], label_text="1:50", height=2.0)]
    c = calibrate.scale_calibration(sheet(spark), frame(spark, rows)).collect()[0]
    assert (c.geometry_state, c.factor_to_mm, c.confidence) == ("PAPER_SCALED", 50.0, 0.9)


def test_unknown_layer_is_reported_not_dropped(spark):
    rows = [row(1, "LINE", "A-WALL", [(0, 0), (2000, 0)]), row(2, "LINE", "MYSTERY", [(0, 0), (9000, 0)])]
    t = Takeoff(frame(spark, rows), sheet(spark))
    assert {r.layer: r.total_length_m for r in t.lengths.collect()} == {"A-WALL": 2.0}
    audit = {(r.kind, r.item): r.n for r in measure.measure_audit(t.entities, t.calibration).collect()}
    assert audit[("unclassified", "MYSTERY")] == 1 and audit[("pending", "UNCLASSIFIED_LAYERS")] == 1


def test_roles(spark):
    want = {"A-FRAME": "FRAME", "A-WALL": "MEASURABLE", "S-COLUMN": "MEASURABLE", "A-DOOR": "MEASURABLE", "S-BEAM": "MEASURABLE", "S-REBAR": "MEASURABLE", "P-PIPE": "MEASURABLE",
            "L-PLANT": "MEASURABLE", "门窗表": "ANNOTATION", "图例": "ANNOTATION", "苗木表": "ANNOTATION", " a-axis ": "AXIS", "": "UNKNOWN", "0": "UNKNOWN"}
    df = spark.createDataFrame([(k,) for k in want], "layer STRING").withColumn("r", measure.layer_role())
    assert {r.layer: r.r for r in df.collect()} == want


def test_lengths_and_areas(spark):
    rows = [rect(1, "x", 0, 0, 8000, 5000), row(2, "HATCH", "x", [(0, 0), (4000, 0), (4000, 3000), (0, 3000)]), row(3, "ARC", "x", [(0, 0)], radius=10.0, start_angle=350.0, end_angle=20.0),
            row(4, "CIRCLE", "x", [(0, 0)], radius=1.0), row(5, "LWPOLYLINE", "x", [(0, 0), (3, 4), (3, 5)]), row(6, "LWPOLYLINE", "x", [(0, 0), (3, 4)], closed=True)]
    got = {r.seq: (r.len, r.area) for r in frame(spark, rows).selectExpr("seq", f"{LENGTH} AS len", f"{AREA} AS area").collect()}
    assert got[1] == (26000.0, 40_000_000.0) and got[2][1] == 12_000_000.0 and got[5] == (6.0, 0.0) and got[6] == (5.0, 0.0)
    assert math.isclose(got[3][0], math.radians(30) * 10) and math.isclose(got[4][0], 2 * math.pi)


def test_component_keywords(spark):
    cases = {"SWITCH_SINGLE": "SWITCH", "LIGHT_LED_PANEL": "LIGHT", "Q235钢板": "UNKNOWN", "阀门": "VALVE", "防火门": "DOOR", "FULLY": "UNKNOWN", "KZ-1": "COLUMN", "KZ1": "UNKNOWN"}
    df = spark.createDataFrame([("0", k, None) for k in cases], "layer STRING, block_name STRING, label_text STRING")
    got = {r.block_name: (r.category, r.sub_category) for r in classify.with_category(df).collect()}
    assert {k: v[0] for k, v in got.items()} == cases and got["LIGHT_LED_PANEL"][1] == "LED_PANEL"


def test_specs_from_attributes(spark):
    df = frame(spark, [row(1, "INSERT", "0", [(0, 0)], block_name="B", attribs={"型号": "X1", "NOTE": "DN50", "ROOM": "101", "SPEC": " "})])
    assert df.selectExpr(f"{measure.spec_from_attribs_sql()} AS s").collect()[0].s in ("X1 / DN50", "DN50 / X1")


def test_materials(spark):
    t = ["C30P6防水混凝土", "DN100镀锌钢管", "Φ12@200", "YJV-4x25+1x16", "无"]
    hits = texts.material_hits(frame(spark, [row(i, "TEXT", "0", [(0, 0)], label_text=s) for i, s in enumerate(t)])).collect()
    by = {(h.category, h.matched_text): dict(h.fields) for h in hits}
    assert by[("混凝土", "C30P6防水混凝土")] == {"强度等级": "C30", "抗渗等级": "P6", "特殊类型": "防水"}
    assert by[("管材", "DN100镀锌钢管")] == {"公称直径": "DN100", "管材": "镀锌钢管"}
    assert by[("钢材", "Φ12@200")] == {"钢筋直径": "Φ12", "间距": "200"}
    assert by[("电缆", "YJV-4x25+1x16")] == {"型号": "YJV", "相线+地线规格": "4x25+1x16"}


def test_rooms(spark):
    # two rooms sharing a wall, a detached room far away, a stray wall end, and an almost closed corner
    rows = [row(1, "LINE", "A-WALL", [(0, 0), (4000, 0)]), row(2, "LINE", "A-WALL", [(4000, 0), (8000, 0)]), row(3, "LINE", "A-WALL", [(8000, 0), (8000, 5000)]),
            row(4, "LINE", "A-WALL", [(8000, 5000), (4000, 5000)]), row(5, "LINE", "A-WALL", [(4000, 5000), (0, 5000)]), row(6, "LINE", "A-WALL", [(0, 5000), (20, 10)]),
            row(7, "LINE", "A-WALL", [(4000, 0), (4000, 5000)]), row(8, "LINE", "A-WALL", [(4000, 5000), (3000, 4000)]), rect(9, "Q-1", 90000, 90000, 3000, 2000),
            row(10, "INSERT", "0", [(1000, 1000)], block_name="B1"), row(11, "INSERT", "0", [(91000, 91000)], block_name="B2"), row(12, "INSERT", "0", [(50000, 0)], block_name="B3"),
            row(13, "TEXT", "0", [(500, 500)], label_text="3.000"), row(14, "TEXT", "0", [(600, 500)], label_text="卧室")]
    e = frame(spark, rows)
    found = spaces.detect_spaces(e)
    assert sorted((r.area, r.vertex_count) for r in found.collect()) == [(6e6, 4), (2e7, 4), (2e7, 4)]
    owner = {r.block_name: r.space_id for r in spaces.component_space(e, found).collect()}
    assert owner["B1"] and owner["B2"] and owner["B3"] is None and owner["B1"] != owner["B2"]
    assert sorted(r.name for r in spaces.space_name(e, found).collect()) == ["", "", "卧室"]


def test_partition_drawn_as_one_line_does_not_divide(spark):
    assert spaces.detect_spaces(frame(spark, quantity_drawing())).count() == 1


def test_process_prefers_most_keywords(spark):
    rows = [row(1, "INSERT", "S-COLUMN", [(0, 0)], block_name="B"), row(2, "TEXT", "0", [(0, 7999)], label_text="Q345钢 C30"), row(3, "INSERT", "S-COLUMN", [(0, 99999)], block_name="B")]
    got = {r.entity_id: r.rule_id for r in process.process_match(frame(spark, rows), sheet(spark, discipline="STR")).collect()}
    assert got == {"e1-00001": "P-ST-002"}
    assert process.process_match(frame(spark, rows), sheet(spark, discipline="ELEC")).count() == 0


def test_rules_and_registration(spark):
    rows = [row(1, "LINE", "0", [(0, 0), (0, 0)]), row(2, "CIRCLE", "A-WALL", [(5, 5)], radius=0.0), row(3, "CIRCLE", "A-WALL", [(5, 5)], radius=9.0),
            row(4, "TEXT", "A-WALL", [(0, 0)], label_text=" ", height=400.0), row(5, "INSERT", "A-WALL", [(1, 1)], block_name="B", attribs={"NO": " "})]
    ctx = rules.RuleContext(frame(spark, rows), spark.createDataFrame([(1, "A-WALL", True, False), (1, "EMPTY", False, True)], "sheet_id BIGINT, name STRING, is_off BOOLEAN, is_frozen BOOLEAN"),
                            spark.createDataFrame([(1, "B"), (1, "C"), (1, "*M")], "sheet_id BIGINT, block_name STRING"), sheet(spark))
    rules.register_rule("long_names", lambda c, p: c.layers.where(F.length("name") > p["n"]).selectExpr("sheet_id", "name AS item", "1L AS weight"))
    chosen = rules.active_rules() + [("OWN1", "own", "layer", "error", True, "long_names", {"n": 5}, "{count} long"), ("OWN2", "own", "layer", "error", True, "no_such", {}, "")]
    hits = rules.run_rules(ctx, chosen)
    results = {r.rule_id: (r["count"], r.message) for r in rules.rule_results(ctx, chosen, hits).collect()}
    assert {k: v[0] for k, v in results.items()} == {"GEO001": 1, "GEO002": 1, "GEO004": 1, "LAY001": 1, "LAY002": 1, "LAY003": 1, "LAY004": 1, "TXT001": 1, "TXT002": 1, "BLK001": 1, "BLK002": 1, "OWN1": 1}
    assert results["TXT001"][1] == "1 处文字高度小于 500.0 图形单位，可能影响打印可读性"
    s = rules.rule_summary(ctx, chosen, rules.rule_results(ctx, chosen, hits)).collect()[0]
    assert (s.total_errors, s.total_warnings, s.rules_executed, s.rules_passed) == (1, 4, 15, 2)


def test_contracts(spark):
    schema = ("line_id STRING, project_code STRING, name STRING, feature STRING, unit STRING, quantity DOUBLE, source_level STRING, evidence ARRAY<STRUCT<type: STRING, ref: STRING>>, confidence DOUBLE")
    ok = ("1", "010101001", "n", "f", "m", 1.0, "DIRECT", [("ENTITY", "e")], 1.0)
    rows = [ok, ("2",) + ok[1:6] + ("GUESS",) + ok[7:], ("3",) + ok[1:7] + ([],) + ok[8:], ("4",) + ok[1:3] + ("",) + ok[4:], ("5", "12") + ok[2:]]
    got = {(r.id, r.path, r.rule) for r in contracts.validate(spark.createDataFrame(rows, schema), "quantity_line", "line_id").collect()}
    assert got == {("2", "source_level", "enum"), ("3", "evidence", "minItems"), ("4", "feature", "minLength"), ("5", "project_code", "pattern")}
    with pytest.raises(KeyError):
        contracts.stamp_version(spark.range(1), "nonsense")


CHAIN = ("discipline STRUCT<code: STRING, name: STRING, confidence: DOUBLE>, unit_work STRUCT<name: STRING, confidence: DOUBLE>, division STRUCT<name: STRING, confidence: DOUBLE>, "
         "subitem STRUCT<name: STRING, confidence: DOUBLE>, acceptance_standard STRING, confidence DOUBLE, evidence ARRAY<STRUCT<type: STRING, ref: STRING>>")
OTHERS = {
    "label_chain": (CHAIN, (("ARCH", "建筑", 0.8), ("u", 0.8), ("d", 0.8), ("s", 1.5), "OTHER", 0.5, []), {("subitem.confidence", "maximum"), ("evidence", "minItems")}),
    "material_line": ("material STRING, spec STRING, unit STRING, quantity DOUBLE, derivation_path ARRAY<STRING>, basis STRING, source_level STRING", ("木", None, "m", 1.0, [], "COUNT", "DIRECT"),
                      {("material", "enum"), ("spec", "required"), ("derivation_path", "minItems")}),
    "drawing_index": ("sheet_id STRING, frame_bbox ARRAY<DOUBLE>, status STRING, entity_count BIGINT, drawing_unit STRING, factor_to_mm DOUBLE, calibrated_by STRING, confidence DOUBLE",
                      ("s", [0.0], "DONE", -1, "mm", 0.0, "INSUNITS", 1.0), {("frame_bbox", "items"), ("status", "enum"), ("entity_count", "minimum"), ("factor_to_mm", "exclusiveMinimum")}),
    "perception_bundle": ("sheet_id STRING, texts ARRAY<STRUCT<text: STRING, entity_id: STRING, source: STRING>>, tables ARRAY<STRUCT<table_id: STRING, kind: STRING>>, "
                          "semantics ARRAY<STRUCT<label: STRING, bbox: ARRAY<DOUBLE>, cross_check_status: STRING>>",
                          ("s", [("t", None, "OCR")], [("t", "REBAR")], [("l", [0.0], "MAYBE")]), {("texts.entity_id", "required"), ("semantics.cross_check_status", "enum")}),
}


@pytest.mark.parametrize("name", OTHERS)
def test_other_contracts(spark, name):
    schema, bad, want = OTHERS[name]
    df = spark.createDataFrame([bad], schema)
    assert {(r.path, r.rule) for r in contracts.validate(df, name, "'x'").collect()} == want


def test_revision(spark):
    rows = [row(1, "INSERT", "A", [(0, 0)], block_name="B"), row(2, "INSERT", "A", [(0, 0)], block_name="B"), row(3, "INSERT", "C", [(0, 0)], block_name="D")]
    df = frame(spark, rows).withColumn("revision", F.expr("CASE WHEN seq = 1 THEN 'old' ELSE 'new' END"))
    assert {(r.block_name, r.status) for r in revise.revision_blocks(df).collect()} == {("D", "added")}
    assert {(r.layer, r.status) for r in revise.revision_layers(df).collect()} == {("A", "common"), ("C", "added")}
