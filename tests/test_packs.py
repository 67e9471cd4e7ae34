"""Dictionaries and rules from files, more rules than one long holds, and merged totals."""
import random

import pytest
from pyspark.errors import AnalysisException

from drawing import frame, quantity_drawing, row, sheet
from sheetmetric.model import fixed
from sheetmetric.operators import classify, measure, process
from sheetmetric.plans.quantities import Takeoff
from sheetmetric.sources import packs


def test_dictionaries_come_back(spark, tmp_path):
    packs.save_dictionaries(spark, classify.DICTIONARIES, str(tmp_path / "d"))
    assert packs.load_dictionaries(spark, str(tmp_path / "d")) == {d: [(k, list(w)) for k, w in g] for d, g in classify.DICTIONARIES.items()}
    packs.save_process_rules(spark, fixed.PROCESS_RULES, str(tmp_path / "r"))
    assert packs.load_process_rules(spark, str(tmp_path / "r")) == [tuple(r) for r in fixed.PROCESS_RULES]


def test_broken_packs_are_errors(spark, tmp_path):
    with pytest.raises(AnalysisException):
        packs.load_dictionaries(spark, str(tmp_path / "none"))
    bad = tmp_path / "bad.json"
    for text in ('{"position": 0, "rule_id": "A"}', '{"position": 0, "rule_id"'):
        bad.write_text(text)
        with pytest.raises(ValueError):
            packs.load_process_rules(spark, str(bad))
    rule = ("A", "a", "STR", "WALL", ["x"], ["p"])
    packs.save_process_rules(spark, [rule, rule], str(tmp_path / "twice"))
    with pytest.raises(ValueError):
        packs.load_process_rules(spark, str(tmp_path / "twice"))


def test_a_foreign_pack_changes_roles_and_categories(spark, tmp_path):
    packs.save_dictionaries(spark, {"role": [("MEASURABLE", ["ROAD"]), ("FRAME", ["BORDER"])], "category": [("BRIDGE", ["VIADUCT"])]}, str(tmp_path / "d"))
    pack = packs.load_dictionaries(spark, str(tmp_path / "d"))
    rows = frame(spark, [row(1, "INSERT", "C-ROAD", [(0, 0)], block_name="VIADUCT"), row(2, "LINE", "A-WALL", [(0, 0), (1, 0)])])
    found = classify.with_category(rows, pack["category"]).withColumn("role", measure.layer_role(groups=pack["role"])).orderBy("seq").collect()
    assert [(r.category, r.role) for r in found] == [("BRIDGE", "MEASURABLE"), ("UNKNOWN", "UNKNOWN")]


def test_two_hundred_rules(spark, tmp_path):
    draw = random.Random(5)
    rules = [(f"R{i:03d}", "n", draw.choice(["STR", "ARCH"]), draw.choice(["WALL", "COLUMN"]), [f"K{i}Z"] + ["EVERY"] * (i % 3), [f"p{i % 7}"]) for i in range(200)]
    packs.save_process_rules(spark, rules, str(tmp_path / "r"))
    rules = packs.load_process_rules(spark, str(tmp_path / "r"))
    rows, texts = [], {}
    for k in range(120):
        category = draw.choice(["WALL", "COLUMN"])
        words = [f"K{draw.randrange(200)}Z" for _ in range(draw.randrange(4))] + ["EVERY"] * (k % 5 == 0)
        at = (k * 50_000.0, 0.0)
        rows.append(row(2 * k, "INSERT", f"S-{category}", [at], block_name="B", entity_id=f"c{k}"))
        rows.append(row(2 * k + 1, "TEXT", "0", [(at[0] + 100, 0)], label_text=" ".join(words) or " "))
        texts[f"c{k}"] = (category, " ".join(words))
    want = {}
    for name, (category, text) in texts.items():
        fit = [r for r in rules if r[3] == category and r[2] == "STR" and any(w in text for w in r[4])]
        if fit:
            want[name] = max(fit, key=lambda r: len(r[4]))[0]
    matches = process.process_match(frame(spark, rows), sheet(spark, discipline="STR"), rules=rules)
    assert {r.entity_id: r.rule_id for r in matches.collect()} == want and len({w for w in want.values()}) > 20
    counts = {r.process: r.occurrence for r in process.process_counts(matches, rules).collect()}
    assert sum(counts.values()) == len(want)


def test_merged_maps_and_scans(spark, tmp_path):
    drawing = quantity_drawing()
    frame(spark, drawing).write.parquet(str(tmp_path / "e"))
    take = Takeoff(spark.read.parquet(str(tmp_path / "e")), sheet(spark))
    totals = take.totals()
    rows = {(r.kind, r.name, r.item): r.quantity for r in totals.collect()}
    assert rows["block", "KZ1", ""] == rows["block_layer", "KZ1", "S-COLUMN"] == 4
    blocks = {k[1] for k in rows if k[0] == "block"}
    for name in blocks:
        for kind in ("block_layer", "block_spec"):
            assert sum(v for k, v in rows.items() if k[:2] == (kind, name)) == rows["block", name, ""]
    lengths = {r.layer: r.total_length_m for r in measure.merge_lengths(take.lengths).collect()}
    areas = {r.layer: r.total_area_m2 for r in measure.merge_areas(take.areas).collect()}
    assert {k[1]: v for k, v in rows.items() if k[0] == "length"} == lengths and {k[1]: v for k, v in rows.items() if k[0] == "area"} == areas
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("parquet") <= 4
