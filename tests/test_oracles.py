"""Registered queries against their reference SQL on the smallest tables."""
import pytest

import check
from sheetmetric.queries import collect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = collect()
# one or more of each area; `python check.py` runs them all
SOME = ["merge_quantities", "scale_calibration", "discipline_vote", "material_extract", "row_cluster", "label_chain", "cross_layer_proximity", "bbox_clash", "process_match",
        "rule_summary", "graph_count", "snap_points", "project_profile", "pdf_totals", "revision_blocks", "sheet_overview", "validate_contract", "read_cio"]


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    problem, _, _ = check.compare(spark, check.connect(SF), QUERIES[name], ORACLES[name], SF)
    assert problem == ""
