"""What is stored and shuffled grows with the input, and no faster."""
import glob
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from drawing import frame, row, sheet
from sheetmetric.model import adapter
from sheetmetric.operators import classify, divisions, graph, places, rules, spatial
from sheetmetric.queries.rules import ALL_RULES
from sheetmetric.queries.sources import QUERIES as SOURCES
from sheetmetric.queries.graph import QUERIES as GRAPH
from sheetmetric.session import FREED, shared_folder, stored

SF = "/root/testdata/sf0.001"


def shuffled(df):
    """Text of the columns that the shuffles of a plan carry: the nodes right below them."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return "\n".join(below for line, below in zip(lines, lines[1:]) if "Exchange" in line)


def test_numbers_stand_for_ids_in_their_order(spark):
    rows = [row(i, "INSERT", "A-DOOR", [(100 * i, 0)], block_name="M1", entity_id=e) for i, e in enumerate(["b", "a", "c", "b", None])]
    found = spatial.topology_candidates(frame(spark, rows)).collect()
    assert len(found) == 5 and {r.num for r in found if r.entity_id is None} == {None}
    numbers = {r.entity_id: r.num for r in found if r.entity_id}
    assert numbers["a"] < numbers["b"] < numbers["c"] and len({r.num for r in found if r.entity_id == "b"}) == 1


def test_no_id_travels_before_a_result_is_named(spark):
    rows = [row(i, "LINE", "P-PIPE", [(0, 100 * i), (9000, 100 * i)]) for i in range(5)] + [row(9, "INSERT", "A-DOOR", [(20000, 0)], block_name="M1")]
    edges, _ = spatial.topology_ranks(frame(spark, rows))
    assert "Exchange" in edges._jdf.queryExecution().executedPlan().toString() and "entity_id" not in shuffled(edges)
    assert "entity_id" not in shuffled(places.place_graph(frame(spark, rows)).steps)


def test_entities_that_stand_alone_make_no_steps(spark):
    rows = [row(i, "INSERT", "A-DOOR", [(10_000 * i, 0)], block_name="M1") for i in range(20)]
    physical = places.place_graph(frame(spark, rows))
    assert physical.steps.count() == 0 and physical.links.count() == 20 and physical.members.count() == 40


@pytest.mark.parametrize("limit", [classify.SMALL_NAMES, 0])
def test_categories_by_distinct_names(spark, monkeypatch, limit):
    monkeypatch.setattr(classify, "SMALL_NAMES", limit)
    names = [("A-WALL", None, None), ("A-WALL", None, ""), ("0", "KZ1", None), ("0", None, "DN100镀锌钢管"), (None, "M1021", None), (None, None, None), ("A-WALL", None, None)]
    df = frame(spark, [row(i, "INSERT", layer, [(0, 0)], block_name=block, label_text=text) for i, (layer, block, text) in enumerate(names)])
    pick = lambda d: sorted(map(tuple, d.select("seq", "layer", "category", "sub_category").collect()))
    assert pick(classify.categorized(df)) == pick(classify.with_category(df)) and len(classify.categorized(df).columns) == len(df.columns) + 2


def test_entities_are_derived_behind_the_shuffles(spark):
    derived = adapter.derived_entities(adapter.dealt_lines(spark, SF))
    carried = shuffled(derived)
    assert "l_orderkey" in carried and not any(c in carried for c in ("entity_id", "points", "attribs", "label_text"))
    assert derived.count() == 6000


def test_sheets_are_dealt_before_they_unfold(spark, monkeypatch):
    monkeypatch.setattr(adapter, "SHEETS_DEALT", 50)
    found = adapter.layers(spark, SF)
    assert found.rdd.getNumPartitions() == 3 and found.count() == 150 * len(adapter.LAYER_NAMES)


def test_votes_are_summed_without_sorting(spark):
    rows = [(1, "layer", "A-WALL", 1, None), (1, "block", "KZ1", 2, 3), (1, "text", "C30", 1, 9), (2, "other", "WALL", 1, 4)]
    scores = classify._scores(spark.createDataFrame(rows, "sheet_id long, kind string, name string, n long, first long"), classify.CODE_WEIGHTS)
    assert "SortAggregate" not in scores._jdf.queryExecution().executedPlan().toString()
    arch = [c for c in scores.columns if c.endswith(" at")]
    assert {r.sheet_id: [r[c] for c in arch if r[c] is not None][:1] for r in scores.collect()}[1][0].kind == 0


def test_nodes_are_tested_once_for_a_keyword(spark):
    nodes = spark.createDataFrame([("n1", 1, "Component", "LIGHT")], "node_id string, sheet_id long, node_type string, block_name string").selectExpr(
        *[c if c in ("node_id", "sheet_id", "node_type", "block_name") else f"CAST(NULL AS STRING) AS {c}" for c in graph.NODE_COLUMNS])
    found = graph.graph_find(nodes, "灯具", ["Component"])
    assert found.count() == 1 and "RLIKE" not in found._jdf.queryExecution().executedPlan().toString()


def test_documents_are_compressed(spark):
    documents = SOURCES["read_cio"](spark, SF)
    assert documents.count() == 6000 and {f.rsplit(".", 2)[1:] == ["json", "gz"] for f in documents.inputFiles()} == {True}


def test_links_of_ends_are_counted_while_surroundings_are_found(spark):
    rows = ([row(i, "LINE", "P-PIPE", [(0, 100 * i), (9000, 100 * i)]) for i in range(5)] + [row(9, "INSERT", "A-DOOR", [(100, 0)], block_name="M1")]
            + [row(20 + i, "TEXT", "0", [(1000 * i, 50000)], label_text="DN100镀锌钢管") for i in range(3)] + [row(30, "LINE", "P-PIPE", [(90000, 0), (90000, 0)], entity_id=None)])
    physical = places.place_graph(frame(spark, rows))
    listed = {(r.relation, r.n) for df in (physical.members.groupBy("role"), physical.links.groupBy("relation")) for r in df.count().toDF("relation", "n").collect()}
    counted = {r.item: r.n for r in physical.counts.collect()}
    assert counted.pop("Place") == physical.members.select(*places.PLACE).distinct().count()
    assert {(k, n) for k, n in counted.items() if n} == listed and counted["CONNECTED"] > 11
    # one join of places for the free ones, none for the ends
    assert physical.counts._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_candidates_are_stored_as_a_table(spark):
    rows = [row(i, "INSERT", "A-DOOR", [(100 * i, 0)], block_name="M1", entity_id=e) for i, e in enumerate(["b", "a", "b", None, None])]
    found = spatial.topology_candidates(frame(spark, rows), ordered=False)
    assert {f.rsplit(".", 2)[1] for f in found.inputFiles()} == {"zstd"}
    numbers = {(r.entity_id, r.num, r.shared) for r in found.collect()}
    assert len(numbers) == 3 and {(e, s) for e, _, s in numbers} == {("a", False), ("b", True), (None, False)}


def test_copies_of_a_tied_id_are_not_free(spark):
    rows = [row(0, "LINE", "P-PIPE", [(0, 0), (9000, 0)], entity_id="a"), row(1, "INSERT", "A-DOOR", [(100, 0)], block_name="M1", entity_id="d"),
            row(2, "INSERT", "A-DOOR", [(70000, 0)], block_name="M1", entity_id="a"), row(3, "LINE", "P-PIPE", [(0, 50000), (9000, 50000)], entity_id="c")]
    members = places.place_graph(frame(spark, rows)).members.where(f"role = '{places.FREE}'").collect()
    assert sorted(r.entity_id for r in members) == ["c", "d"]


def test_label_chains_read_the_entries_once(spark):
    rows = [(1, kind, label, layer, "D", "S", "I") for kind, label, layer in ((0, "a", "A-WALL"), (0, "b", "S-BEAM"), (1, "c", "S-BEAM"), (1, "d", "A-DOOR"), (2, "e", "MYSTERY"))]
    entries = spark.createDataFrame(rows, "sheet_id long, kind int, label string, layer string, division string, sub_division string, item string")
    found = divisions.label_chains(entries, ("sheet_id",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    chain = found.collect()[0]
    first = classify.layer_discipline("layer")
    assert chain.entries == 5 and chain.discipline_name == spark.createDataFrame([("A-WALL",)], "layer string").select(first).first()[0]       # a tie of two goes to the earliest entry
    assert chain.evidence.endswith("LAYER:A-DOOR:1 项；LAYER:A-WALL:1 项；LAYER:MYSTERY:1 项；LAYER:S-BEAM:2 项")
    assert divisions.label_chains(entries, ("sheet_id",), 2).collect()[0].evidence.endswith("；LAYER:A-DOOR:1 项；LAYER:A-WALL:1 项")


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_stored_tables_free_their_shuffles(spark):
    before, kept = shuffle_files(spark), spark.conf.get(FREED)
    found = stored(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").agg(F.count("*").alias("n")))
    left = lambda: shuffle_files(spark) - before
    for _ in range(50):             # they are removed in the background
        if not left():
            break
        time.sleep(0.1)
    assert not left() and found.count() == 7 and spark.conf.get(FREED) == kept


def test_rules_are_counted_without_items(spark):
    rows = ([row(i, "LWPOLYLINE", layer, [(x, 0), (x + 900, 900)], sheet_id=s, entity_id=e) for i, (layer, x, s, e) in enumerate(
                [("P-PIPE", 0, 1, "a"), ("P-PIPE", 100, 1, "b"), ("P-PIPE", 100, 1, "b"), ("S-BEAM", 500, 1, "c"), ("S-BEAM", 500, 1, "d"), ("H-DUCT", 500, 1, None), ("H-DUCT", 99999, 1, "e"), ("P-PIPE", 0, 2, "f")])]
            + [row(20 + i, "INSERT", layer, [(x, 0)], entity_id=e, block_name="B") for i, (layer, x, e) in enumerate([("HYDRANT", 0, "h"), ("HYDRANT", 0, "h"), ("BEAM", 100, "h"), ("BEAM", 100, "i")])])
    none = lambda schema: spark.createDataFrame([], schema)
    ctx = rules.RuleContext(frame(spark, rows), none("sheet_id BIGINT, name STRING, is_off BOOLEAN, is_frozen BOOLEAN"), none("sheet_id BIGINT, block_name STRING"), sheet(spark, ids=(1, 2)))
    total = lambda df: sorted(tuple(r) for r in df.groupBy("sheet_id", "rule_id").agg(F.sum("weight").alias("n")).where("n > 0").collect())
    counted = rules.rule_counts(ctx, ALL_RULES)
    assert counted.columns == ["sheet_id", "rule_id", "weight"] and total(counted) == total(rules.run_rules(ctx, ALL_RULES))
    assert {(1, "CRS002", 3), (1, "FIRE001", 1), (1, "GEO004", 6)} <= set(total(counted))
    # no partner is looked for, and ids are shuffled only with what repeats on a sheet or has a partner
    assert "first" not in shuffled(rules.operator_counts(ctx, "entity_bbox_overlap", {"a": ["PIPE"], "b": ["BEAM"]}))
    assert "first" in shuffled(rules.operator_hits(ctx, "entity_bbox_overlap", {"a": ["PIPE"], "b": ["BEAM"]}))


def test_only_sheets_with_repeated_keys_are_compared(spark):
    rows = [row(i, "INSERT", "0", [(x, 0)], sheet_id=s, block_name="B") for i, (s, x) in enumerate([(1, 0), (1, 0), (1, 5), (2, 0), (2, 5), (3, 7)])]
    ctx = rules.RuleContext(frame(spark, rows), None, None, None)
    found = rules.duplicate_entity(ctx, {})
    assert sorted((r.item, r.weight) for r in found.collect()) == [("e1-00000", 1), ("e1-00001", 0)]
    assert any("stored-" in f for f in found.inputFiles())


def test_listed_pairs_are_found_once_and_the_walk_is_freed(spark):
    rows = [row(i, "LINE", "P-PIPE", [(0, 100 * i), (9000, 100 * i)]) for i in range(5)] + [row(9, "INSERT", "E-LIGHT", [(20000, 0)], block_name="M1"), row(10, "INSERT", "E-LIGHT", [(20500, 0)], block_name="M1")]
    plain, listed = (places.place_graph(frame(spark, rows), listed=x) for x in (False, True))
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (listed.links, listed.steps))
    pick = lambda df: sorted(map(tuple, df.collect()))
    assert pick(plain.links) == pick(listed.links) and pick(plain.steps) == pick(listed.steps) and pick(plain.counts) == pick(listed.counts)
    before = shuffle_files(spark)
    found = places.reach(listed, spark.createDataFrame([("e1-00000",), ("e1-00009",)], "node_id STRING"))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert {r.anchor: n for r, n in ((r, r["count"]) for r in found.groupBy("anchor").count().collect())} == {"e1-00000": 4, "e1-00009": 1}


def test_one_entity_on_two_sheets_is_reached_once(spark):
    """An id on two sheets is one node: what both lead to is named once, at the shortest hop; entities without an id lead nowhere."""
    rows = [row(0, "LINE", "P-PIPE", [(0, 0), (9000, 0)], sheet_id=1, entity_id="a"), row(1, "INSERT", "A-DOOR", [(100, 0)], sheet_id=1, block_name="M1", entity_id="b"),
            row(2, "LINE", "P-PIPE", [(0, 0), (9000, 0)], sheet_id=2, entity_id="a"), row(3, "LINE", "P-PIPE", [(9100, 0), (12500, 0)], sheet_id=2, entity_id="c"),
            row(4, "LINE", "P-PIPE", [(15500, 0), (30000, 0)], sheet_id=2, entity_id=None), row(5, "INSERT", "A-DOOR", [(12600, 0)], sheet_id=2, block_name="M1", entity_id="b"),
            row(6, "INSERT", "A-DOOR", [(30100, 0)], sheet_id=2, block_name="M1", entity_id="d")]
    for listed in (False, True):
        found = places.reach(places.place_graph(frame(spark, rows), listed=listed), spark.createDataFrame([("a",)], "node_id STRING"))
        assert sorted((r.node, r.hop) for r in found.collect()) == [("b", 1), ("c", 1)]


def stored_rows(spark):
    folder = shared_folder(spark).removeprefix("file:")
    return {f: pq.read_metadata(f).num_rows for f in glob.glob(f"{folder}/stored-*/*.parquet")}


def test_a_saved_graph_leaves_no_tables_behind(spark):
    before = stored_rows(spark)
    found = GRAPH["graph_io"](spark, SF)
    assert sum(n for f, n in stored_rows(spark).items() if f not in before) == 0
    assert found.where("relation = 'NEAR' OR node_type = 'Place'").count() > 0 and all(n == stored_rows(spark).get(f) for f, n in before.items())
