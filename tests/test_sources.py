"""Files in and out, incremental runs, streaming deployment, and the registry."""
import json

from pyspark.sql import functions as F

from drawing import frame, quantity_drawing, sheet
from sheetmetric.model import adapter
from sheetmetric.operators.classify import with_category
from sheetmetric.queries import collect
from sheetmetric.sources import readers
from sheetmetric.streaming.incremental import process_new_documents


def document(i):
    return {"schema_version": "1.0.0", "project_meta": {"project_id": "P", "source_file": f"S{i}.dxf"}, "global_context": {"units": "mm", "all_layers": ["0"]},
            "parsed_entities": [{"entity_id": f"{i}-{k}", "category": "WALL", "geometry": {"type": "LINE", "coordinates": [[0, 0], [k, 0]], "bbox": [0, 0, k, 0]},
                                 "attributes": {"layer_name": "A-WALL", "dxf_type": "LINE", "raw_attribs": {"A": "1"}}} for k in range(2)]}


def test_read_cio(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps(document(i), indent=1))
    (tmp_path / "broken.json").write_text("{not json")
    broken = readers.broken_documents(readers.read_documents(spark, str(tmp_path))).collect()
    assert [(r.file.rsplit("/", 1)[-1], r.content) for r in broken] == [("broken.json", "{not json")]
    rows = readers.read_cio(spark, str(tmp_path)).orderBy("entity_id").collect()
    assert [(r.entity_id, r.seq, r.layer, len(r.points)) for r in rows] == [("0-0", 0, "A-WALL", 2), ("0-1", 1, "A-WALL", 2), ("1-0", 0, "A-WALL", 2), ("1-1", 1, "A-WALL", 2)]


def test_stream_takes_every_document_once(spark, tmp_path):
    """Three documents in a file, a broken one among them; restarts; and files of one document."""
    for lines in (True, False):
        inbox, state, seen, bad = tmp_path / f"in{lines}", str(tmp_path / f"state{lines}"), [], []
        inbox.mkdir()
        handle = lambda df, n: seen.extend((r.entity_id, r.seq) for r in df.select("entity_id", "seq").collect())
        broken = lambda df, n: bad.extend((r.file.rsplit("/", 1)[-1], r.content) for r in df.collect())
        run = lambda: process_new_documents(spark, str(inbox), state, handle, broken, lines=lines).awaitTermination(120)
        if lines:
            (inbox / "0.json").write_text("\n".join(json.dumps(document(i)) for i in range(3)))
            run()
            assert sorted(seen) == [(f"{i}-{k}", k) for i in range(3) for k in range(2)] and bad == []
            (inbox / "1.json").write_text("\n".join([json.dumps(document(3)), "{not json", json.dumps(document(4))]))
            run()
            assert bad == [("1.json", "{not json")]
            run()
        else:
            (inbox / "0.json").write_text(json.dumps(document(0), indent=1))
            run()
            (inbox / "1.json").write_text("{not\njson")
            for i in range(1, 5):
                (inbox / f"d{i}.json").write_text(json.dumps(document(i), indent=1))
            run()
            assert bad == [("1.json", "{not\njson")]
        assert sorted(seen) == [(f"{i}-{k}", k) for i in range(5) for k in range(2)]


def test_stream_reads_what_is_written(spark, tmp_path):
    rows, seen = frame(spark, quantity_drawing(1) + quantity_drawing(2)), []
    layers = spark.createDataFrame([(1, 0, "0", False, False)], "sheet_id BIGINT, pos BIGINT, name STRING, is_off BOOLEAN, is_frozen BOOLEAN")
    blocks = spark.createDataFrame([(1, 0, "KZ1")], "sheet_id BIGINT, pos BIGINT, block_name STRING")
    readers.write_cio(with_category(rows), sheet(spark, ids=(1, 2)), layers, blocks, str(tmp_path / "in"), part_size=7)
    process_new_documents(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda df, n: seen.extend(r.entity_id for r in df.collect()), lambda df, n: None).awaitTermination(120)
    assert sorted(seen) == sorted(r.entity_id for r in rows.collect())


def test_listing_and_increment(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.dxf", "y.PDF", "z.txt"):
        (tmp_path / name).write_text("x" * 10)
    files = readers.list_files(spark, str(tmp_path))
    inventory = readers.file_inventory(files.withColumn("entity_count", F.lit(50001).cast("long")))
    assert {(r.format, r.is_large) for r in inventory.collect()} == {("dxf", True), ("pdf", True)}
    done = files.withColumn("fingerprint", F.expr(readers.fingerprint_sql("v1"))).withColumn("outputs_exist", F.expr("path LIKE '%dxf'"))
    assert {r.path.rsplit("/", 1)[1] for r in readers.incremental_sheets(files, done, "v1").collect()} == {"y.PDF", "z.txt"}
    assert readers.incremental_sheets(files, done, "v2").count() == 3


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("一", 1.5), ("b,c", None)], "name STRING, v DOUBLE")
    readers.write_csv_table(df, str(tmp_path / "c"))
    readers.write_json_table(df, str(tmp_path / "j"))
    assert set(readers.read_csv_table(spark, str(tmp_path / "c"), "name STRING, v DOUBLE").collect()) == set(df.collect())
    assert set(readers.read_json_table(spark, str(tmp_path / "j"), "name STRING, v DOUBLE").collect()) == set(df.collect())


def test_every_query_has_reference_sql():
    queries, oracles = collect()
    assert len(queries) > 150 and set(oracles) == set(queries)


def test_documents_written_and_read_back(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    readers.write_cio(with_category(adapter.entities(spark, sf)), adapter.sheets(spark, sf), adapter.layers(spark, sf), adapter.block_definitions(spark, sf), str(tmp_path / "d"))
    documents = readers.read_documents(spark, str(tmp_path / "d"), lines=True)
    assert readers.broken_documents(documents).collect() == []
    context = readers.sheet_context(documents).first()
    assert context["all_layers"] and set(context["layers_off"]) <= set(context["all_layers"]) and context["block_definitions"]
    assert readers.read_cio(spark, str(tmp_path / "d"), lines=True).count() == adapter.entities(spark, sf).join(adapter.sheets(spark, sf), "sheet_id").count()


def test_large_sheet_is_written_in_parts(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    one = adapter.entities(spark, sf).withColumn("sheet_id", F.lit(adapter.sheets(spark, sf).first().sheet_id))
    tied = with_category(one.limit(300).withColumn("seq", F.expr("CASE WHEN seq % 3 = 0 THEN 7L WHEN seq % 3 = 1 THEN 8L ELSE seq END")).localCheckpoint())
    path, size = str(tmp_path / "d"), 7
    readers.write_cio(tied, adapter.sheets(spark, sf), adapter.layers(spark, sf), adapter.block_definitions(spark, sf), path, part_size=size)
    documents = readers.read_documents(spark, path, lines=True)
    assert sorted(r.n for r in documents.selectExpr("size(parsed_entities) AS n").collect()) == sorted([size] * (300 // size) + [300 % size])
    assert readers.sheet_context(documents).count() == 1
    want = [r.entity_id for r in tied.orderBy("seq", "entity_id").collect()]
    found = readers.read_cio(spark, path, lines=True).orderBy("seq").collect()
    assert [(r.seq, r.entity_id) for r in found] == list(enumerate(want))
