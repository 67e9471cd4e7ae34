"""Wall time of the headline queries: prints one JSON line."""
import json
import os
import time

from sheetmetric.model import adapter
from sheetmetric.queries import collect
from sheetmetric.session import build_session

HEADLINE = ["merge_quantities", "scale_calibration", "block_counts", "layer_length", "entity_category", "discipline_vote", "material_summary", "keyword_freq",
            "wbs_tree", "cross_layer_proximity", "topology_connected", "bbox_clash", "process_counts", "rule_summary", "graph_stats", "detect_spaces",
            "project_profile", "pdf_totals", "revision_snapshot", "validate_contract"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = collect()[0]
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()      # start the engine
    times = {}
    start = time.time()
    adapter.entities(spark, sf_dir)                                # derives and writes the entity table
    times["ingest_entities"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
