"""Property graph of drawings: nodes, edges, keyword search and reachability."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmetric.functions.text import expand_keyword, let_sql, raw, string_array, token_match_sql
from sheetmetric.model import fixed
from sheetmetric.operators.classify import categorized, category_counts
from sheetmetric.operators.places import PLACE, PlaceGraph, reach
from sheetmetric.session import cut_lineage, stored, write_table

NODE_COLUMNS = ["node_id", "sheet_id", "node_type", "name", "category", "sub_category", "layer", "block_name", "label", "key", "value"]


def _nodes(df: DataFrame, **exprs) -> DataFrame:
    types = {"sheet_id": "BIGINT"}
    return df.selectExpr(*[f"CAST({exprs.get(c, 'NULL')} AS {types.get(c, 'STRING')}) AS {c}" for c in NODE_COLUMNS])


PLACE_ID = "concat('PLACE::', sheet_id, '::', {0}, '::', {1})"


def graph_nodes(entities: DataFrame, sheets: DataFrame, physical: PlaceGraph | None = None) -> DataFrame:
    """Project, Drawing, Layer, Component and Attribute nodes with their properties; Place nodes of a physical graph."""
    names = sheets.select("sheet_id", "source_file")
    projects = _nodes(sheets.select("project_id").distinct(), node_id="project_id", node_type="'Project'")
    drawings = _nodes(sheets, node_id="concat('DRAWING::', source_file)", sheet_id="sheet_id", node_type="'Drawing'", name="source_file")
    layers = _nodes(entities.select("sheet_id", "layer").distinct().join(names, "sheet_id"), node_id="concat('LAYER::', source_file, '::', layer)",
                    sheet_id="sheet_id", node_type="'Layer'", name="layer")
    components = _nodes(categorized(entities), node_id="entity_id", sheet_id="sheet_id", node_type="'Component'", category="category",
                        sub_category="sub_category", layer="layer", block_name="block_name",
                        label="coalesce(nullif(label_text, ''), nullif(block_name, ''), category)")
    attributes = _nodes(attribute_rows(entities), node_id="concat('ATTR::', entity_id, '::', key)", sheet_id="sheet_id", node_type="'Attribute'", key="key", value="value")
    found = projects.unionByName(drawings).unionByName(layers).unionByName(components).unionByName(attributes)
    if physical is None:
        return found
    return found.unionByName(_nodes(physical.members.select(*PLACE).distinct(), node_id=PLACE_ID.format("x", "y"), sheet_id="sheet_id", node_type="'Place'"))


def attribute_rows(entities: DataFrame) -> DataFrame:
    return entities.where("dxf_type = 'INSERT'").select("sheet_id", "entity_id", F.explode("attribs").alias("key", "value")).where("trim(value) <> ''")


def graph_edges(entities: DataFrame, sheets: DataFrame, physical: PlaceGraph) -> DataFrame:
    """Directed edges (src, dst, relation), each once; physical ones lead from entities to places and between places (see ``places``)."""
    names = sheets.select("sheet_id", "source_file")
    drawing = "concat('DRAWING::', source_file)"
    located = entities.select("sheet_id", "entity_id", "layer").join(names, "sheet_id")
    used = entities.select("sheet_id", "layer").distinct().join(names, "sheet_id")
    parts = [sheets.selectExpr("project_id AS src", f"{drawing} AS dst", "'CONTAINS' AS relation"),
             used.selectExpr(f"{drawing} AS src", "concat('LAYER::', source_file, '::', layer) AS dst", "'HAS_LAYER' AS relation"),
             # both edges of an entity from one pass over it
             located.selectExpr("entity_id AS src", "inline(array(named_struct('dst', concat('LAYER::', source_file, '::', layer), 'relation', 'LOCATED_IN'), "
                                f"named_struct('dst', {drawing}, 'relation', 'BELONGS_TO')))"),
             attribute_rows(entities).selectExpr("entity_id AS src", "concat('ATTR::', entity_id, '::', key) AS dst", "'HAS_ATTRIBUTE' AS relation"),
             physical.members.selectExpr("entity_id AS src", f"{PLACE_ID.format('x', 'y')} AS dst", "role AS relation"),
             physical.links.selectExpr(f"{PLACE_ID.format('x', 'y')} AS src", f"{PLACE_ID.format('x2', 'y2')} AS dst", "relation")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


STRUCTURED = "concat_ws(' ', coalesce(block_name, ''), coalesce(category, ''), coalesce(sub_category, ''), coalesce(name, ''), coalesce(key, ''))"
FREE = "concat_ws(' ', coalesce(label, ''), coalesce(value, ''))"


def graph_find(nodes: DataFrame, keyword: str, node_types=None) -> DataFrame:
    """Nodes of a drawing matching a keyword or its synonyms.

    Structured fields first; free text counts only where a drawing has no structured hit.
    """
    words = expand_keyword(keyword)
    rows = nodes.where("sheet_id IS NOT NULL")
    if node_types:
        rows = rows.where(F.col("node_type").isin(list(node_types)))
    # stored, so that every node is tested once
    hits = stored(rows.withColumn("strict", F.expr(token_match_sql(STRUCTURED, words)))
                       .where(f"strict OR {token_match_sql(FREE, words)}"))
    found = hits.groupBy("sheet_id").agg(F.expr("bool_or(strict) AS any_strict"))
    return hits.join(found, "sheet_id").where("strict = any_strict").drop("strict", "any_strict")


def graph_count(nodes: DataFrame, keyword: str) -> DataFrame:
    return graph_find(nodes, keyword, ["Component"]).groupBy("sheet_id", "category").agg(F.count("*").alias("n"))


def graph_khop(anchors: DataFrame, physical: PlaceGraph, hops: int = 3) -> DataFrame:
    """Entities within ``hops`` physical links of every anchor: shortest hop and relation of the last link."""
    return reach(physical, anchors, hops)


def graph_connected_query(nodes: DataFrame, physical: PlaceGraph, anchor: str, target: str, hops: int = 3) -> DataFrame:
    """Components matching ``target`` reachable from those matching ``anchor``, nearest first."""
    reach = graph_khop(graph_find(nodes, anchor, ["Component"]), physical, hops)
    structured = "concat_ws(' ', coalesce(block_name, ''), coalesce(category, ''), coalesce(sub_category, ''), coalesce(name, ''))"
    targets = nodes.where(token_match_sql(structured, expand_keyword(target))).select(F.col("node_id").alias("node"), "label")
    return reach.join(targets, "node").selectExpr("anchor AS anchor_id", "node AS target_id", "label AS target", "hop AS hops", "relation AS edge_type").orderBy("hops", "anchor_id", "target_id")


def graph_stats(entities: DataFrame, sheets: DataFrame, physical: PlaceGraph, top: int = 15) -> DataFrame:
    """Totals, node types, relations and the most frequent component categories as (metric, item, n).

    The same counts as over ``graph_nodes`` and ``graph_edges``, from the tables themselves: no id is built to be counted.
    """
    count = F.count("*").alias("n")
    known = sheets.groupBy("sheet_id").agg(F.count("*").alias("drawings"))
    used = entities.groupBy("sheet_id", "layer").agg(count).join(known, "sheet_id")
    by_layer = used.agg(F.coalesce(F.sum("drawings"), F.lit(0)).alias("layers"), F.coalesce(F.sum(F.col("n") * F.col("drawings")), F.lit(0)).alias("located"))
    kinds = lambda df, *pairs: df.selectExpr("inline(array(" + ", ".join(f"named_struct('kind', '{kind}', 'item', '{item}', 'n', CAST({sql} AS BIGINT))" for kind, item, sql in pairs) + "))")
    per_category = category_counts(entities).groupBy("category").agg(F.sum("n").alias("n")).withColumns({"kind": F.lit("category"), "item": F.col("category")}).select("kind", "item", "n")
    parts = [
        kinds(sheets.agg(count, F.count_distinct(F.struct("project_id")).alias("p")), ("node_type", "Project", "p"), ("node_type", "Drawing", "n"), ("relation", "CONTAINS", "n")),
        kinds(by_layer, ("node_type", "Layer", "layers"), ("relation", "HAS_LAYER", "layers"), ("relation", "LOCATED_IN", "located"), ("relation", "BELONGS_TO", "located")),
        kinds(attribute_rows(entities).agg(count), ("node_type", "Attribute", "n"), ("relation", "HAS_ATTRIBUTE", "n")),
        physical.counts,
        per_category,
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = cut_lineage(rows.where("n > 0"))         # some forty rows
    components = rows.where("kind = 'category'").agg(F.sum("n").alias("n")).where("n > 0").selectExpr("'node_type' AS kind", "'Component' AS item", "n")
    counts = rows.where("kind <> 'category'").unionByName(components)
    totals = counts.groupBy("kind").agg(F.sum("n").alias("n")).selectExpr("CASE kind WHEN 'node_type' THEN 'total_nodes' ELSE 'total_edges' END AS metric", "'' AS item", "n")
    first = rows.where("kind = 'category'").orderBy(F.desc("n"), "item").limit(top)
    return totals.unionByName(counts.selectExpr("kind AS metric", "item", "n")).unionByName(first.selectExpr("kind AS metric", "item", "n"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    write_table(nodes, f"{path}/nodes")
    write_table(edges, f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def expand_keywords_sql(phrase: str) -> str:
    """A phrase with the synonyms of every dictionary word it contains; case-insensitively distinct, in order."""
    entries = ", ".join(f"named_struct('k', {raw(k)}, 't', {string_array(terms)})" for k, terms in fixed.SYNONYMS)
    found = f"concat(array(trim({phrase})), flatten(transform(filter(array({entries}), e -> contains({phrase}, e.k)), e -> e.t)))"
    return let_sql(found, "w", "filter(w, (t, i) -> array_position(transform(w, x -> upper(x)), upper(t)) = i + 1)")
