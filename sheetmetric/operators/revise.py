"""Differences between two revisions of a drawing set.

``entities`` carries a ``revision`` column ('old' or 'new').  Each comparison is one grouped
pass with a count per revision, instead of a full outer join of two snapshots.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.functions.text import nonblank_sql
from sheetmetric.operators.spatial import keep_first

STATUS = "CASE WHEN old_n = 0 THEN 'added' WHEN new_n = 0 THEN 'removed' ELSE 'common' END AS status"


def _compared(rows: DataFrame, item: str) -> DataFrame:
    return rows.groupBy("sheet_id", item).agg(F.expr("count_if(revision = 'old') AS old_n"), F.expr("count_if(revision = 'new') AS new_n"))


def revision_snapshot(entities: DataFrame) -> DataFrame:
    """Layers, entity types, blocks and texts of every revision as (sheet_id, revision, kind, item, n)."""
    items = ("array_compact(array(named_struct('kind', 'layer', 'item', layer), named_struct('kind', 'type', 'item', dxf_type), "
             "CASE WHEN dxf_type = 'INSERT' THEN named_struct('kind', 'block', 'item', block_name) END, "
             f"CASE WHEN dxf_type IN ('TEXT', 'MTEXT') AND {nonblank_sql('label_text')} THEN named_struct('kind', 'text', 'item', trim(label_text)) END))")
    return entities.selectExpr("sheet_id", "revision", f"inline({items})").groupBy("sheet_id", "revision", "kind", "item").agg(F.count("*").alias("n"))


def revision_layers(entities: DataFrame) -> DataFrame:
    return _compared(entities, "layer").selectExpr("sheet_id", "layer", STATUS)


def revision_blocks(entities: DataFrame) -> DataFrame:
    """Blocks added, removed or with another count."""
    rows = _compared(entities.where("dxf_type = 'INSERT'"), "block_name").where("old_n <> new_n")
    return rows.selectExpr("sheet_id", "block_name", "CASE WHEN old_n = 0 THEN 'added' WHEN new_n = 0 THEN 'removed' ELSE 'count_changed' END AS status", "old_n", "new_n")


def revision_entity_types(entities: DataFrame) -> DataFrame:
    return _compared(entities, "dxf_type")


def _texts(entities: DataFrame) -> DataFrame:
    rows = entities.where(f"dxf_type IN ('TEXT', 'MTEXT') AND {nonblank_sql('label_text')}").selectExpr("sheet_id", "revision", "trim(label_text) AS text")
    return _compared(rows, "text").selectExpr("sheet_id", "text", STATUS).where("status <> 'common'")


def revision_texts(entities: DataFrame) -> DataFrame:
    """Numbers of added and removed texts per sheet."""
    return _texts(entities).groupBy("sheet_id").agg(F.expr("count_if(status = 'added') AS added"), F.expr("count_if(status = 'removed') AS removed"))


def revision_text_samples(entities: DataFrame, keep: int = 20) -> DataFrame:
    return keep_first(_texts(entities), ["sheet_id", "status"], ["text"], keep)
