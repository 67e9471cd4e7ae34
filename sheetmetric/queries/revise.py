"""Queries of the revision operators."""
from pyspark.sql import functions as F

from sheetmetric.model import adapter
from sheetmetric.operators import revise as r
from sheetmetric.queries import sql


def _q(fn):
    return lambda s, d: fn(adapter.entities(s, d))


QUERIES = {
    "revision_snapshot": _q(r.revision_snapshot), "revision_layers": _q(r.revision_layers), "revision_blocks": _q(r.revision_blocks),
    "revision_entity_types": _q(r.revision_entity_types), "revision_texts": _q(r.revision_texts),
    "revision_text_samples": lambda s, d: r.revision_text_samples(adapter.entities(s, d)).withColumn("rank", F.col("rank").cast("long")),
}


def full(item, where="true", cols=""):
    side = lambda rev: f"(SELECT sheet_id, {item}, count(*) AS n FROM ent WHERE revision = '{rev}' AND {where} GROUP BY ALL)"
    return f"(SELECT coalesce(o.sheet_id, n.sheet_id) AS sheet_id, coalesce(o.{item}, n.{item}) AS {item}, coalesce(o.n, 0) AS old_n, coalesce(n.n, 0) AS new_n FROM {side('old')} o FULL OUTER JOIN {side('new')} n ON o.sheet_id = n.sheet_id AND o.{item} = n.{item})"


ST = "CASE WHEN old_n = 0 THEN 'added' WHEN new_n = 0 THEN 'removed' ELSE 'common' END"
TXT = full("label_text", "dxf_type = 'TEXT' AND trim(label_text) <> ''")
ORACLES = {
    "revision_snapshot": sql.query("SELECT sheet_id, revision, 'layer' AS kind, layer AS item, count(*) AS n FROM ent GROUP BY ALL UNION ALL SELECT sheet_id, revision, 'type', dxf_type, count(*) FROM ent GROUP BY ALL "
                                   "UNION ALL SELECT sheet_id, revision, 'block', block_name, count(*) FROM ent WHERE dxf_type = 'INSERT' GROUP BY ALL UNION ALL SELECT sheet_id, revision, 'text', trim(label_text), count(*) FROM ent WHERE dxf_type = 'TEXT' AND trim(label_text) <> '' GROUP BY ALL", sql.ENT),
    "revision_layers": sql.query(f"SELECT sheet_id, layer, {ST} AS status FROM {full('layer')}", sql.ENT),
    "revision_blocks": sql.query(f"SELECT sheet_id, block_name, CASE WHEN old_n = 0 THEN 'added' WHEN new_n = 0 THEN 'removed' ELSE 'count_changed' END AS status, old_n, new_n FROM {full('block_name', 'block_name IS NOT NULL')} WHERE old_n <> new_n", sql.ENT),
    "revision_entity_types": sql.query(f"SELECT * FROM {full('dxf_type')}", sql.ENT),
    "revision_texts": sql.query(f"SELECT sheet_id, count(*) FILTER (WHERE old_n = 0) AS added, count(*) FILTER (WHERE new_n = 0) AS removed FROM {TXT} WHERE old_n = 0 OR new_n = 0 GROUP BY sheet_id", sql.ENT),
    "revision_text_samples": sql.query(f"SELECT sheet_id, label_text AS text, {ST} AS status, row_number() OVER (PARTITION BY sheet_id, {ST} ORDER BY label_text) AS rank FROM {TXT} WHERE old_n = 0 OR new_n = 0 QUALIFY rank <= 20", sql.ENT),
}
