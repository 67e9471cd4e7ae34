"""Queries of the process operators."""
from sheetmetric.model import adapter, fixed
from sheetmetric.operators import process as p
from sheetmetric.queries import sql
from sheetmetric.queries.spatial import CATS


def matches(spark, sf):
    return p.process_match(adapter.entities(spark, sf), adapter.sheets(spark, sf))


QUERIES = {
    "process_match": lambda s, d: matches(s, d).select("entity_id", "category", "rule_id"),
    "process_counts": lambda s, d: p.process_counts(matches(s, d)),
    "process_stage": lambda s, d: p.stage_totals(p.process_counts(matches(s, d))),
    "process_by_category": lambda s, d: p.process_by_category(matches(s, d)),
}

PRULES = sql.values("prules", "pos, rule_id, discipline, category, size, kw", [(i, r[0], r[2], r[3], len(r[4]), k.upper()) for i, r in enumerate(fixed.PROCESS_RULES) for k in r[4]])
PROCS = sql.values("procs", "rule_id, process", [(r[0], x) for r in fixed.PROCESS_RULES for x in r[5]])
SEQ = sql.values("seqs", "process, o", list(fixed.PROCESS_SEQUENCE.items()))
MATCH = ("evid AS (SELECT entity_id, upper(coalesce(block_name, '') || ' ' || coalesce(label_text, '') || ' ' || coalesce(attr_spec, '') || ' ' || coalesce(attr_room, '')) AS t FROM ecat "
         "UNION ALL SELECT e.entity_id, upper(t.label_text) FROM ent e JOIN ent t ON e.sheet_id = t.sheet_id AND t.dxf_type = 'TEXT' AND t.label_text <> '' AND e.dxf_type <> 'HATCH' "
         "WHERE (e.x0 - t.x0) * (e.x0 - t.x0) + (e.y0 - t.y0) * (e.y0 - t.y0) <= 64000000), "
         "pmatch AS (SELECT e.entity_id, e.category, r.rule_id FROM ecat e JOIN sheets s USING (sheet_id) JOIN prules r ON r.category = e.category AND (s.discipline IN ('MULTI', 'UNKNOWN', '') OR s.discipline = r.discipline) "
         "JOIN evid v ON v.entity_id = e.entity_id AND contains(v.t, r.kw) QUALIFY row_number() OVER (PARTITION BY e.entity_id ORDER BY r.size DESC, r.pos) = 1), "
         "pcounts AS (SELECT process, count(*) AS occurrence, CAST(coalesce(max(o), 99) AS BIGINT) AS sequence_order FROM pmatch JOIN procs USING (rule_id) LEFT JOIN seqs USING (process) GROUP BY process), "
         "pstaged AS (SELECT *, CASE WHEN sequence_order <= 9 THEN '结构施工阶段' WHEN sequence_order <= 15 THEN '砌筑抹灰阶段' WHEN sequence_order <= 29 THEN '安装施工阶段' ELSE '调试验收阶段' END AS stage FROM pcounts)")
CTES = [sql.ENT, sql.SHEETS, CATS, PRULES, PROCS, SEQ, MATCH]
ORACLES = {
    "process_match": sql.query("SELECT entity_id, category, rule_id FROM pmatch", *CTES),
    "process_counts": sql.query("SELECT * FROM pstaged", *CTES),
    "process_stage": sql.query("SELECT stage, count(*) AS processes, CAST(sum(occurrence) AS BIGINT) AS occurrence FROM pstaged GROUP BY stage", *CTES),
    "process_by_category": sql.query("SELECT category, process, count(*) AS occurrence, max(k) AS entities FROM (SELECT *, count(*) OVER (PARTITION BY category) AS k FROM pmatch) JOIN procs USING (rule_id) GROUP BY category, process", *CTES),
}
