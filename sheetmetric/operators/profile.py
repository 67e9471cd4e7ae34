"""Project facts from texts: fields, sources, confidence, missing items and indicators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmetric.functions.numbers import half_up
from sheetmetric.functions.text import alternation, map_sql, nonblank_sql, raw
from sheetmetric.model import fixed
from sheetmetric.operators.calibrate import lookup


def text_source(rows: DataFrame, keys=()) -> DataFrame:
    """Texts of mixed origin as (text, source_type, source_ref); blank texts are dropped."""
    return rows.selectExpr(*keys, "coalesce(nullif(text, ''), content, '') AS text", "coalesce(source_type, 'TEXT') AS source_type",
                           "coalesce(source_ref, 'texts.json') AS source_ref").where(nonblank_sql("text"))


def cio_text_source(entities: DataFrame, sheets: DataFrame) -> DataFrame:
    """Labels of interchange documents; those on frame layers come from the title block."""
    from sheetmetric.operators.measure import with_role
    rows = with_role(entities.where(nonblank_sql("label_text"))).join(sheets.select("sheet_id", "project_id", "source_file"), "sheet_id")
    return rows.selectExpr("project_id", "seq", "entity_id", "trim(label_text) AS text", "CASE WHEN layer_role = 'FRAME' THEN 'TITLE_BLOCK' ELSE 'CIO_TEXT' END AS source_type",
                           "concat(source_file, ':', layer) AS source_ref")


def text_lines(texts: DataFrame) -> DataFrame:
    """Non-blank lines of every text, in order."""
    lines = texts.selectExpr("project_id", "seq", "entity_id", "source_type", "source_ref", r"posexplode(split(translate(text, '\r', '\n'), '\n')) AS (pos, raw)")
    return lines.selectExpr("project_id", "seq", "entity_id", "pos", "source_type", "source_ref", "trim(raw) AS line").where("line <> ''")


def clean_value_sql(value: str) -> str:
    """Cut at three or more blanks (the next title-block column), strip separators."""
    return f"trim(BOTH ' \\t;；,，' FROM regexp_replace(trim({value}), r'\\s{{3,}}.*$', ''))"


ALIASES = [(f[0], i, a) for f in fixed.PROFILE_COMMON for i, a in enumerate(f[3])] + [
    (f[0], i, a) for fields in fixed.PROFILE_BY_DISCIPLINE.values() for f in fields for i, a in enumerate(f[2])]
ORDER = "seq, entity_id, pos"


def alias_extract(lines: DataFrame) -> DataFrame:
    """Value of every field per project: aliases in declared order, then the first line 'alias: value'.

    Lines without any 'alias:' are dropped by one test before aliases are tried one by one.
    """
    words = sorted({a for _, _, a in ALIASES})
    some = lines.where(f"line RLIKE {raw(f'(?:{alternation(words)})' + chr(92) + 's*[:：]')}")
    entries = ", ".join(f"named_struct('field_id', '{f}', 'alias_pos', {i}, 'alias', {raw(a)})" for f, i, a in ALIASES)
    tried = some.select("*", F.expr(f"inline(filter(array({entries}), a -> contains(line, a.alias)))"))
    value = clean_value_sql("regexp_extract(line, concat(alias, r'\\s*[:：]\\s*(.+)'), 1)")
    found = tried.withColumn("value", F.expr(value)).where("value <> ''")
    return found.groupBy("project_id", "field_id").agg(F.expr(f"min(struct(alias_pos, {ORDER}, value, source_type, source_ref)) AS b")).select(
        "project_id", "field_id", "b.value", "b.source_type", "b.source_ref")


PATTERNS = [(f[0], f[4]) for f in fixed.PROFILE_COMMON if f[4]]


def value_pattern(lines: DataFrame) -> DataFrame:
    """Fields recognisable without a label: first line matching their pattern."""
    entries = ", ".join(f"named_struct('field_id', '{f}', 'value', trim(regexp_extract(line, {raw(p)}, 1)))" for f, p in PATTERNS)
    hits = lines.select("*", F.expr(f"inline(filter(array({entries}), v -> v.value <> ''))"))
    return hits.groupBy("project_id", "field_id").agg(F.expr(f"min(struct({ORDER}, value, source_type, source_ref)) AS b")).select(
        "project_id", "field_id", "b.value", "b.source_type", "b.source_ref")


def source_confidence(source_type: str = "source_type") -> Column:
    return F.coalesce(lookup(fixed.SOURCE_CONFIDENCE, source_type), F.lit(fixed.DEFAULT_SOURCE_CONFIDENCE))


def _field_table(projects: DataFrame, disciplines: DataFrame) -> DataFrame:
    """Expected fields per project: the common ones and those of its disciplines."""
    struct = lambda f, required: f"named_struct('field_id', '{f[0]}', 'name', {raw(f[1])}, 'required', {str(required).lower()})"
    common = projects.select("project_id", F.lit("common").alias("scope"), F.expr(
        f"inline(array({', '.join(struct(f, f[2]) for f in fixed.PROFILE_COMMON)}))"))
    arms = " ".join(f"WHEN '{code}' THEN array({', '.join(struct(f, False) for f in fields)})" for code, fields in fixed.PROFILE_BY_DISCIPLINE.items())
    extra = disciplines.select("project_id", F.col("code").alias("scope"), F.expr(f"inline(CASE code {arms} END)"))
    return common.unionByName(extra)


def project_profile(texts: DataFrame, sheets: DataFrame, disciplines: DataFrame, catalog_sizes: DataFrame) -> DataFrame:
    """One row per project and field: value, source, confidence (null value and 0 when not found).

    ``disciplines``: project_id, code, name, rank; ``catalog_sizes``: project_id, total_sheets.
    """
    lines = text_lines(texts)
    by_alias = alias_extract(lines)
    by_pattern = value_pattern(lines).join(by_alias, ["project_id", "field_id"], "left_anti")
    scope = disciplines.groupBy("project_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(rank, name))), d -> d.name), '、') AS value"))
    derived = scope.selectExpr("project_id", "'discipline_scope' AS field_id", "value", "'DERIVED' AS source_type", "'catalog' AS source_ref").unionByName(
        catalog_sizes.selectExpr("project_id", "'drawing_count' AS field_id", "concat(CAST(total_sheets AS STRING), ' 张') AS value", "'DERIVED' AS source_type", "'catalog.total_sheets' AS source_ref"))
    values = by_alias.unionByName(by_pattern).unionByName(derived)
    fields = _field_table(sheets.select("project_id").distinct(), disciplines)
    return fields.join(values, ["project_id", "field_id"], "left").withColumn(
        "confidence", F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(source_confidence()))


def profile_stats(profile: DataFrame) -> DataFrame:
    low = f"value IS NOT NULL AND confidence > 0 AND confidence < {fixed.MIN_CONFIDENCE}D"
    return profile.groupBy("project_id").agg(F.count("*").alias("field_total"), F.expr("count(value) AS filled"), F.expr("count_if(value IS NULL) AS missing"),
                                             F.expr(f"count_if({low}) AS low_confidence"))


def review_flag(profile: DataFrame) -> DataFrame:
    """Value as shown in a report: missing or weak values ask for review."""
    shown = f"CASE WHEN coalesce(value, '') = '' THEN '未识别（需复核）' WHEN confidence < {fixed.MIN_CONFIDENCE}D THEN concat(value, '（需复核）') ELSE value END"
    return profile.select("project_id", "scope", "field_id", F.expr(f"{shown} AS display"))


def missing_items(profile: DataFrame) -> DataFrame:
    """Fields to be supplied or reviewed, missing before weak, severe first."""
    status = f"CASE WHEN coalesce(value, '') = '' THEN 'MISSING' WHEN confidence < {fixed.MIN_CONFIDENCE}D THEN 'LOW_CONFIDENCE' END"
    rows = profile.withColumn("status", F.expr(status)).where("status IS NOT NULL")
    return rows.selectExpr("project_id", "scope", "field_id", "name", "status", "CASE WHEN required THEN 'high' ELSE 'medium' END AS severity", "confidence").orderBy(
        "project_id", F.expr("status = 'LOW_CONFIDENCE'"), "severity", "field_id", "scope")


def indicators(summary: DataFrame, audit: DataFrame, catalog_sizes: DataFrame, missing: DataFrame) -> DataFrame:
    """Corpus indicators as (metric, value): blocks per sheet (null without sheets), measured layers, alerts.

    One aggregate for each input, which is read once; then the nine numbers are put together.
    """
    def metrics(df: DataFrame, **of: str) -> DataFrame:
        one = df.agg(*[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in of.items()])
        return one.selectExpr(f"inline(array({', '.join(f'struct({raw(n)} AS metric, {n} AS value)' for n in of)}))")

    found = metrics(summary, block_total="coalesce(sum(block_total), 0)", length_layers="coalesce(sum(length_layers), 0)", area_layers="coalesce(sum(area_layers), 0)").unionByName(
        metrics(catalog_sizes, sheets="coalesce(sum(total_sheets), 0)")).unionByName(
        metrics(audit, pending="count_if(kind = 'pending')", unclassified_layers="count_if(kind = 'unclassified')",
                unclassified_entities="coalesce(sum(n) FILTER (WHERE kind = 'unclassified'), 0)")).unionByName(
        metrics(missing, low_confidence="count_if(status = 'LOW_CONFIDENCE')", required_missing="count_if(status = 'MISSING' AND severity = 'high')"))
    whole = found.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    per_sheet = half_up(F.expr("try_divide(m['block_total'], m['sheets'])"), 1)
    return whole.withColumn("b", per_sheet).selectExpr("explode(map_concat(m, map('blocks_per_sheet', b))) AS (metric, value)")


def work_sources(catalog: DataFrame, texts: DataFrame, labels: DataFrame, materials: DataFrame) -> DataFrame:
    """Inputs of a profile from all origins as rows (origin, item, source_type, source_ref, text).

    ``catalog``: row_id, drawing_no, drawing_name and, where sheets are classified, discipline; ``texts``: item, text,
    source_type, source_ref; ``labels`` as ``cio_text_source`` gives them; ``materials`` as ``material_hits`` does.
    """
    kind = "coalesce(discipline, '')" if "discipline" in catalog.columns else "''"
    rows = catalog.selectExpr("'catalog' AS origin", "CAST(row_id AS STRING) AS item", f"{kind} AS source_type", "drawing_no AS source_ref", "drawing_name AS text")
    for df, origin, columns in ((texts, "texts", ("item", "source_type", "source_ref", "text")), (labels, "drawings", ("entity_id", "source_type", "source_ref", "text")),
                                (materials, "materials", ("entity_id", "category", "layer", "matched_text"))):
        rows = rows.unionByName(df.selectExpr(f"'{origin}' AS origin", *[f"{c} AS {n}" for c, n in zip(columns, ("item", "source_type", "source_ref", "text"))]))
    return rows
