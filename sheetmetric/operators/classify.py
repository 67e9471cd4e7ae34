"""Disciplines, drawing types and component categories."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmetric.functions.numbers import half_up
from sheetmetric.functions.text import component_pattern, first_group_sql, let_sql, norm_sql, raw
from sheetmetric.model import fixed
from sheetmetric.operators.calibrate import lookup
from sheetmetric.session import cut_lineage


def layer_discipline(layer: str = "layer") -> Column:
    return F.expr(first_group_sql(norm_sql(layer), fixed.LAYER_KEYWORDS, "''"))


def drawing_no_discipline(no: str = "drawing_no") -> Column:
    """Discipline of the longest matching prefix; null for blank or unrecognised numbers."""
    by_length = sorted(fixed.DRAWING_NO_PREFIX, key=lambda p: -len(p[0]))
    whens = " ".join(f"WHEN startswith(upper({no}), {raw(p.upper())}) THEN {raw(d)}" for p, d in by_length)
    return F.expr(f"CASE WHEN {no} IS NULL OR {no} IN ('', '未识别') THEN NULL {whens} END")


def drawing_name_discipline(name: str = "drawing_name") -> Column:
    """Discipline with most keywords in the name; ties to the earlier one."""
    scored = []
    for i, (disc, words) in enumerate(fixed.NAME_KEYWORDS):
        hits = " + ".join(f"int(contains({name}, {raw(w)}))" for w in words)
        scored.append(f"named_struct('n', {hits}, 'i', {-i}, 'd', {raw(disc)})")
    return F.expr(f"get(filter(array(array_max(array({', '.join(scored)}))), b -> b.n > 0), 0).d")


def classify_sheets(catalog: DataFrame) -> DataFrame:
    """Number beats name; the confidence text says how they agreed."""
    rows = catalog.withColumns({"by_no": drawing_no_discipline(), "by_name": drawing_name_discipline()})
    return rows.withColumns({
        "confidence": F.expr("CASE WHEN by_no = by_name THEN '高' WHEN by_no IS NOT NULL AND by_name IS NOT NULL THEN '中（图号与图名不一致）' "
                             "WHEN by_no IS NOT NULL THEN '中（仅图号）' WHEN by_name IS NOT NULL THEN '中（仅图名）' ELSE '低' END"),
        "discipline": F.expr("coalesce(by_no, by_name, '其他')")}).drop("by_no", "by_name")


def discipline_order(col: str = "discipline") -> Column:
    ranks = {d: i for i, d in enumerate(fixed.DISCIPLINE_ORDER)}
    return F.coalesce(lookup(ranks, col), F.lit(len(ranks))).cast("long")


def sheet_discipline_stats(classified: DataFrame) -> DataFrame:
    stats = classified.groupBy("discipline").agg(F.count("*").alias("sheets"), F.expr("count_if(confidence = '低') AS low_confidence"))
    return stats.withColumn("rank", discipline_order()).orderBy("rank", "discipline")


def layer_prefix_code(layer: str = "name") -> Column:
    """Discipline code of a layer name: its separated prefix, else the whole name; null if neither is listed."""
    name, codes = f"upper(trim({layer}))", dict(fixed.LAYER_PREFIX_CODES)
    parts = rf"split({name}, r'[-_\s]')"
    return F.coalesce(lookup(codes, f"CASE WHEN size({parts}) > 1 THEN {parts}[0] END"), lookup(codes, name))


def layer_prefix_discipline(layers: DataFrame) -> DataFrame:
    """Code with most prefixed layers per sheet; ties to the first seen."""
    counts = (layers.withColumn("code", layer_prefix_code()).where("code IS NOT NULL")
              .groupBy("sheet_id", "code").agg(F.count("*").alias("n"), F.min("pos").alias("first")))
    return counts.groupBy("sheet_id").agg(F.expr("max(struct(n, -first, code)) AS b")).select(
        "sheet_id", F.col("b.code").alias("code"), F.col("b.n").alias("n_layers"))


def texts_of(entities: DataFrame) -> DataFrame:
    return entities.where("dxf_type IN ('TEXT', 'MTEXT')")


def drawing_type(entities: DataFrame, layers: DataFrame) -> DataFrame:
    """First keyword group found in a sheet's texts and layer names."""
    blob = (texts_of(entities).selectExpr("sheet_id", f"{norm_sql('label_text')} AS s")
            .unionByName(layers.selectExpr("sheet_id", f"{norm_sql('name')} AS s")))
    rank = first_group_sql("s", [(str(i), words) for i, (_, words) in enumerate(fixed.DRAWING_TYPES)])
    best = blob.groupBy("sheet_id").agg(F.expr(f"min(int({rank})) AS r"))
    return best.select("sheet_id", F.coalesce(lookup({i: n for i, (n, _) in enumerate(fixed.DRAWING_TYPES)}, "r"), F.lit("UNKNOWN")).alias("drawing_type"))


def _category_sql(x: str, categories: list) -> str:
    whens = " ".join(f"WHEN u RLIKE {raw(component_pattern(words))} THEN '{name}'" for name, words in categories)
    return let_sql(norm_sql(x), "u", f"CASE WHEN u = '' THEN NULL {whens} END")


def with_category(entities: DataFrame, categories: list = fixed.CATEGORIES) -> DataFrame:
    """Adds category and sub_category: block name before text before layer name.

    The sub-category looks at block and text, and at the layer only when the layer decided.
    """
    own_text = "concat_ws(' ', coalesce(block_name, ''), coalesce(label_text, ''))"
    sub_own = first_group_sql(norm_sql(own_text), fixed.SUB_CATEGORIES)
    sub_all = first_group_sql(norm_sql(f"concat_ws(' ', layer, {own_text})"), fixed.SUB_CATEGORIES)
    staged = entities.withColumn("_own", F.expr(f"coalesce({_category_sql('block_name', categories)}, {_category_sql('label_text', categories)})"))
    staged = staged.withColumn("_layer", F.expr(f"CASE WHEN _own IS NULL THEN {_category_sql('layer', categories)} END"))
    return staged.withColumns({
        "category": F.expr("coalesce(_own, _layer, 'UNKNOWN')"),
        "sub_category": F.expr(f"CASE WHEN _own IS NOT NULL THEN {sub_own} WHEN _layer IS NOT NULL THEN {sub_all} END")}).drop("_own", "_layer")


NAMES = ["layer", "block_name", "label_text"]
SMALL_NAMES = 4_000_000           # characters of distinct names that are classified once and sent to all tasks


def categorized(entities: DataFrame, categories: list = fixed.CATEGORIES) -> DataFrame:
    """``with_category`` by distinct names: counted first, and where they are few, each is classified once and looked up."""
    names = with_category(entities.select(*NAMES).distinct(), categories)
    size = names.agg(F.expr(f"sum(10 + {' + '.join(f'coalesce(length({c}), 0)' for c in NAMES)}) AS n")).first().n or 0
    if size > SMALL_NAMES:
        return with_category(entities, categories)
    known = cut_lineage(names.coalesce(1)).toDF(*["_" + c for c in NAMES], "category", "sub_category")
    return entities.join(F.broadcast(known), F.expr(" AND ".join(f"{c} <=> _{c}" for c in NAMES)), "left").drop(*["_" + c for c in NAMES])


def category_counts(entities: DataFrame) -> DataFrame:
    """Entities per distinct (layer, block, text): classified after counting, once per combination."""
    return with_category(entities.groupBy("layer", "block_name", "label_text").agg(F.count("*").alias("n")))


def vote_sources(entities: DataFrame, layers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Names that vote: (sheet_id, kind, name, n, first); equal texts are counted together."""
    texts = (texts_of(entities).where("label_text <> ''").groupBy("sheet_id", F.col("label_text").alias("name"))
             .agg(F.count("*").alias("n"), F.min("seq").alias("first")))
    return (layers.selectExpr("sheet_id", "'layer' AS kind", "name", "1L AS n", "pos AS first")
            .unionByName(blocks.where("NOT block_name RLIKE r'^[*_]'").selectExpr("sheet_id", "'block' AS kind", "block_name AS name", "1L AS n", "pos AS first"))
            .unionByName(texts.selectExpr("sheet_id", "'text' AS kind", "name", "n", "first")))


DICTIONARIES = {"role": fixed.ROLE_KEYWORDS, "discipline": fixed.LAYER_KEYWORDS, "category": fixed.CATEGORIES}


def _weight_sql(weights: dict) -> str:
    """Summed weights of one discipline's keywords that occur in the upper-cased ``name``."""
    def total(words):
        by_weight = {}
        for w, wt in words.items():
            by_weight.setdefault(wt, []).append(w)
        return " + ".join(f"{wt} * ({' + '.join(f'int(contains(v, {raw(w.upper())}))' for w in ws)})" for wt, ws in by_weight.items())
    return let_sql("u", "v", "CASE kind " + " ".join(f"WHEN '{kind}' THEN {total(words)}" for kind, words in weights.items()) + " ELSE 0 END")


def _with_upper(sources: DataFrame) -> DataFrame:
    return sources.withColumn("u", F.expr(norm_sql("name")))


def _scores(sources: DataFrame, table: dict) -> DataFrame:
    """Per discipline the sheet's score and the place of its first hit (``<discipline> at``): layers, then blocks, then texts.

    Names are weighed in their rows: one aggregation by sheet, no join on names that all sheets share.
    """
    kinds = ("kind = 'layer'", "kind = 'block'", "kind NOT IN ('layer', 'block')")
    weighed = _with_upper(sources).selectExpr("sheet_id", "n", "kind", "first", *[f"{_weight_sql(weights)} AS `{disc}`" for disc, weights in table.items()])
    # numbers only, so that the sums are kept in a hash table and rows are not sorted before they are shuffled
    sums = weighed.groupBy("sheet_id").agg(*[F.expr(f"sum(`{disc}` * n) AS `{disc}`") for disc in table],
                                           *[F.expr(f"min(CASE WHEN `{disc}` > 0 AND {kind} THEN first END) AS `{disc} {i}`") for disc in table for i, kind in enumerate(kinds)],
                                           *[F.expr(f"bool_or(`{disc}` > 0 AND {kind} AND first IS NULL) AS `{disc} {i} null`") for disc in table for i, kind in enumerate(kinds)])
    at = lambda disc: "CASE " + " ".join(f"WHEN `{disc} {i} null` OR `{disc} {i}` IS NOT NULL THEN named_struct('kind', {i}, 'first', CASE WHEN NOT `{disc} {i} null` THEN `{disc} {i}` END)" for i in range(len(kinds))) + " END"
    return sums.selectExpr("sheet_id", *[f"`{disc}`" for disc in table], *[f"{at(disc)} AS `{disc} at`" for disc in table])


def _ranked(scores: DataFrame, labels: list[str]) -> DataFrame:
    """Disciplines by score; ties to the earlier first hit, then in dictionary order."""
    entries = ", ".join(f"named_struct('k', -`{d}`, 'at', coalesce(`{d} at`, named_struct('kind', 3, 'first', 0L)), 'i', {i}, 'label', '{d}')" for i, d in enumerate(labels))
    total = " + ".join(f"`{d}`" for d in labels)
    return scores.selectExpr("sheet_id", f"{total} AS total", f"filter(array_sort(array({entries})), e -> e.k < 0) AS ranking").where("total > 0")


def discipline_ranking(sources: DataFrame) -> DataFrame:
    """Weighted vote per sheet: rank, discipline, score and share."""
    ranked = _ranked(_scores(sources, fixed.CONTENT_WEIGHTS), list(fixed.CONTENT_WEIGHTS))
    return ranked.select("sheet_id", "total", F.posexplode("ranking").alias("pos", "e")).select(
        "sheet_id", F.expr("CAST(pos + 1 AS BIGINT) AS rank"), F.col("e.label").alias("discipline"), F.expr("-e.k AS score"),
        half_up(F.expr("-e.k * 100D / total"), 1).alias("ratio"))


def discipline_vote(sources: DataFrame) -> DataFrame:
    """Primary discipline, confidence % and whether more than one discipline holds over 20 %."""
    ranked = _ranked(_scores(sources, fixed.CONTENT_WEIGHTS), list(fixed.CONTENT_WEIGHTS))
    return ranked.select("sheet_id", F.expr("ranking[0].label AS primary_discipline"), half_up(F.expr("-ranking[0].k * 100D / total"), 1).alias("confidence"),
                         F.expr("size(filter(ranking, e -> -e.k / total > 0.2D)) > 1 AS is_multi"))


CODE_WEIGHTS = {code: {kind: {w: fixed.CODE_HIT_WEIGHT[kind] for w in words} for kind in ("layer", "block", "text")}
                for code, words in fixed.CODE_KEYWORDS}


def _code_ranking(sources: DataFrame, layers: DataFrame) -> DataFrame:
    """Codes of a sheet by keyword hits plus a bonus for the winning layer prefix."""
    codes = [c for c, _ in fixed.CODE_KEYWORDS]
    prefix = layer_prefix_discipline(layers).withColumnRenamed("code", "prefix_code")
    scores = _scores(sources, CODE_WEIGHTS).join(prefix, "sheet_id", "full_outer").selectExpr("sheet_id", *[
        f"coalesce({c}, 0L) + CASE WHEN prefix_code = '{c}' THEN n_layers * {fixed.LAYER_PREFIX_WEIGHT} ELSE 0L END AS {c}" for c in codes], *[f"`{c} at`" for c in codes])
    return _ranked(scores, codes)


def discipline_vote_codes(sources: DataFrame, layers: DataFrame, sheets: DataFrame) -> DataFrame:
    """Second scheme, by codes: the best code, or several."""
    voted = (_code_ranking(sources, layers).withColumn("confidence", half_up(F.expr("-ranking[0].k * 100D / total"), 1))
             .selectExpr("sheet_id", "confidence", "CASE WHEN size(filter(ranking, e -> -e.k / total > 0.25D)) > 1 AND confidence < 60 THEN 'MULTI' ELSE ranking[0].label END AS code"))
    return sheets.select("sheet_id").join(voted, "sheet_id", "left").selectExpr(
        "sheet_id", "coalesce(code, 'UNKNOWN') AS code", "coalesce(confidence, 0D) AS confidence")


def _support(sources: DataFrame, table: dict) -> DataFrame:
    """Names by the disciplines that they voted for."""
    supported = ", ".join(f"CASE WHEN {_weight_sql(w)} > 0 THEN '{d}' END" for d, w in table.items())
    return (_with_upper(sources).select("sheet_id", "kind", "name", "first", F.expr(f"explode(array_compact(array({supported}))) AS discipline"))
            .groupBy("sheet_id", "discipline", "kind", "name").agg(F.min("first").alias("first")))


def _first_names(hits: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("sheet_id", "discipline", "kind").orderBy("first", "name")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).withColumn("rank", F.col("rank").cast("long")).drop("first")


def vote_evidence(sources: DataFrame, keep: int = 10) -> DataFrame:
    """First names per sheet, discipline and kind that supported the discipline."""
    return _first_names(_support(sources, fixed.CONTENT_WEIGHTS), keep)


def vote_evidence_codes(sources: DataFrame, layers: DataFrame, keep: int = 8) -> DataFrame:
    """First names of each kind behind the best code of a sheet, prefixed layers included (kind ``layer_prefix``)."""
    best = _code_ranking(sources, layers).select("sheet_id", F.expr("ranking[0].label AS discipline"))
    prefixed = (layers.withColumn("code", layer_prefix_code()).join(layer_prefix_discipline(layers).select("sheet_id", "code"), ["sheet_id", "code"])
                .groupBy("sheet_id", F.col("code").alias("discipline"), "name").agg(F.min("pos").alias("first")))
    hits = _support(sources, CODE_WEIGHTS).unionByName(prefixed.withColumn("kind", F.lit("layer_prefix")))
    return _first_names(hits.join(best, ["sheet_id", "discipline"]), keep).withColumnRenamed("discipline", "code")


def detected_disciplines(catalog_disciplines: DataFrame, sheet_codes: DataFrame) -> DataFrame:
    """Registry disciplines present in a project, from catalog names and sheet codes, in registry order.

    ``catalog_disciplines``: project_id, discipline; ``sheet_codes``: project_id, code.  Codes
    outside the registry (the sheet scheme says STR where the registry says STRU) never match.
    """
    registry = fixed.DISCIPLINE_REGISTRY
    codes = (catalog_disciplines.select("project_id", lookup({name: code for code, name, _, _ in registry}, "discipline").alias("code"))
             .unionByName(sheet_codes.select("project_id", "code")))
    return codes.where("code <> 'UNKNOWN'").distinct().select(
        "project_id", "code", lookup({code: name for code, name, _, _ in registry}, "code").alias("name"),
        lookup({code: i for i, (code, *_) in enumerate(registry)}, "code").cast("long").alias("rank")).where("rank IS NOT NULL")


def keyword_usage(layer_counts: DataFrame, dictionaries: dict = DICTIONARIES) -> DataFrame:
    """Dictionary table joined with the data it classifies: entities per matching layer keyword.

    The dictionary travels as an array literal, so a layer is compared with every entry without a join.
    """
    entries = ", ".join(f"named_struct('dictionary', '{d}', 'label', {raw(k)}, 'priority', {i}L, 'keyword', {raw(w)})"
                        for d, groups in dictionaries.items()
                        for i, (k, words) in enumerate(groups) for w in words)
    hits = layer_counts.select("n", F.expr(f"explode(filter(array({entries}), e -> contains({norm_sql('layer')}, upper(e.keyword)))) AS e"))
    return hits.groupBy("e.dictionary", "e.label", "e.priority", "e.keyword").agg(F.sum("n").alias("entities"))
