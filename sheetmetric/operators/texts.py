"""Texts of drawings: extraction, keywords, elevations, title blocks and materials."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmetric.functions.numbers import half_up
from sheetmetric.functions.text import contains_any_sql, nonblank_sql, raw, tokens_sql
from sheetmetric.model import fixed

TEXTS = "dxf_type IN ('TEXT', 'MTEXT')"


def text_extract(entities: DataFrame) -> DataFrame:
    """Texts and block attributes as one table."""
    own = entities.where(TEXTS).selectExpr("sheet_id", "entity_id", "seq", "dxf_type AS type", "'' AS tag", "label_text AS content", "layer", "height")
    attribs = (entities.where("dxf_type = 'INSERT'").select("sheet_id", "entity_id", "seq", "layer", F.explode("attribs").alias("tag", "content"))
               .selectExpr("sheet_id", "entity_id", "seq", "'ATTRIB' AS type", "tag", "content", "layer", "0D AS height"))
    return own.unionByName(attribs)


def keyword_freq(texts: DataFrame, column: str = "text", top: int = 30) -> DataFrame:
    """Most frequent tokens of whole texts, pure digits dropped."""
    words = texts.where(nonblank_sql(column)).select(F.explode(F.expr(tokens_sql(column))).alias("word")).where(r"NOT word RLIKE r'^[0-9]+$'")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def elevations(entities: DataFrame) -> DataFrame:
    pattern = raw(fixed.ELEVATION_PATTERN)
    hits = entities.where(f"{TEXTS} AND label_text RLIKE {pattern}").selectExpr(
        "sheet_id", "entity_id", "points[0].x AS x", "points[0].y AS y", f"explode(regexp_extract_all(label_text, {pattern}, 0)) AS m")
    return hits.selectExpr("sheet_id", "entity_id", "x", "y", "translate(m, ' ', '') AS raw",
                           "try_cast(translate(m, '±+ ', '') AS DOUBLE) AS value").where("value IS NOT NULL")


def elevation_values(entities: DataFrame) -> DataFrame:
    """Distinct levels per sheet with their number of distinct marks."""
    unique = elevations(entities).groupBy("sheet_id", "raw", "x", "y").agg(F.max("value").alias("value"))
    return unique.groupBy("sheet_id", "value").agg(F.count("*").alias("n"))


def elevation_list(entities: DataFrame) -> DataFrame:
    """The distinct levels of a sheet, highest first, one row each."""
    return elevation_values(entities).withColumn("rank", F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.desc("value"))).cast("long"))


def elevation_levels(entities: DataFrame) -> DataFrame:
    """Distinct marks and levels per sheet, with the storey intervals they bound."""
    return elevation_values(entities).groupBy("sheet_id").agg(F.sum("n").alias("total"), F.count("*").alias("level_count"), F.expr("count(*) - 1 AS intervals"),
                                            F.max("value").alias("highest"), F.min("value").alias("lowest"))


def rectangles(entities: DataFrame) -> DataFrame:
    """Closed four-vertex polylines with their box and area."""
    rows = entities.where("dxf_type = 'LWPOLYLINE' AND closed AND size(points) = 4").selectExpr(
        "sheet_id", "seq", "entity_id", "layer", "array_min(points.x) AS xmin", "array_min(points.y) AS ymin",
        "array_max(points.x) AS xmax", "array_max(points.y) AS ymax")
    return rows.selectExpr("*", "xmax - xmin AS width", "ymax - ymin AS height", "(xmax - xmin) * (ymax - ymin) AS area").where("width > 0 AND height > 0")


def paper_guess(w: str = "width", h: str = "height") -> Column:
    """Paper size and scale with the least relative error; accepted under 5 %."""
    options, i = [], 0
    for name, long, short in fixed.PAPERS:
        for a, b in ((long, short), (short, long)):
            for scale in fixed.PAPER_SCALES:
                label = f"{name}（1:{scale}）" if scale > 1 else name
                options.append(f"named_struct('i', {i}, 'w', {a * scale}D, 'h', {b * scale}D, 'label', '{label}')")
                i += 1
    best = f"array_min(transform(array({', '.join(options)}), o -> named_struct('err', abs({w} - o.w) / o.w + abs({h} - o.h) / o.h, 'i', o.i, 'label', o.label)))"
    return F.expr(f"transform(array({best}), b -> CASE WHEN b.err < 0.05D THEN b.label ELSE '未知' END)[0]")


def frame_detect(entities: DataFrame, keep: int = 10) -> DataFrame:
    """Largest rectangles per sheet with the paper they look like; rank 1 is the outer frame."""
    w = Window.partitionBy("sheet_id").orderBy(F.desc("area"), "seq", "entity_id")
    ranked = rectangles(entities).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    return ranked.select("sheet_id", "rank", "layer", "width", "height", "area", paper_guess().alias("paper"))


def outer_frames(entities: DataFrame) -> DataFrame:
    best = rectangles(entities).groupBy("sheet_id").agg(F.expr("min(struct(-area, seq, entity_id, xmin, ymin, xmax, ymax)) AS b"))
    return best.select("sheet_id", "b.xmin", "b.ymin", "b.xmax", "b.ymax")


def _extent_frames(entities: DataFrame) -> DataFrame:
    return entities.groupBy("sheet_id").agg(
        F.expr("min(array_min(points.x)) AS xmin"), F.expr("min(array_min(points.y)) AS ymin"), F.expr("max(array_max(points.x)) AS xmax"), F.expr("max(array_max(points.y)) AS ymax"))


def title_zone_text(entities: DataFrame, width: float = 0.4, height: float = 0.25, fall_back: bool = False) -> DataFrame:
    """Non-blank texts in the lower right ``width`` x ``height`` share of the outer frame.

    ``fall_back``: sheets without rectangles use the extent of all entities.
    """
    frames = outer_frames(entities)
    if fall_back:
        rest = _extent_frames(entities.where("dxf_type NOT IN ('LWPOLYLINE', 'HATCH')")).join(frames, "sheet_id", "left_anti")
        frames = frames.unionByName(rest)
    zones = frames.selectExpr("sheet_id", f"xmax - (xmax - xmin) * {width}D AS zx", "xmax", "ymin", f"ymin + (ymax - ymin) * {height}D AS zy")
    texts = entities.where(f"{TEXTS} AND {nonblank_sql('label_text')}").selectExpr(
        "sheet_id", "seq", "entity_id", "trim(label_text) AS text", "points[0].x AS x", "points[0].y AS y")
    return texts.join(zones, "sheet_id").where("x BETWEEN zx AND xmax AND y BETWEEN ymin AND zy").select("sheet_id", "seq", "entity_id", "text", "x", "y")


def _first(value: str, hit: str, name: str, pick: str = "min_by") -> Column:
    return F.expr(f"{pick}({value}, struct(seq, entity_id)) FILTER (WHERE {hit}) AS {name}")


def title_fields_zone(zone_texts: DataFrame) -> DataFrame:
    t = fixed.TITLE_ZONE
    hint = "CASE " + " ".join(f"WHEN contains(text, '{k}') THEN '{v}'" for k, v in reversed(t["hint"])) + " END"
    return zone_texts.groupBy("sheet_id").agg(
        _first("text", f"text RLIKE {raw(t['no'])}", "drawing_no"), _first("text", f"text RLIKE {raw(t['name'])}", "drawing_name"),
        _first(f"concat('1:', regexp_extract(text, {raw(t['scale'])}, 1))", f"text RLIKE {raw(t['scale'])}", "scale"),
        _first(hint, f"{hint} IS NOT NULL", "discipline_hint", "max_by"))


def title_fields_sheet(zone_texts: DataFrame) -> DataFrame:
    t = fixed.TITLE_SHEET
    return zone_texts.groupBy("sheet_id").agg(
        _first(f"regexp_extract(text, {raw(t['no'])}, 0)", f"text RLIKE {raw(t['no'])}", "drawing_no"),
        _first("text", contains_any_sql("text", t["name"]), "drawing_name"),
        _first(f"translate(regexp_extract(text, {raw(t['scale'])}, 0), ' ', '')", f"text RLIKE {raw(t['scale'])}", "scale"),
        _first(f"regexp_extract(text, {raw(t['revision'])}, 1)", f"text RLIKE {raw(t['revision'])}", "revision"))


def material_hits(entities: DataFrame) -> DataFrame:
    """Every material pattern match in texts and attribute values, with its named fields.

    All patterns run as built-in regex functions on texts that pass one combined test.
    """
    texts = (text_extract(entities).where(f"content RLIKE {raw('|'.join(p for _, p, _ in fixed.MATERIALS))}")
             .select("sheet_id", "entity_id", "layer", F.col("content").alias("text")))
    parts = []
    for i, (category, pattern, names) in enumerate(fixed.MATERIALS):
        arrays = ", ".join(f"regexp_extract_all(text, {raw(pattern)}, {g})" for g in range(len(names) + 1))
        pairs = ", ".join(f"'{n}', z.`{g + 1}`" for g, n in enumerate(names))
        parts.append(f"transform(arrays_zip({arrays}), z -> named_struct('pattern', {i}, 'category', '{category}', 'matched_text', trim(z.`0`), "
                     f"'fields', map_filter(map({pairs}), (k, v) -> v <> '')))")
    hits = texts.select("sheet_id", "entity_id", "layer", "text", F.expr(f"explode(concat({', '.join(parts)})) AS h"))
    return hits.select("sheet_id", "entity_id", "layer", "text", "h.*").where("size(fields) > 0")


def dedup_hits(hits: DataFrame) -> DataFrame:
    """Hits counted once per entity and matched text."""
    return hits.groupBy("sheet_id", "category", "entity_id", "matched_text").agg(F.count("*").alias("raw"))


def material_summary(hits: DataFrame) -> DataFrame:
    return dedup_hits(hits).groupBy("sheet_id", "category").agg(
        F.count("*").alias("count"), F.sum("raw").alias("raw_hits"), F.countDistinct("matched_text").alias("specs"))


def top_specs(hits: DataFrame, keep: int = 50, keys=()) -> DataFrame:
    """Most frequent specifications per category (ranked after counting)."""
    counted = dedup_hits(hits).groupBy(*keys, "category", "matched_text").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "category").orderBy(F.desc("n"), "matched_text")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
