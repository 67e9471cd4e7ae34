"""Work processes of components, from their category and the texts on and around them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmetric.functions.grid import near_pairs
from sheetmetric.functions.text import contains_any_sql, let_sql, raw
from sheetmetric.model import fixed
from sheetmetric.operators.calibrate import lookup
from sheetmetric.operators.classify import categorized

WORD = 62    # rules in one long; a mask is an array of as many longs as the rules need


def ranked(rules: list[tuple]) -> list[tuple]:
    """Most declared keywords first, ties in rule order: the lowest bit set is the best rule."""
    return sorted(rules, key=lambda r: -len(r[4]))


def _words(rules: list[tuple]) -> int:
    return max(1, -(-len(rules) // WORD))


def _literal(numbers: list[int], n_words: int) -> str:
    """Mask with these bits."""
    words = [0] * n_words
    for i in numbers:
        words[i // WORD] |= 1 << i % WORD
    return "array(" + ", ".join(f"{w}L" for w in words) + ")"


def _mask_where(rules: list[tuple], position: int) -> str:
    """Map from a category or discipline to the mask of its rules."""
    bits: dict[str, list[int]] = {}
    for i, rule in enumerate(ranked(rules)):
        bits.setdefault(rule[position], []).append(i)
    return "map(" + ", ".join(f"{raw(k)}, {_literal(v, _words(rules))}" for k, v in bits.items()) + ")"


def rule_mask_sql(text: str, rules: list[tuple]) -> str:
    """Mask of the rules one of whose keywords occurs in ``text``."""
    words = [[] for _ in range(_words(rules))]
    for i, rule in enumerate(ranked(rules)):
        if rule[4]:
            words[i // WORD].append(f"CASE WHEN {contains_any_sql('t', [k.upper() for k in rule[4]])} THEN {1 << i % WORD}L ELSE 0L END")
    return let_sql(f"upper({text})", "t", "array(" + ", ".join(" | ".join(w) or "0L" for w in words) + ")")


def _any(mask: str) -> str:
    return f"exists({mask}, w -> w <> 0)"


def _or_all(mask: str, n_words: int) -> str:
    return "array(" + ", ".join(f"bit_or({mask}[{i}])" for i in range(n_words)) + ")"


def nearby_masks(entities: DataFrame, here: DataFrame, radius: float, rules: list[tuple]) -> DataFrame:
    """Rule bits of all texts within the radius of every place: only bits travel, never the texts."""
    n = _words(rules)
    texts = (entities.where("dxf_type IN ('TEXT', 'MTEXT') AND label_text <> ''")
             .selectExpr("sheet_id", "points[0].x AS rx", "points[0].y AS ry", f"{rule_mask_sql('label_text', rules)} AS mask").where(_any("mask"))
             .groupBy("sheet_id", "rx", "ry").agg(F.expr(f"{_or_all('mask', n)} AS mask")))
    return near_pairs(here, texts, radius).groupBy("sheet_id", "lx", "ly").agg(F.expr(f"{_or_all('mask', n)} AS near_mask"))


def process_match(entities: DataFrame, sheets: DataFrame, radius: float = 8000.0, rules: list[tuple] = fixed.PROCESS_RULES) -> DataFrame:
    """Best rule per component: right category and discipline, a keyword on it or nearby, most declared keywords.

    ``rules`` is a list like ``fixed.PROCESS_RULES`` of any length (``packs.load_process_rules`` reads one).
    """
    n = _words(rules)
    none, every = _literal([], n), _literal(list(range(len(rules))), n)
    own = "concat_ws(' ', coalesce(block_name, ''), coalesce(label_text, ''), array_join(map_values(attribs), ' '))"
    wanted = ", ".join(raw(c) for c in dict.fromkeys(r[3] for r in rules))
    parts = (categorized(entities).where(f"category IN ({wanted})")
             .selectExpr("sheet_id", "entity_id", "category", "CASE WHEN dxf_type <> 'HATCH' THEN points[0].x END AS lx",
                         "CASE WHEN dxf_type <> 'HATCH' THEN points[0].y END AS ly", f"{rule_mask_sql(own, rules)} AS own_mask"))
    near = nearby_masks(entities, parts.where("lx IS NOT NULL").select("sheet_id", "lx", "ly").distinct(), radius, rules)
    discipline = sheets.select("sheet_id", F.expr(
        f"CASE WHEN discipline IS NULL OR discipline IN ('', 'MULTI', 'UNKNOWN') THEN {every} ELSE coalesce(try_element_at({_mask_where(rules, 2)}, discipline), {none}) END AS allowed"))
    words = ", ".join(f"(own_mask[{i}] | coalesce(near_mask[{i}], 0L)) & allowed[{i}] & coalesce(of_category[{i}], 0L)" for i in range(n))
    masked = (parts.withColumn("of_category", F.expr(f"try_element_at({_mask_where(rules, 3)}, category)"))
              .join(near, ["sheet_id", "lx", "ly"], "left").join(discipline, "sheet_id").withColumn("mask", F.expr(f"array({words})")).where(_any("mask")))
    ids = "array(" + ", ".join(raw(r[0]) for r in ranked(rules)) + ")"
    lowest = "CASE " + " ".join(f"WHEN mask[{i}] <> 0 THEN {i * WORD} + bit_count((mask[{i}] & -mask[{i}]) - 1)" for i in range(n)) + " END"
    return masked.select("sheet_id", "entity_id", "category", F.expr(f"get({ids}, {lowest}) AS rule_id"))


def _with_processes(counts: DataFrame, rules: list[tuple]) -> DataFrame:
    """One row per process of the counted rules, in rule order."""
    arms = " ".join(f"WHEN {raw(r[0])} THEN array({', '.join(raw(p) for p in r[5])})" for r in rules if r[5])
    return counts.select("*", F.expr(f"explode(CASE rule_id {arms} END) AS process"))


def process_order(process: str = "process") -> Column:
    return F.coalesce(lookup(fixed.PROCESS_SEQUENCE, process), F.lit(99)).cast("long")


def process_stage(order: str = "sequence_order") -> Column:
    return F.expr("CASE " + " ".join(f"WHEN {order} <= {limit} THEN {raw(name)}" for limit, name in fixed.PROCESS_STAGES) + " END")


def process_counts(matches: DataFrame, rules: list[tuple] = fixed.PROCESS_RULES) -> DataFrame:
    """Occurrences per process with its place in the construction sequence; rules are counted before they unfold."""
    counts = matches.groupBy("rule_id").agg(F.count("*").alias("n"))
    return (_with_processes(counts, rules).groupBy("process").agg(F.sum("n").alias("occurrence"))
            .withColumn("sequence_order", process_order()).withColumn("stage", process_stage()).orderBy("sequence_order", F.desc("occurrence"), "process"))


def stage_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("stage").agg(F.count("*").alias("processes"), F.sum("occurrence").alias("occurrence"))


def process_by_category(matches: DataFrame, rules: list[tuple] = fixed.PROCESS_RULES) -> DataFrame:
    counts = matches.groupBy("category", "rule_id").agg(F.count("*").alias("n"))
    entities = counts.groupBy("category").agg(F.sum("n").alias("entities"))
    return _with_processes(counts, rules).groupBy("category", "process").agg(F.sum("n").alias("occurrence")).join(entities, "category")
