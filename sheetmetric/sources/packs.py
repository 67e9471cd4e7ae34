"""Dictionaries and process rules from files: ordered tables of JSON lines.

They are small by nature and become expressions, so they are read to the driver; a pack of more than ``MOST``
rows is an error, and so is a missing file or a row that lacks a field.
"""
from __future__ import annotations

from pyspark.sql import SparkSession

MOST = 10_000
KEYWORDS = "dictionary STRING, position BIGINT, label STRING, keywords ARRAY<STRING>"
RULES = "position BIGINT, rule_id STRING, name STRING, discipline STRING, category STRING, keywords ARRAY<STRING>, processes ARRAY<STRING>"


def _rows(spark: SparkSession, path: str, schema: str) -> list:
    df = spark.read.schema(schema + ", _broken STRING").option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = df.orderBy("position").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"{path}: more than {MOST} rows")
    for r in rows:
        lacking = [c for c in df.columns if c != "_broken" and r[c] is None]
        if r["_broken"] is not None or lacking:
            raise ValueError(f"{path}: broken row at position {r['position']}: {', '.join(lacking)}")
    return rows


def save_dictionaries(spark: SparkSession, dictionaries: dict[str, list[tuple[str, list[str]]]], path: str) -> None:
    rows = [(d, i, label, list(words)) for d, groups in dictionaries.items() for i, (label, words) in enumerate(groups)]
    spark.createDataFrame(rows, KEYWORDS).coalesce(1).write.json(path)


def load_dictionaries(spark: SparkSession, path: str) -> dict[str, list[tuple[str, list[str]]]]:
    """Keyword groups by dictionary name, each in the order of ``position``."""
    found: dict[str, list] = {}
    for r in _rows(spark, path, KEYWORDS):
        found.setdefault(r["dictionary"], []).append((r["label"], list(r["keywords"])))
    return found


def save_process_rules(spark: SparkSession, rules: list[tuple], path: str) -> None:
    spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], RULES).coalesce(1).write.json(path)


def load_process_rules(spark: SparkSession, path: str) -> list[tuple]:
    """Rules in the form of ``fixed.PROCESS_RULES``; ids must be distinct."""
    rules = [(r["rule_id"], r["name"], r["discipline"], r["category"], list(r["keywords"]), list(r["processes"])) for r in _rows(spark, path, RULES)]
    if len({r[0] for r in rules}) < len(rules):
        raise ValueError(f"{path}: a rule id occurs twice")
    return rules

