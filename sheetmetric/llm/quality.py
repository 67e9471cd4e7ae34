"""Quality rules as a short-circuit cascade.

Each rule's cost (time) and selectivity (share it rejects) are measured on a sample of the table; the
rules then run in order of rejection per cost, and a text that one rejects meets no further rule. The
verdict does not depend on the order, so it is the same whatever was measured.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.llm.text import col, place_of, slices

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000          # rows on which rules are measured
FACTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Facts:
    """Figures of one text, each worked out when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that have a word."""
        return [line for line in self.text.split("\n") if line.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of three words which the text has twice or more."""
        if self.n_words < 4:
            return 0
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in self.words), np.int64, self.n_words)
        many = len(index)
        if many < 2_000_000:
            windows = (ids[:-2] * many + ids[1:-1]) * many + ids[2:]
        else:
            pairs = np.unique(ids[:-1] * many + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * many + ids[2:]
        _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
        again = count[place] > 1
        covered = np.zeros(self.n_words, bool)
        covered[:-2] |= again
        covered[1:-1] |= again
        covered[2:] |= again
        return int(covered.sum())

    @cached_property
    def n_shouted(self) -> int:
        """Words that end in two exclamation marks."""
        return sum(w.endswith(b"!!") for w in self.words)

    @property
    def base_failed(self) -> bool:
        return any(rule.rejects(self) for rule in BASE)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


BASE = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 12 * f.n_words),
    Rule("repeated_lines", lambda f: f.n_dup_lines >= 5 and 100 * f.n_dup_lines > 30 * len(f.lines)),
    Rule("shouting", lambda f: 10 * f.n_shouted > f.n_words),
)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[tuple[str, int, int, float]]:
    """(rule, rows, rejected, seconds) on a sample of about ``sample_rows`` rows: one row per rule reaches the driver."""
    rows = docs.count()
    if not rows:
        return [(rule.name, 0, 0, 0.0) for rule in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0, 0, 0.0] for _ in rules]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for rule, total in zip(rules, totals):
                    start = time.perf_counter()
                    rejected = rule.rejects(Facts(text))
                    total[2] += time.perf_counter() - start
                    total[0] += 1
                    total[1] += bool(rejected)
        yield pa.RecordBatch.from_pylist([{"rule": r.name, "rows": n, "rejected": k, "seconds": s} for r, (n, k, s) in zip(rules, totals)])

    sample = docs.select(col("text").alias("text")).sample(fraction=min(1.0, sample_rows / rows), seed=seed)
    found = sample.mapInArrow(run, "rule string, rows long, rejected long, seconds double")
    return [tuple(r) for r in found.groupBy("rule").agg(F.sum("rows"), F.sum("rejected"), F.sum("seconds")).collect()]


def order(rules: Sequence[Rule], measured: list[tuple[str, int, int, float]]) -> list[Rule]:
    """Rules by rejections per second, best first; those that reject nothing go last, cheapest first."""
    of = {name: (rejected, seconds) for name, _, rejected, seconds in measured}

    def key(rule: Rule):
        rejected, seconds = of.get(rule.name, (0, 0.0))
        return (-rejected / max(seconds, 1e-9), seconds)

    return sorted(rules, key=key)


def kept(text: str | None, rules: Sequence[Rule]) -> bool:
    facts = Facts(text)
    return not any(rule.rejects(facts) for rule in rules)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs``, all columns, that pass every rule.

    Null and empty texts have no words and are rejected by ``few_words``; rows are judged one by one
    (repeated rows alike, null ids too); an empty table gives an empty table; other columns pass through.
    """
    ranked = order(rules, measure(docs, rules))
    at = place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array([kept(t, ranked) for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Figures and verdict of each row: the cascade first, then the figures it did not need."""
    ranked = order(rules, measure(docs, rules))
    names = [part.split()[0] for part in FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column(1).to_pylist():
                facts = Facts(text)
                good = not any(rule.rejects(facts) for rule in ranked)
                rows.append((facts.n_words, facts.word_chars, facts.n_symbols, facts.n_dup_lines, facts.n_repeat_words, facts.base_failed, good))
            columns = [pa.array(list(c), pa.int64() if i < 5 else pa.bool_()) for i, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text")).mapInArrow(run, FACTS)
