"""URL rules by host and path prefix, as a sort-merge range join.

A host is turned round (``a.example.org`` to ``org.example.a``), so that a rule is the interval of the keys
it begins. A url gives one key for each number of trailing labels that some rule has: a rule's host must be
one of them. Keys are dealt by ranges; a rule goes to every range that its interval meets. Each task sweeps
its keys in order and keeps the rules that hold the current key on a stack, each nested in the one below, so
that the top is the longest.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmetric.llm.text import col

ROWS_PER_RANGE = 50_000     # urls in a range of keys
MOST_RANGES = 4096
PER_RANGE = 24              # sampled keys for each range
MOST_LABELS = 127           # labels that a rule's host may have
SWEPT = "range int, key string, is_url int, row long, page_id long, host string, path string, rule string, verdict string"
NAMES = [part.split()[0] for part in SWEPT.split(", ")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str            # "allow" or "block"
    text: str               # host and path, such as "example.org/es/"

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])

    @property
    def key(self) -> str:
        return ".".join(reversed(self.host.split("."))) + "/" + self.path


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.key, r.text, r.verdict, len(r.host.split("."))) for r in rules], "key string, rule string, verdict string, labels int")


def host_and_path(urls: DataFrame) -> DataFrame:
    """page_id, host and path of each url (see ``judge``), and a number for each row."""
    url = F.coalesce(col("url"), F.lit(""))
    rest = F.expr("CASE WHEN instr(u, '://') > 0 THEN substring(u, instr(u, '://') + 3) ELSE '' END")
    out = urls.select(col("page_id").cast("long").alias("page_id"), url.alias("u")).select("page_id", rest.alias("rest"))
    host = F.regexp_extract("rest", "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("rest", "(?s)^[^/?#]*([^?#]*)", 1)
    return out.select(F.monotonically_increasing_id().alias("row"), "page_id", F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))


def bounds(keys: DataFrame, rows: int, ranges: int) -> list[str]:
    """Keys that part the urls into about equal ranges, from a sample of bounded size; they only balance the tasks.

    A key that many urls have is a bound several times: its urls are spread over all ranges between.
    """
    if ranges < 2:
        return []
    sample = sorted(r[0] for r in keys.sample(fraction=min(1.0, PER_RANGE * ranges / rows), seed=3).limit(4 * PER_RANGE * ranges).collect())
    return [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """page_id, host, path, rule and verdict of each url.

    ``rules``: key, rule, verdict, labels (number of host labels), see ``rule_table``. The longest rule
    wins, of equally long ones "block", then the greatest text. Without a rule the verdict is ``default`` and the rule null. One row
    for each row of ``urls``, repeated and null ids too; a null url or one without "://" has an empty host and
    path and fits no rule, like an empty host; rules on hosts of more than ``MOST_LABELS`` labels are not looked up
    (names of 253 characters, the most that DNS has, hold 127 labels); no rows give no rows, no rules give the default; other columns
    are not read.
    """
    plain = host_and_path(urls)
    depths = sorted(r[0] for r in rules.select("labels").distinct().where(F.col("labels").between(1, MOST_LABELS)).collect())
    total = plain.count()
    ranges = max(1, min(MOST_RANGES, -(-total // rows_per_range)))
    whole_key = plain.select(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("/"), "path").alias("key"))
    cuts = bounds(whole_key, total, ranges)
    labels = F.split("host", r"\.")
    probes = F.filter(F.array(*(F.when(F.size(labels) >= d, F.concat(F.array_join(F.reverse(F.slice(labels, -d, d)), "."), F.lit("/"), "path")) for d in depths)) if depths else F.array().cast("array<string>"), lambda k: k.isNotNull())
    keyed = plain.select("*", F.posexplode_outer(F.when(F.col("host") != "", probes)).alias("pos", "key"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0          # one of a url's rows carries it
    keyed = keyed.select("row", F.coalesce("key", F.lit("")).alias("key"), *(F.when(first, F.col(c)).alias(c) for c in ("page_id", "host", "path")))
    dealt = keyed.mapInArrow(_deal(cuts, ranges), SWEPT)
    held = rules.select("key", "rule", "verdict").mapInArrow(_spread(cuts), SWEPT)
    merged = held.unionByName(dealt).repartition("range").sortWithinPartitions("range", "key", "is_url", "verdict")
    hits = merged.mapInArrow(_sweep, "row long, page_id long, host string, path string, rule string, verdict string, size int")
    top = hits.groupBy("row").agg(*(F.max(c).alias(c) for c in ("page_id", "host", "path")), F.max(F.struct("size", "verdict", "rule")).alias("top"))
    return top.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def _deal(cuts: list[str], ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = []
            for row, key in zip(batch.column("row").to_pylist(), batch.column("key").to_pylist()):
                low, high = bisect_left(cuts, key), bisect_right(cuts, key)
                place.append(low + row % (high - low + 1))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), batch.column("key"), pa.array([1] * n, pa.int32()), *(batch.column(c) for c in ("row", "page_id", "host", "path")), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], NAMES)
    return run


def _spread(cuts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, rule, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = bisect_left(cuts, key), bisect_right(cuts, key)
                while high < len(cuts) and cuts[high].startswith(key):
                    high += 1
                rows += [(r, key, rule, verdict) for r in range(low, high + 1)]
            n = len(rows)
            place, keys, texts, verdicts = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.int32()), pa.array(list(keys), pa.string()), pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                                              pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(list(texts), pa.string()), pa.array(list(verdicts), pa.string())], NAMES)
    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules and urls in order of range, key and kind; gives each url's row with the longest rule that holds its key."""
    stack: list[tuple[str, str, str]] = []
    now = None
    for batch in batches:
        out = []
        for at, key, is_url, row, page, host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns)):
            if at != now:
                now, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, rule, verdict))
                else:                                   # the same key again: verdicts come in order, the last is "block"
                    stack[-1] = (key, rule, verdict)
            else:
                top = stack[-1] if stack else ("", None, None)
                out.append((row, page, host, path, top[1], top[2], len(top[0])))
        text, number = pa.string(), pa.int64()
        rows = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(rows, (number, number, text, text, text, text, pa.int32()))], ["row", "page_id", "host", "path", "rule", "verdict", "size"])
