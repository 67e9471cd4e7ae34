"""Scans for secrets, with weak candidates reported only where the other parts of a credential stand near.

Strong patterns (assignments, access identifiers, long hexadecimal runs) are reported always. Weak ones
(account names, endpoints, tokens without a keyword, short assigned values) are parts of a credential: an
identifier, a secret, an endpoint. They are joined with all parts of their text by interval (at most
``SCOPE`` characters between), and reported where the parts near by complete them. Built-in functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmetric.llm.text import col, fresh

SCOPE = 200                 # most characters between the parts of a credential
MASK = "[SECRET]"

# The base patterns, and the least length of what they match.
ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"

USER = r"""(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
ENDPOINT = r"""(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20"'<>]+"""
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}"

KINDS = ("assign", "access", "hex", "user", "endpoint", "short_assign", "bare")
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "user": "identifier", "endpoint": "endpoint", "short_assign": "secret", "bare": "secret"}
BASE = KINDS[:3]


def _spans(text: Column, pattern: str) -> Column:
    """(start, end, length of group 1 where the pattern has one) of each match, in code points from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(between, lambda s: F.length(s)).alias("gap"), F.transform(found, lambda s: F.length(s)).alias("size"))
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(0).alias("at"))
    walked = F.aggregate(steps, start, lambda done, step: F.struct(
        F.when(step["size"].isNull(), done["spans"]).otherwise(F.concat(done["spans"], F.array(F.struct((done["at"] + step["gap"]).alias("start"), (done["at"] + step["gap"] + step["size"]).alias("end"))))).alias("spans"),
        (done["at"] + step["gap"] + F.coalesce(step["size"], F.lit(0))).alias("at")))
    return walked["spans"]


def _candidates(text: Column) -> Column:
    """All spans of a text as an array of (start, end, kind number)."""
    def numbered(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind")))

    assigned = F.zip_with(_spans(text, "(?i)" + ASSIGN), F.regexp_extract_all(text, F.lit("(?i)" + ASSIGN), F.lit(1)),
                          lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(F.length(v) >= ASSIGN_LEAST, KINDS.index("assign")).otherwise(KINDS.index("short_assign")).alias("kind")))
    others = [numbered(_spans(text, p), kind) for p, kind in ((ACCESS, "access"), (HEX, "hex"), ("(?i)" + USER, "user"), ("(?i)" + ENDPOINT, "endpoint"), (BARE, "bare"))]
    return F.concat(assigned, *others)


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and the reported spans (start, end, kind number) of each document, in order.

    One row for each row of ``docs``, repeated and null ids too; null and empty texts have no spans; no rows give
    no rows; other columns are not read. Spans of different kinds may overlap; all are reported.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    return _linked(rows.select("row", "doc_id", _candidates(F.col("text")).alias("found")), ["row", "doc_id"], scope)


def _linked(found: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """Keys and ``spans``: strong spans, and weak ones near the parts that complete them.

    A sweep over the positions of a document: each span is listed at its start, and each weak span asks behind its
    end plus ``scope``. Of the spans listed up to there, the furthest end of each part tells whether one reaches
    within ``scope`` of the asking span's start. Spans may be of any length.
    """
    part = F.element_at(F.array(*(F.lit(PART[k]) for k in KINDS)), F.col("s.kind") + 1)
    weak = F.col("s.kind") >= len(BASE)
    listed = F.struct(F.col("s.start").alias("at"), F.lit(False).alias("asks"))
    asking = F.struct((F.col("s.end") + scope).alias("at"), F.lit(True).alias("asks"))
    each = found.select(*keys, F.explode_outer("found").alias("s"))
    events = each.select(*keys, "s", part.alias("part"), weak.alias("weak"), F.explode_outer(F.when(weak, F.array(listed, asking)).when(~weak, F.array(listed))).alias("event"))
    so_far = Window.partitionBy(*keys).orderBy("event.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def near(of: str) -> Column:
        furthest = F.max(F.when((F.col("part") == of) & ~F.col("event.asks"), F.col("s.end"))).over(so_far)
        return F.coalesce(furthest + scope >= F.col("s.start"), F.lit(False)).alias(of)

    met = events.select(*keys, "s", "part", "weak", "event", near("secret"), near("identifier"), near("endpoint"))
    completed = F.when(F.col("part") == "secret", F.col("identifier") | F.col("endpoint")).when(F.col("part") == "identifier", F.col("secret")).otherwise(F.col("secret") & F.col("identifier"))
    kept = F.when(~F.col("weak") | (F.col("event.asks") & completed), F.col("s"))
    return met.groupBy(*keys).agg(F.array_sort(F.collect_list(kept)).alias("spans"))


def _joined(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["kind"].alias("b"), s["end"].alias("c")))),
                                    lambda s: F.concat_ws(":", F.element_at(name, s["b"] + 1), s["a"].cast("string"), s["c"].cast("string"))), ",")


def digest(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return find(docs, scope).select("doc_id", *map(count, BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def mask(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs``, all columns, with the reported spans of ``text`` replaced by ``MASK``; n_chars, if there, follows the new text.

    Spans that overlap or touch are replaced as one. Texts are told apart by their SHA-256, so that copies are
    searched once. Null texts stay null.
    """
    key, where = fresh(docs, "text_key"), fresh(docs, "masked_spans")
    keyed = docs.withColumn(key, F.sha2(col("text").cast("binary"), 256))
    found = keyed.select(F.col(key).alias("key"), _candidates(col("text")).alias("found")).where(F.size("found") > 0).dropDuplicates(["key"])
    spans = _linked(found, ["key"], scope).where(F.size("spans") > 0)
    merged = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))
    ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    joined = keyed.join(spans.select(F.col("key").alias(key), merged.alias(where)), key, "left")
    text = col("text")
    begun = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    walked = F.aggregate(F.col(where), begun, lambda done, s: F.struct(F.concat(done["out"], text.substr(done["at"] + 1, s["start"] - done["at"]), F.lit(MASK)).alias("out"), s["end"].alias("at")))
    joined = joined.withColumn(where, F.when(F.col(where).isNotNull(), walked))
    new = F.when(F.col(where).isNull(), text).otherwise(F.concat(F.col(where)["out"], text.substr(F.col(where)["at"] + 1, F.length(text))))
    changed = {"text": new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(where).isNull(), col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(changed[c].alias(c) if c in changed else col(c) for c in docs.columns))
