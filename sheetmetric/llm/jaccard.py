"""Documents whose sets of word shingles have a Jaccard similarity of at least 3/4.

Rare-first prefix filtering: shingles are ordered by how often the corpus has them (a count sketch of fixed
size gives the order; any common order gives the same links), and two sets that are similar enough share one
of their first n/4 + 1 shingles. Documents meet on these by a shuffle; pairs that fail the length, positional
or suffix filter are dropped, and each pair left is verified once on the full sets.

Equal sets count as one node. A shingle that few nodes share pairs them all. One that many share pairs them
with one pivot only, the node in which the shingle stands furthest to the front (it has the least of its
own). What pivots have not joined is met again with the components known by then: first with the pivot of the
largest component, at last with every node of another component. So no link between components is lost, and
a group of near copies never makes all its pairs.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmetric.llm.text import WordHashes, col, fresh, mix, shingle_hashes, slices, words_of
from sheetmetric.session import cut_lineage, shared_folder

SHINGLE = 5
OVER, UNDER = 3, 4          # similarity of at least OVER / UNDER
SKETCH_BITS = 22            # counters of the sketch, as a power of two
CHUNK = 1 << 14             # counters in a row of the sketch
SMALL_RUN = 16              # nodes of one shingle that are all paired
PIVOT_ROUNDS = 2            # rounds with a pivot for each shingle before all that is left is paired
BITMAP_BITS = 25            # bits that tell which documents' sets are wanted
SALTS = 16                  # groups that the rows of one shingle are dealt over
NODE = "doc_id long, text_hash long, sig long, n long, info long, prefix array<long>"
RUN = "kind int, token long, pos int, info long, a long, b long"


class Shingler:
    """Shingle sets of texts, and their 64-bit signatures."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.hashes = size, WordHashes()

    def of(self, text: str | None) -> np.ndarray:
        return shingle_hashes(self.hashes.of(words_of(text or "")), self.size)


def signature(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix_length(n: np.ndarray | int):
    """Two sets with OVER/UNDER of their union in common share one of so many first shingles."""
    return n - (OVER * n + UNDER - 1) // UNDER + 1


def common_needed(total: np.ndarray) -> np.ndarray:
    """Least intersection of two similar sets with ``total`` shingles together."""
    return -(-OVER * total // (OVER + UNDER))


def levels(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """How often the corpus has the shingles of each sketch counter, on a scale of 0 to 255.

    Counts of all documents (of each counter up to 255 from one task, which ranks common ones all the same);
    2**SKETCH_BITS bytes whatever the size of the corpus reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total, held, n = Shingler(size), np.zeros(1 << SKETCH_BITS, np.int32), [], 0
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                held.append((shingler.of(text) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                n += len(held[-1])
            if n > 1 << SKETCH_BITS:
                total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.int32)
        if total.any():
            low = np.minimum(total, 255).astype(np.uint8).reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array([x.tobytes() for x in low], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, np.uint8).astype(np.int64)
        level = [np.minimum(255, 8 * np.log2(1.0 + x)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(level, pa.binary())], ["chunk", "levels"])

    counted = docs.select(col("text").alias("text")).mapInArrow(count, "chunk int, counts binary")
    out = np.zeros((1 << SKETCH_BITS) // CHUNK * CHUNK, np.uint8).reshape(-1, CHUNK)
    for row in counted.repartition(16, "chunk").mapInArrow(add, "chunk int, levels binary").collect():
        out[row["chunk"]] = np.frombuffer(row["levels"], np.uint8)
    return out.ravel()


def nodes(docs: DataFrame, level: np.ndarray, size: int = SHINGLE) -> DataFrame:
    """Signature, set size and rare-first prefix of each document (a set repeated in a task has no prefix there).

    ``info`` packs the set size with how many of the shingles lie in each quarter of the hash range (up to 255).
    A text without words has no signature.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rare, seen = Shingler(size), shared.value, set()
        for part in slices(batches):
            sig, n, info, prefix = [], [], [], []
            for text in part.column(2).to_pylist():
                s = shingler.of(text)
                n.append(len(s))
                if not len(s):
                    sig.append(None)
                    info.append(None)
                    prefix.append(None)
                    continue
                sig.append(signature(s))
                if sig[-1] in seen:
                    info.append(None)
                    prefix.append(None)
                    continue
                seen.add(sig[-1])
                quarter = np.minimum(255, np.bincount((s >> np.uint64(62)).astype(np.int64), minlength=4)).tolist()
                info.append(len(s) << 32 | quarter[0] << 24 | quarter[1] << 16 | quarter[2] << 8 | quarter[3])
                first = np.argsort(rare[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:prefix_length(len(s))]
                prefix.append(s[first].view(np.int64))
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sig, pa.int64()), pa.array(n, pa.int64()), pa.array(info, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "text_hash", "sig", "n", "info", "prefix"])

    plain = docs.select(col("doc_id").cast("long").alias("doc_id"), F.xxhash64(col("doc_id"), col("text")).alias("text_hash"), col("text").alias("text"))
    return plain.mapInArrow(run, NODE)


def similar_enough(info_a: np.ndarray, pos_a: np.ndarray, info_b: np.ndarray, pos_b: np.ndarray) -> np.ndarray:
    """Length, positional and suffix filter of pairs that meet on their first common shingle."""
    a, b = info_a >> 32, info_b >> 32
    need = common_needed(a + b)
    good = (UNDER * np.minimum(a, b) >= OVER * np.maximum(a, b)) & (1 + np.minimum(a - pos_a, b - pos_b) - 1 >= need)
    differ = np.zeros(len(a), np.int64)
    for shift in (24, 16, 8, 0):
        differ += np.abs((info_a >> shift & 255) - (info_b >> shift & 255))
    return good & (differ <= a + b - 2 * need)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (kind 0) of nodes in sorted rows (token, pos, sig, info), and the rows of long runs (kind 1)."""
    held = np.zeros((0, 4), np.int64)       # rows of a run that may go on and is short so far
    pivot: np.ndarray | None = None         # first row of a long run that may go on

    def large(rows: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        other = rows[rows[:, 2] != first[2]]
        own = np.repeat(first[None, :], len(other), 0)
        ok = similar_enough(own[:, 3], own[:, 1], other[:, 3], other[:, 1])
        yield _pairs(own[ok, 2], other[ok, 2])
        yield _rows(1, rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 2], rows[:, 2])

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1))
        size = np.diff(start, append=len(rows))
        for at, n in zip(start[size > SMALL_RUN].tolist(), size[size > SMALL_RUN].tolist()):
            yield from large(rows[at:at + n], rows[at])
        rows = rows[np.repeat((size > 1) & (size <= SMALL_RUN), size)]
        for step in range(1, SMALL_RUN):
            a, b = rows[:-step], rows[step:]
            meet = a[:, 0] == b[:, 0]
            if not meet.any():
                break
            a, b = a[meet], b[meet]
            ok = similar_enough(a[:, 3], a[:, 1], b[:, 3], b[:, 1])
            yield _pairs(a[ok, 2], b[ok, 2])

    last = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
        if not len(rows):
            continue
        before = np.vstack([rows[:1] - 1 if last is None else last[None, :], rows[:-1]])
        last = rows[-1]
        rows = rows[(rows[:, 0] != before[:, 0]) | (rows[:, 2] != before[:, 2])]     # equal sets follow each other
        if pivot is not None and len(rows):
            own = rows[:, 0] == pivot[0]
            if own.any():
                yield from large(rows[own], pivot)
            if not own.all():
                pivot = None
            rows = rows[~own]
        if not len(rows):
            continue
        rows = np.vstack([held, rows])
        tail = rows[:, 0] == rows[-1, 0]
        if tail.sum() > SMALL_RUN:
            pivot, held = rows[np.argmax(tail)], rows[:0]
        else:
            held, rows = rows[tail], rows[~tail]
        if len(rows):
            yield from work(rows)
    if len(held):
        yield from work(held)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    zero = np.zeros(len(a), np.int64)
    return _rows(0, zero, zero, zero, np.minimum(a, b), np.maximum(a, b))


def _rows(kind: int, token: np.ndarray, pos: np.ndarray, info: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(token), pa.array(pos.astype(np.int32)), pa.array(info), pa.array(a), pa.array(b)], ["kind", "token", "pos", "info", "a", "b"])


def candidates(found: DataFrame) -> DataFrame:
    """Rows of ``_runs`` for all nodes: what meets on a shingle is in one task, in order of place."""
    tokens = found.where("prefix IS NOT NULL").select("sig", "info", F.posexplode("prefix").alias("pos", "token"))
    sorted_ = tokens.select("token", "pos", "sig", "info").repartition("token").sortWithinPartitions("token", "pos", "sig")
    return sorted_.mapInArrow(_runs, RUN)


def shingle_sets(docs: DataFrame, found: DataFrame, sigs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(sig, shingles) of the nodes named in ``sigs`` (and of a few more), each once, kept on disk.

    One document of each node is read for it. A bitmap of fixed size tells these documents by the hash of their rows, so that no
    other text is shingled again; only their sets are shuffled. A part that is lost with an executor is worked
    out again. The sets are made here, before two sides of a join ask for them at once.
    """
    rows = found.where("sig IS NOT NULL").select("sig", "text_hash").join(sigs.distinct(), "sig", "left_semi").groupBy("sig").agg(F.min("text_hash").alias("text_hash"))
    word = F.shiftright(F.col("text_hash").bitwiseAND((1 << BITMAP_BITS) - 1), 6)
    bit = F.expr("shiftleft(1L, CAST(text_hash & 63 AS INT))")
    bitmap = np.zeros(1 << BITMAP_BITS - 6, np.int64)
    for row in rows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        bitmap[row["word"]] = row["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, wanted, seen = Shingler(size), shared.value, set()
        for part in slices(batches):
            at = part.column(0).to_numpy()
            part = part.filter(pa.array((wanted[(at & (1 << BITMAP_BITS) - 1) >> 6] >> (at & 63) & 1).astype(bool)))
            own, rows = [], []
            for text in part.column(1).to_pylist():
                s = shingler.of(text)
                if len(s):
                    sig = signature(s)
                    if sig not in seen:
                        seen.add(sig)
                        own.append(sig)
                        rows.append(s.view(np.int64))
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["sig", "shingles"])

    made = docs.select(F.xxhash64(col("doc_id"), col("text")).alias("text_hash"), col("text").alias("text")).mapInArrow(sets, "sig long, shingles array<long>")
    full = made.groupBy("sig").agg(F.first("shingles").alias("shingles")).persist(StorageLevel.DISK_ONLY)
    full.count()
    return full


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of signatures, each once, whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = left.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("of_a")), "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return cut_lineage(both.where((OVER + UNDER) * common >= OVER * (F.size("of_a") + F.size("of_b"))).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of an edge (a, b) reaches.

    Large-star and small-star steps (Kiveris et al., 2014): about as many rounds as the logarithm of the longest path.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))


def _dealt(rows: DataFrame, each: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``each`` that their key has; a key with many rows is dealt over ``SALTS`` groups."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return salted.join(each.withColumn("salt", _salts()), [key, "salt"], how).drop("salt")


def _crossing(long_runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of long runs with their component, where a shingle has several."""
    rows = long_runs.select("token", "pos", "info", F.col("a").alias("sig"))
    rows = rows.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    several = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    return _dealt(rows, several, "token", "sig")


def _across(others: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that share a token and pass the filters.

    Similar sets lie in the same or in neighbouring bands of sizes, which make the token's rows a band join; the rows
    of a band are dealt over ``SALTS`` groups, each of which meets all of ``others`` in that band.
    """
    band = f"CAST(floor(log(shiftright({{}}, 32)) / log({UNDER}D / {OVER})) AS INT)"
    left = others.select("token", "label", "sig", "info", "pos").withColumn("band", F.expr(f"explode(sequence({band.format('info')} - 1, {band.format('info')} + 1))")).withColumn("salt", _salts())
    right = rows.select("token", F.col("label").alias("label2"), F.col("sig").alias("sig2"), F.col("info").alias("info2"), F.col("pos").alias("pos2"))
    right = right.withColumn("band", F.expr(band.format("info2"))).withColumn("salt", F.pmod(F.xxhash64("sig2"), F.lit(SALTS)))
    return left.join(right, ["token", "band", "salt"]).where("label <> label2").where(filters_sql("info", "pos", "info2", "pos2")).select(*_pair("sig", "sig2"))


def _largest(rows: DataFrame) -> DataFrame:
    """(token, label, pivot's sig, info, pos) of the component with most nodes of each shingle."""
    each = rows.groupBy("token", "label").agg(F.count("*").alias("n"), F.min(F.struct("pos", "sig", "info")).alias("first"))
    top = each.groupBy("token").agg(F.max(F.struct("n", "label", "first")).alias("top"))
    return top.select("token", F.col("top.label").alias("top_label"), F.col("top.first.sig").alias("pivot"), F.col("top.first.info").alias("pivot_info"), F.col("top.first.pos").alias("pivot_pos"))


def filters_sql(a_info: str, a_pos: str, b_info: str, b_pos: str) -> str:
    """``similar_enough`` as a condition."""
    a, b = f"shiftright({a_info}, 32)", f"shiftright({b_info}, 32)"
    need = f"CAST(ceil({OVER} * ({a} + {b}) / {OVER + UNDER}.0D) AS LONG)"
    differ = " + ".join(f"abs((shiftright({a_info}, {s}) & 255) - (shiftright({b_info}, {s}) & 255))" for s in (24, 16, 8, 0))
    return f"{UNDER} * least({a}, {b}) >= {OVER} * greatest({a}, {b}) AND least({a} - {a_pos}, {b} - {b_pos}) >= {need} AND {differ} <= {a} + {b} - 2 * {need}"


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def link(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(nodes of all documents, (node, label) of the signatures that are linked with others)."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/jaccard-{uuid.uuid4()}"
    found = _stored(nodes(docs, levels(docs, size), size), f"{folder}/nodes")
    runs = _stored(candidates(found), f"{folder}/runs")
    long_runs = runs.where("kind = 1")
    tried = cut_lineage(runs.where("kind = 0").select("a", "b").distinct())
    sets = shingle_sets(docs, found, tried.select(F.explode(F.array("a", "b")).alias("sig")), size)
    links = verify(tried, sets)
    sets.unpersist()
    labels, sets, turn = cut_lineage(components(links)), None, 0
    while turn <= PIVOT_ROUNDS:
        rows = cut_lineage(_crossing(long_runs, labels))
        if rows.isEmpty():
            break
        sets = sets or shingle_sets(docs, found, rows.select("sig"), size)        # later rounds see fewer nodes, never others
        others = _dealt(rows, _largest(rows), "token", "sig").where("label <> top_label")
        if turn < PIVOT_ROUNDS:
            pairs = others.where(filters_sql("info", "pos", "pivot_info", "pivot_pos")).select(*_pair("sig", "pivot"))
        else:
            pairs = _across(others, rows)
        pairs = cut_lineage(pairs.distinct().join(tried, ["a", "b"], "left_anti"))         # no pair is verified again
        tried = tried.unionByName(pairs)
        more = verify(pairs, sets)
        if more.isEmpty():
            turn = PIVOT_ROUNDS if turn < PIVOT_ROUNDS else turn + 1        # the same pivots would come again
        else:
            turn += 1
            links = links.unionByName(more)
            labels = cut_lineage(components(links))
    if sets is not None:
        sets.unpersist()
    return found, labels


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of each document.

    One row for each row of ``docs``. Null and empty texts and texts without words have an empty set and are
    linked with nothing; fewer than five words make one shingle. Repeated rows are linked with each other; a
    null id takes part but is no component's id unless all ids there are null. No rows give no rows; other
    columns are not read.
    """
    found, labels = link(docs, size)
    return _with_component(found, labels).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _with_component(found: DataFrame, labels: DataFrame) -> DataFrame:
    rows = found.select("doc_id", "text_hash", "sig", "n")
    rows = _dealt(rows, labels.select(F.col("node").alias("sig"), "label"), "sig", "text_hash", "left").withColumn("label", F.coalesce("label", "sig"))
    several = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("label", "least", F.lit(True).alias("several"))
    rows = _dealt(rows, several, "label", "text_hash", "left")
    return rows.withColumn("component_id", F.when(F.col("several"), F.col("least")).otherwise(F.col("doc_id"))).drop("several", "least")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component (that of the least id) left.

    Texts without words are no copies of anything and all stay.
    """
    found, labels = link(docs, size)
    rows = _with_component(found, labels)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    grouped = rows.where("sig IS NOT NULL").groupBy("label").agg(F.min(order).alias("first"))
    repeats = rows.where("sig IS NOT NULL").groupBy("text_hash").agg(F.count("*").alias("copies"))
    kept = grouped.select(F.col("first.text_hash").alias("text_hash")).join(repeats, "text_hash")
    kept = cut_lineage(kept.unionByName(rows.where("sig IS NULL").select("text_hash").distinct().withColumn("copies", F.lit(1).cast("long"))))
    key, copies = fresh(docs, "text_hash"), fresh(docs, "copies")
    kept = kept.select(F.col("text_hash").alias(key), F.col("copies").alias(copies))
    joined = docs.withColumn(key, F.xxhash64(col("doc_id"), col("text"))).join(kept, key)
    once = joined.where(F.col(copies) == 1)
    if not kept.where(F.col(copies) > 1).isEmpty():
        once = once.unionByName(joined.where(F.col(copies) > 1).dropDuplicates([key]))
    return once.select(*[col(c) for c in docs.columns])
