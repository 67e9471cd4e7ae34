"""Resampling of documents towards a target: importance weights from hashed n-grams, Gumbel top-k.

The features of a text are its runs of 1 to ``longest`` words, hashed into buckets. Arrow kernels lower-case,
split, flatten and dictionary-encode a slice of texts at once; shifted dictionary indices form the runs, each
distinct run is hashed once (its CRC goes on from that of the run without its last word), and the buckets are
taken back to all places, where gains are summed per document.

A bucket's gain is the logarithm of how much commoner it is in the target than in the documents. A document's
weight is its mean gain, and the highest of weight plus Gumbel noise are drawn: a sample without replacement,
with probabilities in proportion to exp(weight / 1000).
"""
from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.llm.text import col, slices
from sheetmetric.session import shared_folder

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 2
SHARE = 25                  # hundredths of the documents long enough that are drawn
LEAST_WORDS = 20
SEED = 7
CHUNK = 1_000               # buckets in a row of counts
ROWS = 512                  # texts handled at once
SCORED = "doc_id long, text_hash long, n_words long, n_features long, weight long, score long"


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(words of each text, [(text, bucket) of all runs of k words for k = 1, 2, ...]); nulls have no words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    index, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()).to_pylist()
    size = max(len(vocabulary), 1)
    crc = np.fromiter(map(zlib.crc32, vocabulary), np.uint32, len(vocabulary))
    run, found = index, []
    for k in range(1, longest + 1):
        if k > 1:
            whole = owner[k - 1:] == owner[:len(owner) - k + 1]
            pairs = pa.array((run[:len(whole)] * size + index[k - 1:])[whole]).dictionary_encode()
            distinct = pairs.dictionary.to_numpy(zero_copy_only=False)
            started = np.fromiter(map(zlib.crc32, repeat(b" "), crc.tolist()), np.uint32, len(crc))
            last = map(vocabulary.__getitem__, (distinct % size).tolist())
            crc = np.fromiter(map(zlib.crc32, last, started[distinct // size].tolist()), np.uint32, len(distinct))
            run = np.zeros(len(whole), np.int64)
            run[whole] = pairs.indices.to_numpy(zero_copy_only=False)
            found.append((owner[k - 1:][whole], (crc % np.uint32(buckets)).astype(np.int64)[run[whole]]))
        else:
            found.append((owner, (crc % np.uint32(buckets)).astype(np.int64)[run]))
    return np.bincount(owner, minlength=len(texts)), found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all rows in each bucket; as many numbers reach the driver as there are buckets."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, ROWS):
            for _, found in features(part.column(0), buckets, longest)[1]:
                total += np.bincount(found, minlength=buckets)
        if total.any():
            at = range(0, buckets, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([x // CHUNK for x in at], pa.int32()), pa.array([total[x:x + CHUNK].tobytes() for x in at], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    counted = texts.select(col("text").cast("string").alias("text")).mapInArrow(count, "chunk int, counts binary")
    out = np.zeros(buckets, np.int64)
    for row in counted.repartition(-(-buckets // CHUNK), "chunk").mapInArrow(add, "chunk int, counts binary").collect():
        part = np.frombuffer(row["counts"], np.int64)
        out[row["chunk"] * CHUNK:row["chunk"] * CHUNK + len(part)] = part
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, in thousandths of a natural logarithm, rounded down."""
    of_source, of_target, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(of_source + n) / (float(s + 1) * float(of_target + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of a document, the same in every run; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight and score of each document."""
    buckets, shared = len(gain), docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for part in slices(batches, ROWS):
            ids = part.column(0).to_pylist()
            n_words, found = features(part.column(2), buckets, longest)
            n, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for owner, bucket in found:
                n += np.bincount(owner, minlength=len(ids))
                total += np.bincount(owner, weights=value[bucket], minlength=len(ids)).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            points = weight + np.array([noise(x, seed) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight, points))], ["doc_id", "text_hash", "n_words", "n_features", "weight", "score"])

    plain = docs.select(col("doc_id").cast("long").alias("doc_id"), F.xxhash64(col("doc_id"), col("text")).alias("text_hash"), col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, SCORED)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words and text_hash of each document; ``rank`` is null where it is not drawn.

    Of the N documents with ``least_words`` words, floor(share * N / 100) are drawn: the highest scores, ties to
    the smaller id. One row for each row of ``docs``. Null and empty texts have no features, weight 0 and are never
    drawn if ``least_words`` is above 0; a null id stands behind all others in a tie. Repeated rows have one score and are
    drawn one by one, in the order they are read. Empty tables give no rows, an empty target is a flat one; other columns are not read.

    Ranks are places in a sort by range: no task sees more than its range, and the driver only each range's size.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/resample-{uuid.uuid4()}"
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    scored = _stored(score(docs, gain, longest, seed).withColumn("at", F.monotonically_increasing_id()), f"{folder}/scored")
    able = F.col("n_words") >= least_words
    order = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("at").asc()]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = _stored(placed, f"{folder}/placed")
    ranges = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n"), F.count_if(able).alias("able")).collect()
    drawn, before, starts = share * sum(r["able"] for r in ranges) // 100, 0, []
    for r in sorted(ranges, key=lambda r: r["range"]):
        starts.append((r["range"], before))
        before += r["n"]
    start = spark.createDataFrame(starts, "range long, before long")
    ranked = placed.withColumn("range", F.shiftright("place", 33)).join(F.broadcast(start), "range")        # a row for each range
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"), "n_words", "text_hash")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, all columns; of rows with one id and text all stay if any is drawn."""
    drawn = resample(docs, target, **options).where("rank IS NOT NULL").select("text_hash").distinct()
    return docs.join(drawn, F.xxhash64(col("doc_id"), col("text")) == drawn["text_hash"], "left_semi")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
