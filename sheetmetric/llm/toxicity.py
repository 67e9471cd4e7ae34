"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its byte n-grams (hashed), a text the mean of its words, and two
softmax outputs tell its class; embeddings and softmax are trained together. A misspelling never seen
shares most n-grams with the word it hides, and so most of its vector. The whole is linear, so that
scoring needs one number per n-gram bucket.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmetric.llm.text import col, mix, place_of, slices

BITS = 20                   # n-gram buckets, as a power of two
SIZES = (3, 4, 5, 6)        # lengths of n-grams in bytes
WIDTH = 8                   # numbers in an embedding
SEEN_IN = 0.003             # a bucket gets an embedding if this share of the training rows has it, and two rows
TRAIN_TOXIC, TRAIN_CLEAN = 1200, 2400      # most labelled rows that training reads of each class
COMMON = 1e-4               # share of all n-grams at which a bucket counts half in the mean
PADDING = 40                # zero vectors that join each mean, so that few words decide less
THRESHOLD = 0.7
EDGES = b".,;:!?\"'()[]{}<>|&#*$%-_=+/\\"
SCORES = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from; a null id counts as held out nowhere and is not learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each n-gram of the words, punctuation at their ends left off."""
    marked = [b"<" + (w.strip(EDGES) or w) + b">" for w in words]
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), size)
    room = np.repeat(np.cumsum(size), size) - np.arange(len(raw))      # bytes up to the word's end
    owners, buckets, rolled = [], [], np.zeros(len(raw), np.uint64)
    for n in range(1, min(max(SIZES), len(raw)) + 1):
        rolled = rolled * np.uint64(0x100000001B3)
        rolled[:len(raw) - n + 1] += raw[n - 1:]
        if n in SIZES:
            at = np.flatnonzero(room >= n)
            owners.append(owner[at])
            buckets.append((mix(rolled[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    weights: np.ndarray     # one number per bucket: embedding times the difference of the softmax rows
    bias: float

    def word_scores(self, words: list[bytes]) -> list[float]:
        out: list[float] = []
        for at in range(0, len(words), 4_000):
            part = words[at:at + 4_000]
            owner, bucket = ngrams(part)
            total = np.bincount(owner, self.weights[bucket], len(part))
            out += (total / np.maximum(np.bincount(owner, minlength=len(part)), 1)).tolist()
        return out


class Scorer:
    """Scores texts, remembering the numbers of words: of two generations, each of some ``limit``, the older is forgotten."""

    def __init__(self, model: Model, limit: int = 125_000):
        self.model, self.limit, self.known, self.older = model, limit, {}, {}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        cut = [split(t) for t in texts]
        new = {w for words in cut for w in words if w not in known}
        known.update((w, older[w]) for w in new if w in older)
        if new := [w for w in new if w not in known]:
            known.update(zip(new, self.model.word_scores(new)))
        mean = np.array([sum(map(known.__getitem__, words)) / (len(words) + PADDING) for words in cut])
        return 1 / (1 + np.exp(-np.clip(mean + self.model.bias, -60, 60)))


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights in its mean vector."""
    words = split(text)
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    owner, bucket = ngrams(list(index))
    share = np.bincount(ids) / (len(words) + PADDING) / np.maximum(np.bincount(owner, minlength=len(index)), 1)
    found, place = np.unique(bucket, return_inverse=True)
    return found, np.bincount(place, share[owner])


def train(texts: list[str | None], labels: list[int], least_steps: int = 300, batch: int = 128, rate: float = 0.02, scale: float = 200.0, shrink: float = 1.0, seed: int = 5) -> Model:
    """Embeddings and softmax by Adam on the cross entropy, both classes weighing alike.

    Embeddings start at zero, so that buckets never met add nothing, and each step draws their norms towards
    zero (group lasso), so that only buckets that tell the classes apart throughout keep one. Without rows of both classes the model
    gives every text the share of toxic rows (a half without rows).
    """
    y = np.array(labels, np.int64)
    count = np.bincount(y, minlength=2)
    weights = np.zeros(1 << BITS, np.float32)
    if not count.all():
        share = (count[1] + 0.5) / (count.sum() + 1)
        return Model(weights, float(np.log(share / (1 - share))))
    seen, mass = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS)
    for text in texts:                                      # bags are made twice, here for these sums only: all of them at once are large
        found, share = _bag(text)
        seen[found] += 1
        mass[found] += share
    calm = COMMON / (COMMON + mass / len(y))                # weight of a bucket in the mean: frequent ones count little
    used = np.flatnonzero(seen >= max(2, SEEN_IN * len(y)))
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    begin = np.zeros(len(y) + 1, np.int64)                  # where the bag of a text begins in the two arrays that hold them all
    columns, shares = np.empty(seen[used].sum(), np.int32), np.empty(seen[used].sum(), np.float32)
    for i, text in enumerate(texts):
        found, share = _bag(text)
        kept = place[found] >= 0
        begin[i + 1] = begin[i] + kept.sum()
        columns[begin[i]:begin[i + 1]] = place[found[kept]]
        shares[begin[i]:begin[i + 1]] = (share * calm[found])[kept]
    calm = calm[used]
    del seen, mass, place
    draw = np.random.default_rng(seed)
    value = [np.zeros((len(used), WIDTH), np.float32), draw.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)]
    first, second = [np.zeros_like(v) for v in value], [np.zeros_like(v) for v in value]
    weigh = (len(y) / 2 / count[y]).astype(np.float32)
    met, rank = np.zeros(len(used), bool), np.zeros(len(used), np.int64)      # columns of a batch, and their places among these
    steps = 0
    while steps < least_steps:
        for some in np.array_split(draw.permutation(len(y)), max(1, len(y) // batch)):
            cols, share = (np.concatenate([x[begin[i]:begin[i + 1]] for i in some]) for x in (columns, shares))
            row = np.repeat(np.arange(len(some)), begin[some + 1] - begin[some])
            embedding, softmax, bias = value
            met[:] = False
            met[cols] = True
            found = np.flatnonzero(met)
            rank[found] = np.arange(len(found))
            matrix = np.zeros((len(some), len(found)), np.float32)
            matrix[row, rank[cols]] = share
            hidden = matrix @ embedding[found] * scale
            logit = hidden @ softmax + bias
            error = np.exp(logit - logit.max(1, keepdims=True))
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(some)), y[some]] -= 1
            error *= (weigh[some] / len(some))[:, None]
            slope = np.zeros_like(embedding)
            slope[found] = matrix.T @ (error @ softmax.T) * scale
            steps += 1
            for v, g, m, s in zip(value, (slope, hidden.T @ error, error.sum(0)), first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-8)
            norm = np.sqrt((embedding * embedding).sum(1, keepdims=True))
            embedding *= np.maximum(0, 1 - rate * shrink / np.maximum(norm, 1e-9))
    embedding, softmax, bias = value
    weights[used] = embedding @ (softmax[:, 1] - softmax[:, 0]) * scale * calm
    return Model(weights, float(bias[1] - bias[0]))


def training_frame(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> DataFrame:
    """(doc_id, toxic, text): a bounded sample of labelled rows, the first of each class by a hash of the id, held-out rows left out.

    At most ``toxic`` + ``clean`` ids are chosen from the labels and joined to their texts; of rows that repeat
    an id one text is taken.
    """
    known = labels.select(col("doc_id").cast("long").alias("doc_id"), col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxic).unionByName(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(clean))
    texts = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))


def training_rows(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> list[tuple[str | None, int]]:
    """Texts and labels of ``training_frame``, in order of the id."""
    return [(r["text"], r["toxic"]) for r in training_frame(docs, labels, toxic, clean).orderBy("doc_id").collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, trained in one task on the bounded sample; only its numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        model = train([r[2] for r in rows], [r[1] for r in rows])
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([model.bias])})

    found = training_frame(docs, labels).repartition(1).mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(found["weights"], "<f4"), found["bias"]) if found else train([], [])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Score of each whole text, from the text alone.

    One row for each row of ``docs``, repeated and null ids too; null and empty texts get the score of a text
    without words (the bias); no rows give no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches):
            score = scorer.score(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), col("text").alias("text")).mapInArrow(run, SCORES)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    at = place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches):
            yield part.filter(pa.array(scorer.score(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
