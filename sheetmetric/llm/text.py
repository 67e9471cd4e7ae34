"""Helpers shared by the operators of this folder."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    """The column of exactly this name, dots and spaces in it or not."""
    return F.col("`" + name.replace("`", "``") + "`")


def place_of(df: DataFrame, name: str) -> int:
    """The number of the column that ``col(name)`` means, so that a task finds it among all of them without a second copy."""
    df.select(col(name))        # an error where no column is meant, or several
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices, so that the Python objects of one step stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 (bytes methods know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def byte_stand_ins() -> dict[str, int]:
    """The byte behind each printable character of byte-level vocabularies: itself, or the next free code point from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class WordHashes(dict):
    """64-bit hash of each word, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        words, size = words[None, :], n
        total = np.zeros(1, np.uint64)
        for k in range(n):
            total = mix(total + words[:, k] + np.uint64(k + 1))
        return mix(total + np.uint64(n))
    count = n - size + 1
    total = np.zeros(count, np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xD6E8FEB86659FD93 & MASK
        total += words[k:k + count] * np.uint64(factor)
    return np.unique(mix(total))
