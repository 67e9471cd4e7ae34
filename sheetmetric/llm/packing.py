"""Best-fit packing of tokenized documents into sequences.

Each task keeps a fixed number of open bins. A bitset tells which amounts of free space are open, so the
best fit of a piece (the least space that holds it) is the lowest bit at or above its length; when one bin
too many is open, the fullest closes. Pieces are dealt to tasks, about as many to each, and arrive there in an
order that tells nothing of their lengths (a hash of the row); of the next few at hand the longest is placed first,
so that short ones fill what long ones leave.
"""
from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.llm.bpe import Encoder
from sheetmetric.llm.text import byte_stand_ins, col, slices

CAPACITY = 1024
OPEN_BINS = 256             # bins a task keeps open
AT_HAND = 1024              # arrived pieces that are placed together, longest first
ROWS_PER_TASK = 16_000      # documents whose pieces one task packs
END_ID = 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def file_encoder(path: str, pattern: str) -> Encoder:
    """Encoder of a byte-level ``tokenizers`` file whose ids are the ranks of its merges."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    special = {t["content"] for t in content.get("added_tokens", ())}
    stand_in = byte_stand_ins()
    return Encoder({bytes(stand_in[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}, pattern)


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole if it fits, else the remainder first and then full pieces."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: its ids, then ``end_id``; a null text is empty and makes one piece of one token."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = file_encoder(path, pattern)
        for part in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                ids += end
                for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start:4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(own), own))
            yield _batch(rows, with_ids)

    plain = docs.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    out = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        out.append(pa.array([np.frombuffer(x, "<i4") for x in columns[5]], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(out, names)


class Bins:
    """Open bins of one task, by free space. The bitset's bit f is set while a bin with f free tokens is open."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS, first: int = 0):
        self.capacity, self.most, self.next = capacity, most, first
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << space
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece; a new bin where no open one holds it."""
        fit = self.bits >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.next
            self.next += 1
        left = space - length
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - space


def pack(pieces: DataFrame, tasks: int, capacity: int = CAPACITY, most: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to each piece (columns doc_id, piece, start, length, ids_crc32, more may follow).

    Every piece is placed once, repeated rows too; pieces must not be longer than ``capacity``. A task takes its
    rows in an order that depends on the rows alone, so that a rerun after a lost executor places them alike.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity, most, first=TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_HAND):
                part = batch.slice(at, AT_HAND)
                lengths = part.column("length").to_numpy()
                places = np.empty((2, len(lengths)), np.int64)
                for k in np.argsort(-lengths, kind="stable").tolist():
                    places[:, k] = bins.place(int(lengths[k]))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, places)], [*part.schema.names, "sequence_id", "offset"])

    own = ["doc_id", "piece", "length", "ids_crc32"]
    dealt = pieces.repartition(tasks).sortWithinPartitions(F.xxhash64(*own), *own)
    return dealt.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, most: int = OPEN_BINS, rows_per_task: int = ROWS_PER_TASK, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places.

    Null and empty texts give one piece of one token; repeated rows are packed as often as they come, null ids too;
    an empty table gives no rows; other columns are not read. With ``with_ids`` each piece carries its ids.
    """
    tasks = max(1, -(-docs.count() // rows_per_task))
    return pack(tokenize(docs, path, pattern, capacity, with_ids=with_ids), tasks, capacity, most)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pieces packed with their ids; a group holds one sequence."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return packed.groupBy("sequence_id").agg(F.flatten(parts).alias("ids"))
