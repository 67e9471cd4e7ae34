"""Byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern; that of byte-level vocabularies (``RUNS``) is worked out for all
characters of many texts at once. Each distinct piece is merged once per worker. Pieces of
similar length share a padded matrix: in each round every row merges its leftmost pair of least rank
(one hashed lookup for each of the two pairs that a merge changes) and closes up, and rows without
a known pair leave. Pieces over 64 bytes are merged as single rows, all equal pairs of a round at
once as long as no merge opens a pair of lower rank, which gives the same ids.
"""
from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.llm.text import col, slices

NONE = np.int32(2**31 - 1)
SHIFT = np.uint64(64 - 21)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(2**64 - 1)
WIDTHS = (4, 6, 8, 11, 16, 24, 40, 64)
CELLS = 400_000
CHARACTERS = 2_000_000      # of texts that are cut at once
SPACE, OTHER = 3, 4         # kinds of characters, beside letters (1) and numbers (2)
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Ranks of byte strings, and the pairs that make them in an open-addressing hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        size = 1 << 21
        if len(pairs) > size // 2:
            raise ValueError("vocabulary has too many pairs for the table")
        self.keys, self.values = np.full(size, EMPTY), np.full(size, NONE)
        at = (keys * SPREAD) >> SHIFT
        while len(keys):                                    # the first of those that meet takes the slot, the rest step on
            free = self.keys[at] == EMPTY
            slot, first = np.unique(np.where(free, at, size), return_index=True)
            first = first[slot < size]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + np.uint64(1)) & np.uint64(size - 1)
        self.first = self.lookup(np.repeat(self.bytes, 256), np.tile(self.bytes, 256)).reshape(256, 256)      # of two bytes

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they do not merge (or an id is negative)."""
        key = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = (key * SPREAD) >> SHIFT
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        todo = np.flatnonzero((found != key) & (found != EMPTY))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & np.uint64(len(self.keys) - 1)
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != EMPTY)]
        return np.where((a < 0) | (b < 0), NONE, out)

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, packed as unsigned 32-bit integers, of pieces of at most ``width`` bytes."""
        out: list[bytes] = [b""] * len(pieces)
        raw = np.array(pieces, f"S{width}").view(np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < size[:, None], self.bytes[raw], np.int32(-1))
        ids = np.hstack([ids, np.full((len(pieces), 1), -1, np.int32)])
        rank = np.full(raw.shape, NONE)
        rank[:, :-1] = np.where(ids[:, 1:-1] < 0, NONE, self.first[raw[:, :-1], raw[:, 1:]])
        row = np.arange(len(pieces))
        while True:
            best = rank.argmin(1)
            low = rank[np.arange(len(row)), best]
            done = low == NONE
            if done.any():
                own, ends = ids[done], np.cumsum(4 * size[done]).tolist()
                packed = own[own >= 0].astype("<u4").tobytes()
                for r, a, b in zip(row[done].tolist(), [0, *ends], ends):
                    out[r] = packed[a:b]
                keep = ~done
                row, ids, rank, size, best, low = row[keep], ids[keep], rank[keep], size[keep], best[keep], low[keep]
                if not len(row):
                    return out
            each = np.arange(len(row))
            ids[each, best] = low
            behind = np.arange(ids.shape[1] - 1) > best[:, None]
            ids = np.where(behind, ids[:, 1:], ids[:, :-1])
            rank = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            size = size - 1
            left = np.maximum(best - 1, 0)
            before, after = self.lookup(ids[each, left], low), self.lookup(low, ids[each, best + 1])
            rank[each, left] = np.where(best > 0, before, rank[each, left])
            has = best < rank.shape[1]
            rank[each[has], best[has]] = after[has]

    def _long(self, piece: bytes) -> bytes:
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        rank = self.lookup(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) != NONE:
            at = np.flatnonzero(rank == low)
            start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, -1, at))
            at = at[(at - start) % 2 == 0]                  # of overlapping pairs every second one
            joined = np.diff(at, prepend=-9) == 2
            left = np.where(joined, low, np.where(at > 0, ids[np.maximum(at - 1, 0)], -1))
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            same = np.full(len(at), low)
            opened = np.flatnonzero((self.lookup(left, same) < low) | (self.lookup(same, right) < low))
            if len(opened):
                at = at[:opened[0] + 1]
            ids[at] = low
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            new = at - np.arange(len(at))
            for q in (new[new > 0] - 1, new[new < len(rank)]):
                rank[q] = self.lookup(ids[q], ids[q + 1])
        return ids.astype("<u4").tobytes()

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece (one match of the pattern each)."""
        out: list[bytes] = [b""] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for i, rank in enumerate(map(self.ranks.get, pieces)):
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
                size[i] = 0
        for width in WIDTHS:
            todo = np.flatnonzero((size > low) & (size <= width)).tolist()
            step = max(1, CELLS // width)
            for at in range(0, len(todo), step):
                part = todo[at:at + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width)):
                    out[i] = ids
            low = width
        for i in np.flatnonzero(size > low).tolist():
            out[i] = self._long(pieces[i])
        return out


class Kinds:
    """The kind of each character (letter, number, white space, other), by the classes of ``regex``; asked once for each."""

    def __init__(self):
        self.find = regex.compile(r"(\p{L})|(\p{N})|(\s)|.", regex.DOTALL).match
        self.known = np.zeros(0x110000, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.known[points]
        if not kinds.all():
            for c in np.unique(points[kinds == 0]).tolist():
                self.known[c] = self.find(chr(c)).lastindex or OTHER
            kinds = self.known[points]
        return kinds


def starts(points: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a match of ``RUNS`` starts at each of the characters (and True behind the last) of texts that end at ``ends``.

    One starts where the kind changes, but a space belongs to what follows; the last of several white spaces stands
    alone where more text follows. An apostrophe that starts a match takes the letters of ``RUNS`` with it.
    """
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    new = first.copy()
    new[1:n] |= (kinds[1:] != kinds[:-1]) & (points[:-1] != ord(" "))
    space = kinds == SPACE
    new[1:n - 1] |= space[1:-1] & space[:-2] & ~space[2:] & ~first[2:n]
    at = np.flatnonzero(new[:n] & (points == ord("'")))
    if len(at):
        one = np.where(first[at + 1], 0, points[np.minimum(at + 1, n - 1)])
        two = np.where(first[at + 1] | first[np.minimum(at + 2, n)], 0, points[np.minimum(at + 2, n - 1)])
        size = 2 * np.isin(one, [ord(c) for c in "stmd"])
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, size = at[size > 0], size[size > 0]
        new[at + 1] = False
        new[at + size] = True
    return new


class Encoder:
    """Texts to packed ids. The ids of matches are remembered: of two generations, each of up to ``limit``, the older is forgotten."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 450_000):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.kinds = Kinds() if pattern == RUNS else None
        self.limit = limit
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The matches of all texts in UTF-8, and how many there are up to the end of each text."""
        if self.kinds is None:
            found = [self.pattern.findall(t) for t in texts]
            return pa.array([m.encode("utf-8", "surrogatepass") for f in found for m in f], pa.large_binary()), np.cumsum([len(f) for f in found])
        whole = "".join(texts)
        raw = whole.encode("utf-8", "surrogatepass")
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        at = np.flatnonzero(starts(points, self.kinds.of(points), ends))
        places = at
        if len(raw) > len(points):
            size = (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000) + np.uint8(1)
            before = np.zeros(len(points) + 1, np.int64)
            np.cumsum(size, out=before[1:])
            places = before[at]
        matches = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw)])
        return matches, np.searchsorted(at, ends)

    def _ids(self, matches: list[bytes]) -> list[bytes]:
        """Packed ids of distinct matches; those of up to 64 bytes are remembered."""
        if len(self.words) > self.limit:
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        ids = list(map(known.get, matches))
        new = []
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = older.get(matches[i])
            if ids[i] is None:
                new.append(i)
            else:
                known[matches[i]] = ids[i]
        for i, x in zip(new, self.vocabulary.encode([matches[i] for i in new])):
            ids[i] = x
            if len(matches[i]) <= WIDTHS[-1]:
                known[matches[i]] = x
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. Texts of some ``CHARACTERS`` together are cut at once, and each distinct match among them is looked up once."""
        out: list[bytes] = []
        low = total = 0
        for high, text in enumerate(texts, 1):
            total += len(text)
            if total >= CHARACTERS or high == len(texts):
                out += self._encode(texts[low:high])
                low, total = high, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        matches, ends = self.cut(texts)
        if not len(matches):
            return [b""] * len(texts)
        distinct = matches.dictionary_encode()
        ids = pa.array(self._ids(distinct.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(distinct.indices)
        _, places, raw = ids.buffers()
        ends = np.frombuffer(places, np.int64)[ends].tolist()
        return [raw[a:b].to_pybytes() for a, b in zip([0, *ends], ends)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


def decode(vocabulary: Vocabulary, ids: bytes) -> bytes:
    """The bytes that packed ids stand for."""
    return b"".join(map(vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of each whole text, in the order of the table; a null text has none.

    ``path`` is a rank file that every executor has (as part of an installed package).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path, pattern)
        for part in slices(batches):
            ids = encoder.encode(part.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return _input(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of a table of ``encode_texts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rank_encoder(path, pattern).vocabulary
        for part in slices(batches):
            raw = [decode(vocabulary, np.array(x or [], "<u4").tobytes()) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text in one pass; gives counts and digests in place of ids.

    One row for each row of ``docs`` (repeated and null ids too); null and empty texts have no
    tokens and the digest of nothing; no rows give no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path, pattern)
        for part in slices(batches):
            ids = encoder.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(decode(encoder.vocabulary, x)).hexdigest() for x in ids])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(docs).mapInArrow(run, DIGESTS)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
