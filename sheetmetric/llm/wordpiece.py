"""Token counts of greedy longest-match word pieces, without building pieces.

The vocabulary becomes a trie over bytes. Each node has a failure link: the node reached when the text
at hand does not go on, after the longest pieces of what was read are popped; how many are popped is
stored with it. A word is counted in one pass over its bytes (linear longest match after Song et al.,
"Fast WordPiece Tokenization", 2021).
"""
from __future__ import annotations

import functools
import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetmetric.llm.text import byte_stand_ins, col, slices, words_of

COUNTS = "doc_id long, n_words long, n_tokens long, n_unknown long"
END = b"\xff"               # end of a word: a byte that UTF-8 never has


class Automaton:
    """``initial`` pieces begin a word, ``inner`` ones continue it; a piece may end in ``END`` to match only at a word's end.

    With ``ends`` each word is closed by ``END`` before matching. ``initial`` alone stands for both kinds.
    """

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes] | None = None, ends: bool = False, limit: int = 700_000):
        self.ends, self.limit = ends, limit
        self.go: list[dict[int, int]] = [{}]
        piece = [False]

        def add(root: int, pieces: Iterable[bytes]) -> None:
            for p in pieces:
                node = root
                for byte in p:
                    step = self.go[node].get(byte)
                    if step is None:
                        step = self.go[node][byte] = len(self.go)
                        self.go.append({})
                        piece.append(False)
                    node = step
                piece[node] = node != root
        add(0, initial)
        self.inner = 0
        if inner is not None:
            self.inner = len(self.go)
            self.go.append({})
            piece.append(False)
            add(self.inner, inner)
        self.fail: list[int] = [-1] * len(self.go)
        self.popped = [0] * len(self.go)
        queue = deque(dict.fromkeys((0, self.inner)))
        while queue:
            node = queue.popleft()
            for byte, child in self.go[node].items():
                if piece[child]:
                    self.fail[child], self.popped[child] = self.inner, 1
                else:
                    link, count = self.fail[node], self.popped[node]
                    while link >= 0 and byte not in self.go[link]:
                        count += self.popped[link]
                        link = self.fail[link]
                    if link >= 0:
                        self.fail[child], self.popped[child] = self.go[link][byte], count
                queue.append(child)
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 where no pieces make it up."""
        go, fail, popped = self.go, self.fail, self.popped
        node = count = 0
        for byte in word + END if self.ends else word:
            step = go[node].get(byte)
            while step is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                step = go[node].get(byte)
            node = step
        while node != self.inner:
            count += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return count

    def total(self, words: list[bytes]) -> tuple[int, int]:
        """(tokens, unknown words) of a list of words; an unknown word is one token."""
        known = self.known
        for word in {w for w in words if w not in known}:
            known[word] = self.count(word)
        counts = list(map(known.__getitem__, words))
        unknown = counts.count(-1)
        if len(known) > self.limit:
            known.clear()
        return sum(counts) + 2 * unknown, unknown


@functools.lru_cache(maxsize=2)
def word_end_automaton(path: str) -> Automaton:
    """Pieces of a ``tokenizers`` file of a vocabulary with word ends (``</w>``), byte by byte in its printable stand-ins."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    stand_in = byte_stand_ins()

    def piece(token: str) -> bytes | None:
        body, end = (token[:-4], END) if token.endswith("</w>") else (token, b"")
        if not body or not all(c in stand_in for c in body):
            return None
        return bytes(stand_in[c] for c in body) + end

    return Automaton((p for t in vocabulary if (p := piece(t))), ends=True)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and word-piece tokens of each whole text.

    One row for each row of ``docs``, repeated and null ids too; null and empty texts count 0; a word that no
    pieces make up counts as one token and one unknown; no rows give no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = word_end_automaton(path)
        for part in slices(batches):
            found = []
            for text in part.column(1).to_pylist():
                words = words_of(text)
                found.append((len(words), *automaton.total(words)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), pa.int64()) for c in zip(*found))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(col("doc_id").cast("long").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text")).mapInArrow(run, COUNTS)
