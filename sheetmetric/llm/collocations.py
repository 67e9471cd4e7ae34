"""Phrases whose words stand together more often than chance, from a weighted de Bruijn graph of words.

Nodes are runs of ``longest`` - 1 words, edges runs of ``longest`` words between overlapping nodes, weighted by
how often the texts have them. Only edges (and where the text leaves the graph) are counted in texts:

* each place of a text gives one row, the longest run that starts there, lies in one piece and stays in the graph;
* equal rows are added up; rows shorter than an edge are the corrections for ends of pieces and for exits;
* the count of a shorter run is the flow out of it: all longer runs that begin with it, and its own corrections.

Frequent runs alone matter, and all parts of a frequent run are frequent. So the graph holds solid nodes only: a
first pass counts hashes of all runs shorter than an edge (exactly, by a shuffle) and a bitmap of fixed size keeps
those that reach ``least``. Equal hashes and equal bits add rows to the graph but never change a count.

Unary paths are compacted: a node whose whole flow comes by one edge and goes by one edge is no phrase of its own
(the edge is as frequent), and a path of such nodes becomes one row. Every occurrence of an inner node is an
occurrence of its whole path, so that no path is longer than a piece and none is a circle.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmetric.llm.text import col, mix, slices
from sheetmetric.session import cut_lineage, shared_folder

LONGEST = 3
LEAST = 10                  # least count of a phrase
COVERED = 50                # hundredths of a phrase's count in a longer one that drop it
TOP = 2_000                 # phrases of each language
TOKENS = 1 << 21            # words whose runs are added up in a task before rows leave it
BITMAP_BITS = 26            # bits that tell which runs are solid, as a power of two
CHUNK_BITS = 17             # of them in a row
SALTS = 16                  # parts of one word are looked up in as many groups
END = b"\xff"               # no byte of UTF-8: ends a piece
TABLE = bytes(0xFF if b in b".,;:!?" or 0x0A <= b <= 0x0D else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
ROW = "lang string, size int, phrase string, n long"


class Words(dict):
    """Numbers of words; 0 is the end of a piece."""

    def __init__(self):
        super().__init__()
        self[END]

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1

    def of(self, texts: list[str | None]) -> np.ndarray:
        """Numbers of all words of the texts, with an end behind each piece."""
        data = END.join((x or "").encode("utf-8", "surrogatepass") for x in texts) + END
        found = data.translate(TABLE).replace(END, b" \xff ").split()
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def portions(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[Words, dict[str, np.ndarray]]]:
    """Words of rows (lang, text) by language, some ``tokens`` at a time."""
    words, held, n = Words(), {}, 0
    for part in slices(batches):
        own: dict[str, list] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            own.setdefault(lang, []).append(text)
        for lang, texts in own.items():
            held.setdefault(lang, []).append(words.of(texts))
            n += len(held[lang][-1])
        if n >= tokens:
            yield words, {lang: np.concatenate(x) for lang, x in held.items()}
            words, held, n = Words(), {}, 0
    if held:
        yield words, {lang: np.concatenate(x) for lang, x in held.items()}


def run_hashes(ids: np.ndarray, hashes: np.ndarray, lang: str, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, whether it lies in one piece) of the run of k words from each place, for k = 1 to ``longest``."""
    own = hashes[ids]
    run, whole = mix(own + np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))), ids > 0
    yield run, whole
    for k in range(2, longest + 1):
        run = mix(run[:-1] * np.uint64(0xD6E8FEB86659FD93) + own[k - 1:])
        whole = whole[:-1] & (ids[k - 1:] > 0)
        yield run, whole


def word_hashes(words: Words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def solid(texts: DataFrame, longest: int, least: int, tokens: int) -> np.ndarray:
    """Bitmap of the hashes of runs shorter than ``longest`` words that the texts have ``least`` times or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, found in portions(batches, tokens):
            hashes = word_hashes(words)
            for lang, ids in found.items():
                every = [run[whole] for run, whole in run_hashes(ids, hashes, lang, longest - 1)]
                run, n = np.unique(np.concatenate(every), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(n.astype(np.int32))], ["run", "n"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for chunk in np.unique(at >> CHUNK_BITS).tolist():
                bits = chunks.setdefault(chunk, np.zeros(1 << CHUNK_BITS, bool))
                bits[at[at >> CHUNK_BITS == chunk] & (1 << CHUNK_BITS) - 1] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in chunks.values()], pa.binary())], ["chunk", "bits"])

    runs = texts.mapInArrow(count, "run long, n int").repartition("run").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    at = F.shiftrightunsigned("run", 64 - BITMAP_BITS)
    marked = runs.select(at.alias("at")).repartition(F.shiftright("at", CHUNK_BITS)).mapInArrow(mark, "chunk int, bits binary")
    out = np.zeros((1 << BITMAP_BITS - CHUNK_BITS, 1 << CHUNK_BITS - 3), np.uint8)
    for row in marked.collect():            # 8 MB at most
        out[row["chunk"]] |= np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _coded(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each row of numbers below ``size``; equal rows, and no others, have equal ones."""
    key, span = columns[0], size
    for column in columns[1:]:
        if span * size >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1]
            span = int(key.max(initial=0)) + 1
        key, span = key * size + column, span * size
    return key


def graph_rows(texts: DataFrame, bitmap: np.ndarray, longest: int, tokens: int) -> DataFrame:
    """(lang, size, phrase, n): edges, and corrections where the longest run in the graph from a place is shorter than an edge."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def known(hashes: np.ndarray) -> np.ndarray:
            at = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
            return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

        for words, found in portions(batches, tokens):
            hashes, spelt = word_hashes(words), pa.array(list(words), pa.binary())
            for lang, ids in found.items():
                length, inside, node = np.zeros(len(ids), np.int64), None, None
                for h, whole in run_hashes(ids, hashes, lang, longest - 1):
                    node = whole & known(h)                                     # the run from this place is solid ...
                    inside = node if inside is None else inside[:-1] & node     # ... and so are all that it begins with
                    length[:len(inside)] += inside
                edge = inside[:-1] & node[1:]
                length[:len(edge)] += edge
                length[ids == 0] = -1
                for k in range(longest + 1):
                    at = np.flatnonzero(length == k)
                    if not len(at):
                        continue
                    if k == 0:
                        phrases, n = pa.array([""]), np.array([len(at)])
                    else:
                        columns = [ids[at + j] for j in range(k)]
                        _, first, n = np.unique(_coded(columns, len(words)), return_index=True, return_counts=True)
                        phrases = pc.binary_join_element_wise(*(spelt.take(pa.array(c[first])) for c in columns), b" ") if k > 1 else spelt.take(pa.array(columns[0][first]))
                        phrases = phrases.cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(np.full(len(n), k, np.int32)), phrases, pa.array(n.astype(np.int64))], ["lang", "size", "phrase", "n"])

    return texts.mapInArrow(run, ROW)


def first_words(phrase: str | Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def last_words(phrase: str | Column, k: int) -> Column:
    return F.substring_index(phrase, " ", -k)


class Graph:
    """Counts of all frequent runs of 1 to ``longest`` words, and of all words (size 0), by language."""

    def __init__(self, docs: DataFrame, longest: int = LONGEST, least: int = LEAST, tokens: int = TOKENS):
        self.longest, self.least = longest, least
        texts = docs.select(F.coalesce(col("lang").cast("string"), F.lit("und")).alias("lang"), col("text").cast("string").alias("text"))
        rows = graph_rows(texts, solid(texts, longest, least, tokens), longest, tokens)
        rows = rows.repartition("lang", "size", "phrase").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
        folder = f"{shared_folder(docs.sparkSession)}/collocations-{uuid.uuid4()}"
        rows = _stored(rows, f"{folder}/rows")
        level, self.counts = rows.where(F.col("size") == longest).select("lang", "phrase", "n"), {}
        for k in range(longest, -1, -1):
            if k < longest:
                out = level.select("lang", first_words("phrase", k).alias("phrase"), "n").unionByName(rows.where(F.col("size") == k).select("lang", "phrase", "n"))
                level = _stored(out.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), f"{folder}/{k}")
            self.counts[k] = level.where(F.col("n") >= least) if k else level

    def nodes(self) -> DataFrame:
        """lang, node, n, and the heaviest edge that comes (``by``, ``w_in``) and that goes (``to``, ``w_out``); ``unary`` where both are all of its flow."""
        edges, k = self.counts[self.longest], self.longest - 1
        comes = edges.groupBy("lang", last_words("phrase", k).alias("node")).agg(F.max("n").alias("w_in"), F.max_by("phrase", "n").alias("by"))
        goes = edges.groupBy("lang", first_words("phrase", k).alias("node")).agg(F.max("n").alias("w_out"), F.max_by("phrase", "n").alias("to"))
        nodes = self.counts[k].withColumnRenamed("phrase", "node").join(comes, ["lang", "node"], "left").join(goes, ["lang", "node"], "left")
        return nodes.withColumn("unary", F.coalesce((F.col("w_in") == F.col("n")) & (F.col("w_out") == F.col("n")), F.lit(False)))

    def paths(self, nodes: DataFrame) -> DataFrame:
        """(lang, path, n): edges, with those that follow each other over unary nodes as one path of words.

        The head of each path is found by pointer doubling, in about as many rounds as the logarithm of the longest path.
        """
        ahead = cut_lineage(nodes.where("unary").select("lang", F.col("to").alias("edge"), F.col("by").alias("head"), F.lit(1).cast("long").alias("place")))
        while True:
            back = ahead.select("lang", F.col("edge").alias("head"), F.col("head").alias("head2"), F.col("place").alias("place2"))
            moved = cut_lineage(ahead.join(back, ["lang", "head"], "left").select(
                "lang", "edge", F.coalesce("head2", "head").alias("head"), (F.col("place") + F.coalesce("place2", F.lit(0))).alias("place"), F.col("head2").isNotNull().alias("moved")))
            ahead = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        edges = self.counts[self.longest].withColumnRenamed("phrase", "edge").join(ahead, ["lang", "edge"], "left")
        edges = edges.select("lang", F.coalesce("head", "edge").alias("head"), F.coalesce("place", F.lit(0)).alias("place"), last_words("edge", 1).alias("word"), "n")
        grouped = edges.groupBy("lang", "head").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
        return grouped.select("lang", F.concat_ws(" ", first_words("head", self.longest - 1), F.col("words.word")).alias("path"), "n")

    def candidates(self, covered: int = COVERED) -> DataFrame:
        """(lang, phrase, size, a) of the frequent phrases of 2 words or more that no longer one covers."""
        nodes = cut_lineage(self.nodes())
        words, k = F.split("path", " "), self.longest
        windows = self.paths(nodes).select("lang", F.col("n").alias("a"), words.alias("w")).select("lang", "a", F.explode(F.expr(f"transform(sequence(1, size(w) - {k - 1}), i -> array_join(slice(w, i, {k}), ' '))")).alias("phrase"))
        out = windows.select("lang", "phrase", F.lit(k).alias("size"), "a")
        for size in range(k - 1, 1, -1):
            if size == k - 1:
                rows = nodes.where(~F.col("unary") | F.lit(covered > 100)).select("lang", F.col("node").alias("phrase"), F.col("n").alias("a"), F.greatest("w_in", "w_out").alias("most"))
            else:
                longer = self.counts[size + 1]
                both = longer.select("lang", first_words("phrase", size).alias("phrase"), "n").unionByName(longer.select("lang", last_words("phrase", size).alias("phrase"), "n"))
                rows = self.counts[size].withColumnRenamed("n", "a").join(both.groupBy("lang", "phrase").agg(F.max("n").alias("most")), ["lang", "phrase"], "left")
            kept = F.coalesce(100 * F.col("most") < covered * F.col("a"), F.lit(True))
            out = out.unionByName(rows.where(kept).select("lang", "phrase", F.lit(size).alias("size"), "a"))
        return out

    def scored(self, candidates: DataFrame) -> DataFrame:
        """lang, phrase, a, l, r and score of each candidate at its lowest-scoring cut."""
        salt = lambda part: F.when(F.instr(part, " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
        parts = None
        for k in range(1, self.longest):
            own = self.counts[k].withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))) if k == 1 else F.lit(0))
            parts = own if parts is None else parts.unionByName(own)
        left = parts.select("lang", F.col("phrase").alias("left"), F.col("salt").alias("salt_l"), F.col("n").alias("l"))
        right = parts.select("lang", F.col("phrase").alias("right"), F.col("salt").alias("salt_r"), F.col("n").alias("r"))
        cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
        cuts = cuts.withColumn("salt_l", salt(F.col("left"))).withColumn("salt_r", salt(F.col("right")))
        cuts = cuts.join(left, ["lang", "left", "salt_l"]).join(right, ["lang", "right", "salt_r"])
        cuts = cuts.withColumn("score", F.expr("CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"))
        best = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, tokens: int = TOKENS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of each language.

    Null languages count as ``und``; null and empty texts have no words. Ties in score go to the more frequent
    phrase, then to the smaller one in UTF-8. Repeated rows count as often as they are there. Tables without rows or without
    frequent phrases give no rows; columns but lang and text are not read. ``least`` is at least 1, ``longest`` at least 2;
    counts stay below 10**15.
    """
    graph = Graph(docs, longest, least, tokens)
    found = graph.scored(graph.candidates(covered)).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)     # SALTS * top of a language at most
    order = Window.partitionBy("lang").orderBy(*order)
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(graph.counts[0].select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def paths(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, path, n): the compacted graph, frequent runs of words of any length that always go on in one way."""
    graph = Graph(docs, longest, least)
    return graph.paths(cut_lineage(graph.nodes()))
