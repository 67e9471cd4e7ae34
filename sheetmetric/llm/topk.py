"""Exact search for the nearest vectors by integer inner product.

Queries form blocks and candidates shards of bounded size, dealt at random. Each pair of a block and a
shard is one group: tiles of its score matrix are worked out as matrix products, the best of each tile are
picked by partial selection, and the lists of a query are merged in a tree of small groups.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmetric.llm.text import col

BLOCK = 4096                # queries in a block
SHARD = 8192                # candidates in a shard
TILE = 1024                 # candidates in a matrix product
FAN = 32                    # lists merged in one group
LEAST, MOST = -(2**63), 2**63 - 1
HITS = "query_id long, vec_id long, score long"


def is_query(vec_id: Column) -> Column:
    return vec_id % 50 == 0


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each component; vectors null, or with null or non-finite components, are left out, and so are null ids."""
    x = col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(col("vec_id").isNotNull() & x.isNotNull() & finite)
    return kept.select(col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: _floor(v, scale)).alias("v"))


def _floor(v: Column, scale: int) -> Column:
    scaled = v.cast("double") * scale
    return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)      # doubles from 2**53 on are whole


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest scores, ties to smaller ids; scores are whole."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def block_hits(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the best ``k`` candidates of other ids for each query of a block in one shard."""
    width = q.shape[1]
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * width
    exact = largest < 2.0**53                     # then products and sums of doubles are whole and exact
    found: list[list] = [[] for _ in query_ids]
    for at in range(0, len(ids), TILE):
        tile, own = v[at:at + TILE], ids[at:at + TILE]
        if exact:
            scores = q @ tile.T
        else:
            scores = np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in tile.tolist()] for x in q.tolist()], object).reshape(len(q), len(tile))
        for i, line in enumerate(scores):
            other = np.flatnonzero(own != query_ids[i])
            picked = other[best(line[other], own[other], k)] if exact else other[sorted(range(len(other)), key=lambda j: (-line[other[j]], own[other[j]]))[:k]]
            found[i] += [(int(s), int(c)) for s, c in zip(line[picked], own[picked])]
    return [(int(query_ids[i]), c, max(LEAST, min(MOST, s))) for i, hits in enumerate(found) for s, c in sorted(hits, key=lambda h: (-h[0], h[1]))[:k]]


def search(vectors: DataFrame, k: int = 5, block: int = BLOCK, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best candidates of each query, all if there are fewer.

    Queries are the ids that ``is_query`` names, candidates all rows of another id, of as many components as the query.
    If rows repeat an id, the query is the least of their vectors, and each row is a candidate of its own. Equal
    scores rank by vec_id. Scores beyond 64 bits give the nearest 64-bit number. A table without usable vectors
    gives no rows; other columns are not read.
    """
    whole = integer_vectors(vectors).withColumn("width", F.size("v"))
    queries = whole.where(is_query(F.col("vec_id"))).groupBy("vec_id", "width").agg(F.min("v").alias("v"))
    queries = queries.groupBy("vec_id").agg(F.min(F.struct("v", "width")).alias("q")).select("vec_id", "q.v", "q.width")
    total = whole.agg(F.count("*"), F.count_distinct(F.when(is_query(F.col("vec_id")), F.col("vec_id")))).first()
    shards, blocks = max(1, -(-total[0] // shard)), max(1, -(-total[1] // block))
    dealt = whole.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    left = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = dealt.select(F.col("vec_id").alias("other_id"), F.col("v").alias("other"), F.col("width").alias("other_width"), F.col("shard").alias("own_shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("own_block"))

    def group(key: tuple, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for width in set(q["width"]) & set(v["other_width"]) - {0}:
            qs, vs = q[q["width"] == width], v[v["other_width"] == width]
            rows += block_hits(qs["vec_id"].to_numpy(), np.stack(qs["v"].to_list()), vs["other_id"].to_numpy(), np.stack(vs["other"].to_list()), k)
        out = pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")
        return out.assign(list=np.int32(key[1]))

    hits = left.groupBy("block", "shard").cogroup(right.groupBy("own_block", "own_shard")).applyInPandas(group, HITS + ", list int")
    lists = shards
    while lists > 1:                              # a tree: the lists of ``fan`` neighbours become one
        lists = -(-lists // fan)
        hits = _top(hits.withColumn("list", (F.col("list") / fan).cast("int")), k)
    return _top(hits, k).select("query_id", "rank", "vec_id", "score")


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query's lists of the same number, from at most ``FAN`` short lists each."""
    listed = hits.groupBy("query_id", "list").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("down"), "vec_id", "score"))), 1, k).alias("hits"))
    return listed.select("query_id", "list", F.posexplode("hits").alias("at", "hit")).select("query_id", "list", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
