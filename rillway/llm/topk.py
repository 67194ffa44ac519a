"""Exact top-k inner products by MaxScore over shards of integer vectors.

A term is a component. In a shard, term i gives document d the contribution q[i] * d[i], which lies between bounds
that the shard's smallest and largest component give. Contributions count from their lower bound on, so none is
negative. With a query's threshold, the score of its k-th best so far, terms are split: the non-essential ones are
the largest set, from the smallest bound up, that cannot lift a document to the threshold by themselves. Essential
terms are traversed for all documents of a block; a document whose sum, with the non-essential bounds, still reaches
the threshold is probed term by term and dropped as soon as it cannot. One shard is searched first: what a query's k-th
best is there is its first threshold everywhere else. Shards' lists are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillway.llm.staging import stage

#: Vectors of a shard, queries of a block, components of either, and vectors that a shard looks at between two thresholds.
SHARD = 16384
QUERIES = 4096
CELLS = 1 << 22
BLOCK = 1024
#: Non-essential terms that are probed for a whole block between two tests, as long as more than one in SPARSE documents competes.
PROBE, SPARSE = 12, 64
K = 20

_FOUND = "query_row long, query_id long, vec_id long, score long"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def search_shard(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (row number, vector ids, scores): its k best of the shard's vectors, by score and then smaller id.

    Vectors of the query's own id take no part; with floor, a score for each query (NaN for none), nor need those below
    it. Sums are exact: they are floats as long as these hold every integer that can come up, and Python integers
    beyond. A score beyond 64 bits counts as the nearest that has 64.
    """
    by_id = np.argsort(ids, kind="stable")  # so of equal scores a later one never wins
    vectors, ids = vectors[by_id], ids[by_id]
    floor = np.full(len(queries), np.nan) if floor is None else floor
    m, n = len(queries), len(vectors)
    width = queries.shape[1]
    largest = 4.0 * max(float(np.abs(queries).max(initial=0)), 1.0) * max(float(np.abs(vectors).max(initial=0)), 1.0) * max(width, 1)
    kind = np.float32 if largest < 2.0**24 else np.float64 if largest < 2.0**53 else object
    if kind is object:
        q, v = (np.array([[int(x) for x in row] for row in a], dtype=object).reshape(a.shape) for a in (queries, vectors))
    else:
        q, v = queries.astype(kind), vectors.astype(kind)
    top_ids: list[np.ndarray] = [np.zeros(0, np.int64)] * m
    top_scores: list[np.ndarray] = [np.zeros(0, kind)] * m
    if not n or not m:
        return [(i, top_ids[i], top_scores[i]) for i in range(m)]
    low_v, high_v = v.min(axis=0), v.max(axis=0)
    low = np.minimum(q * low_v, q * high_v)  # bounds of each query's contributions
    span = np.maximum(q * low_v, q * high_v) - low
    order = np.argsort(span.astype(np.float64), axis=1, kind="stable")  # terms by rising bound
    place = np.argsort(order, axis=1, kind="stable")
    nothing = np.zeros((m, 1), kind)
    rising = np.concatenate([nothing, np.cumsum(np.take_along_axis(span, order, axis=1), axis=1)], axis=1)
    # the most that the first j terms, from the smallest bound up, can give
    most = rising + np.concatenate([nothing, np.cumsum(np.take_along_axis(low, order, axis=1), axis=1)], axis=1)
    lowest = low.sum(axis=1)
    every = np.arange(m)
    for a in range(0, n, BLOCK):
        block, block_ids = v[a : a + BLOCK], ids[a : a + BLOCK]
        # the least score that still counts: beyond the k-th best so far, or the floor
        least = [max(int(top_scores[i][-1]) + 1 if len(top_ids[i]) >= k and top_scores[i][-1] > _LEAST else _LEAST, _LEAST if np.isnan(floor[i]) else int(floor[i])) for i in range(m)]
        full = np.fromiter((x > _LEAST for x in least), bool, m)
        limit = np.array([x if good else most[i, width] for i, (x, good) in enumerate(zip(least, full))], kind)
        # the non-essential terms: the longest run whose bounds together stay below the threshold
        loose = np.where(full, ((rising < (limit - lowest)[:, None]).sum(axis=1) - 1).clip(0), 0)
        sums = (q * (place >= loose[:, None])) @ block.T
        while True:
            rest = most[every, loose]
            good = (sums + rest[:, None] >= limit[:, None]) | ~full[:, None]
            if not loose.any() or np.count_nonzero(good) * SPARSE < good.size:
                break
            # so many compete that the next terms are probed for all of the block
            following = (loose - PROBE).clip(0)
            sums = sums + (q * ((place >= following[:, None]) & (place < loose[:, None]))) @ block.T
            loose = following
        rows, columns = np.nonzero(good)
        sums, left = sums[rows, columns], loose[rows]
        while len(at := np.flatnonzero(left)):  # term by term for those that still compete
            r = rows[at]
            term = order[r, left[at] - 1]
            sums[at] += q[r, term] * block[columns[at], term]
            left[at] -= 1
            good = (sums + most[rows, left] >= limit[rows]) | ~full[rows]
            rows, columns, sums, left = rows[good], columns[good], sums[good], left[good]
        other = block_ids[columns] != query_ids[rows]
        rows, columns, sums = rows[other], columns[other], sums[other]
        cuts = np.searchsorted(rows, np.arange(m + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            some = slice(cuts[i], cuts[i + 1])
            found, scores = np.concatenate([top_ids[i], block_ids[columns[some]]]), np.concatenate([top_scores[i], sums[some] if kind is not object else np.array([min(max(x, _LEAST), _MOST) for x in sums[some]], object)])
            best = np.lexsort((found, -scores))[:k] if kind is not object else np.array(sorted(range(len(found)), key=lambda x: (-scores[x], found[x]))[:k])
            top_ids[i], top_scores[i] = found[best], scores[best]
    return [(i, top_ids[i], top_scores[i]) for i in range(m)]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The first width components of each vector, 0 where it ends before."""
    column = column.combine_chunks()
    flat = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    out = np.zeros((len(column), width), np.int64)
    at = offsets[:-1, None] + np.arange(width)[None, :]
    inside = at < offsets[1:, None]
    out[inside] = flat[at[inside]]
    return out


def _widest(column: pa.ChunkedArray) -> int:
    return int(np.diff(column.combine_chunks().offsets.to_numpy()).max(initial=0))


def _tiles(table: DataFrame, row: str, most: int, name: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Adds name, the tile of each row, and tells the ranges of tiles, that of the most rows first. A tile has vectors of about one length, about most of them or of CELLS components."""
    kind = F.ceil(F.log2(F.greatest(F.size("terms"), F.lit(1)))).cast("int")
    counts = {r[0]: r[1] for r in table.groupBy(kind).count().collect()}  # by power of two: 32 at most
    tiles = {k: max(1, -(-n // max(1, min(most, CELLS >> k)))) for k, n in counts.items()}
    number = F.coalesce(*[F.when(kind == k, F.lit(k << 32) + F.pmod(F.xxhash64(row), F.lit(n))) for k, n in tiles.items()], F.lit(0).cast("long"))
    return table.withColumn(name, number.cast("long")), [(k << 32, (k << 32) + tiles[k] - 1) for k in sorted(tiles, key=lambda k: -counts[k])]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_row, query_id, rank, vec_id, score: each query's k highest inner products with the vectors of other ids.

    vectors: vec_id, terms (array<long>). queries: query_row (its own for each row), query_id, terms. A shorter
    vector counts as 0 where it ends. Vectors that repeat are found as often as they are there; ties go to the
    smaller vec_id. A score beyond 64 bits counts as the nearest that has 64. Vectors are dealt evenly into shards and
    queries into blocks; a task has one of each, and no task has all of either. Without vectors or queries there are no
    rows.
    """
    vectors = stage(vectors.select("vec_id", "terms").withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = stage(queries.select("query_row", "query_id", "terms"), "queries")
    v, shards = _tiles(vectors, "row", SHARD, "shard")
    q, blocks = _tiles(queries, "query_row", QUERIES, "block")

    def search(key, asked: pa.Table, shard: pa.Table) -> pa.Table:
        ids = shard.column("vec_id").to_numpy()
        rows, own = asked.column("query_row").to_numpy(), asked.column("query_id").to_numpy()
        floor = asked.column("floor").to_numpy(zero_copy_only=False).astype(float)
        width = max(1, min(_widest(asked.column("terms")), _widest(shard.column("terms"))))  # beyond it one side is 0
        found = search_shard(_matrix(asked.column("terms"), width), own, _matrix(shard.column("terms"), width), ids, k, floor)
        out = [(rows[i], own[i], d, int(s)) for i, some, scores in found for d, s in zip(some.tolist(), scores.tolist())]
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    search.__annotations__ = {}

    if not shards or not blocks:
        return vectors.sparkSession.createDataFrame([], "query_row long, query_id long, rank int, vec_id long, score long")
    every = lambda tiles: F.flatten(F.array(*[F.sequence(F.lit(a), F.lit(b)) for a, b in tiles]))
    first = shards[0][0]

    def searched(asked: DataFrame, some: Column, of: Column) -> DataFrame:
        each_shard = asked.select(F.explode(some).alias("shard"), "block", "query_row", "query_id", "terms", "floor")
        each_block = v.where(of).select("shard", F.explode(every(blocks)).alias("block"), "vec_id", "terms")
        return each_shard.groupBy("shard", "block").cogroup(each_block.groupBy("shard", "block")).applyInArrow(search, _FOUND)

    found = searched(q.withColumn("floor", F.lit(None).cast("double")), F.array(F.lit(first)), F.col("shard") == first)
    if len(shards) > 1 or shards[0][1] > first:
        found = stage(found, "first")
        # as a double not above the score itself
        score = F.col("score").cast("double")
        below = F.when(F.abs(score) < 2.0**53, score).otherwise(score - F.abs(score) * 2.0**-50)
        floors = found.groupBy("query_row").agg(F.min(below).alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
        rest = F.filter(every(shards), lambda x: x != first)
        found = found.union(searched(q.join(floors, "query_row", "left"), rest, F.col("shard") != first))
    best = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, terms: floor(scale * x) of each component as double; vectors that are null or hold null, NaN or infinity, or have no id, take no part.

    A value beyond 64 bits counts as the nearest that has 64.
    """
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("terms"))


def op7_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20, against every row but their own; nulls, ties, repeats, large values and empty tables as in top_k and integer_vectors."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = vectors.where("vec_id % 20 = 0").select(F.monotonically_increasing_id().alias("query_row"), F.col("vec_id").alias("query_id"), "terms")
    return top_k(vectors, queries).select("query_id", "rank", "vec_id", "score")


OP7_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(CAST(q.terms AS DOUBLE[]), CAST(v.terms AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
