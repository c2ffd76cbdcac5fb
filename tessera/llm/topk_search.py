"""Exact top-k search by block-at-a-time pruning.

Candidates, in ranges of their ids, form blocks. A block keeps its forward index, a matrix of quantised components,
and the largest and smallest value of each component. For a query the block's bound is the sum over components of the
larger of the two products. A first pass scores a few seed blocks and gives each query a score that k rows reach. The
second sends a query only to groups of blocks whose bound reaches that score; there it visits blocks by falling
bound and scores them whole, until the next bound is under its kth score. The index is a table in the shared folder;
runs of queries and groups of blocks meet in cells of bounded size, so neither side is ever held whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import partitions, table, written

K, SCALE = 20, 64
BLOCK_ROWS, CELL_BLOCKS, CELL_QUERIES, SEED_BLOCKS = 1024, 64, 4096, 8
#: Up to so many (counted) groups of blocks have their bounds shipped to the queries, 16 bytes a component; beyond, blocks are pruned in their cells alone.
SHIPPED_GROUPS = 20_000
LONG = (-(2**63), 2**63 - 1)
BLOCK_SCHEMA = "block long, ids binary, dims int, kind string, matrix binary, high array<long>, low array<long>"
QUERY_SCHEMA = "query_id long, dims int, kind string, q binary, floor long"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null for a vector that is null or holds a null or non-finite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row a block of the (vec_id, v) rows, in ranges of vec_id; vectors of unequal length are filled with zeros."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                part = batch.iloc[at : at + block_rows]
                matrix = _stacked(part["v"])
                yield pd.DataFrame({
                    "block": [int(part["vec_id"].iloc[0])], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "dims": [matrix.shape[1]], "kind": [matrix.dtype.str],
                    "matrix": [matrix.tobytes()], "high": [matrix.max(axis=0).astype(np.int64)], "low": [matrix.min(axis=0).astype(np.int64)],
                })

    ranged = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id", "v")
    return written(ranged.mapInPandas(blocks, BLOCK_SCHEMA), "topk-index")


def _stacked(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows, filled with zeros, in the smallest integer type that holds them."""
    out = np.zeros((len(vectors), max(map(len, vectors))), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    most = max(int(out.max()), -int(out.min()) - 1) if out.size else 0
    return out.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _unpacked(data: bytes, kind: str, dims: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(rows, dims).astype(np.int64)


def _read_blocks(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    return [
        (np.frombuffer(b.ids, dtype=np.int64), _unpacked(b.matrix, b.kind, b.dims, len(b.ids) // 8), np.asarray(b.high, dtype=np.int64), np.asarray(b.low, dtype=np.int64))
        for b in rows.itertuples()
    ]


def _fitting(*sides: np.ndarray):
    """The cheapest number type in which inner products of the sides' rows are exact."""
    most = max(1, sides[0].shape[-1])
    for side in sides:
        most *= max((abs(int(f())) for f in (side.max, side.min)), default=0) if side.size else 0
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _widened(matrix: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1])))


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Query by block: no row of the block scores more."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def search_cell(ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None):
    """(query number, vec_id, score) of each query's k best of at least its floor in blocks of (ids, matrix, high, low); visited, the blocks scored."""
    dims = max([queries.shape[1], *(b[1].shape[1] for b in blocks)])
    queries = _widened(queries, dims)
    matrices = [_widened(b[1], dims) for b in blocks]
    kinds = {_fitting(queries, m) for m in matrices}
    kind = next(k for k in (object, np.float64, np.float32) if k in kinds)
    q = queries.astype(kind)
    high = _widened(np.stack([np.pad(b[2], (0, dims - len(b[2]))) for b in blocks]), dims).astype(kind)
    low = _widened(np.stack([np.pad(b[3], (0, dims - len(b[3]))) for b in blocks]), dims).astype(kind)
    bound = _bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    row, vec, score = (np.zeros(0, dtype=np.int64) for _ in range(3))
    score = score.astype(object if kind is object else np.int64)
    live, kth, visited = np.arange(len(ids)), np.full(len(ids), -np.inf, dtype=object if kind is object else float), 0
    if floor is not None:
        kth[:] = [-np.inf if x == LONG[0] else int(x) if kind is object else float(x) for x in floor]
    for turn in range(len(blocks)):
        at = order[live, turn]
        go = bound[live, at] >= kth[live]  # an equal bound may still hold an equal score with a smaller id
        live, at = live[go], at[go]
        if not len(live):
            break
        for b in np.unique(at):
            asked = live[at == b]
            visited += len(asked)
            scores = q[asked] @ matrices[b].T.astype(kind)
            scores = scores if kind is object else scores.astype(np.int64)
            own = blocks[b][0][None, :] == ids[asked, None]
            n = scores.shape[1]
            if kind is object or n <= k:
                keep = np.ones(scores.shape, dtype=bool)
            else:
                keep = scores >= np.partition(np.where(own, LONG[0], scores), n - k, axis=1)[:, n - k : n - k + 1]
            keep &= ~own & (scores >= kth[asked, None])
            r, c = np.nonzero(keep)
            row, vec, score = np.concatenate((row, asked[r])), np.concatenate((vec, blocks[b][0][c])), np.concatenate((score, scores[r, c]))
        best = np.lexsort((vec, -score, row))
        row, vec, score = row[best], vec[best], score[best]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kth[row[place == k - 1]] = score[place == k - 1]
        row, vec, score = row[place < k], vec[place < k], score[place < k]
    return row, vec, score, visited


def _asked(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """QUERY_SCHEMA: the queries with ``floor``, the kth best score that the seed blocks give; the smallest long where they give fewer than k."""
    seeds = index.orderBy(F.xxhash64("block", "ids"), "block").limit(SEED_BLOCKS).toPandas()
    shipped = queries.sparkSession.sparkContext.broadcast(seeds)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = _read_blocks(shipped.value)
        for batch in batches:
            for at in range(0, len(batch), CELL_QUERIES):
                part = batch.iloc[at : at + CELL_QUERIES]
                ids, q = part["query_id"].to_numpy(np.int64), _stacked(part["q"])
                floor = np.full(len(ids), LONG[0])
                if blocks:
                    row, _, got, _ = search_cell(ids, q.astype(np.int64), blocks, k)
                    number = np.bincount(row, minlength=len(ids))
                    last = np.cumsum(number)[number >= k] - 1
                    floor[number >= k] = np.clip(got[last], *LONG).astype(np.int64)
                yield pd.DataFrame({"query_id": ids, "dims": q.shape[1], "kind": q.dtype.str, "q": [x.tobytes() for x in q], "floor": floor})

    return written(queries.mapInPandas(score, QUERY_SCHEMA), "topk-queries")


def _sent(asked: DataFrame, index: DataFrame, groups: int, group: Column) -> DataFrame:
    """asked with g: a row for each group of blocks that a query must see."""
    if groups > SHIPPED_GROUPS:
        return asked.select("*", F.explode(F.expr(f"sequence(0L, {groups}L - 1)")).alias("g"))
    ends = index.select(group.alias("g"), F.posexplode(F.arrays_zip("high", "low"))).groupBy("g", "pos").agg(F.max("col.high").alias("high"), F.min("col.low").alias("low"))
    widths = index.groupBy(group.alias("g")).agg(F.min("dims").alias("least"))
    ends = ends.join(widths, "g").groupBy("g", "least").agg(F.sort_array(F.collect_list(F.struct("pos", "high", "low"))).alias("ends")).toPandas()
    shipped = asked.sparkSession.sparkContext.broadcast(ends)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        dims = max([0, *(len(e) for e in own["ends"])])
        high, low = np.zeros((len(own), dims)), np.zeros((len(own), dims))
        for n, (least, e) in enumerate(zip(own["least"], own["ends"], strict=True)):
            # components that a narrower block lacks are zeros there
            high[n, : len(e)] = [x["high"] if i < least else max(0, x["high"]) for i, x in enumerate(e)]
            low[n, : len(e)] = [x["low"] if i < least else min(0, x["low"]) for i, x in enumerate(e)]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                q = np.zeros((len(part), max(dims, int(part["dims"].max()))))
                for n, r in enumerate(part.itertuples()):
                    q[n, : r.dims] = np.frombuffer(r.q, dtype=r.kind)
                # rounding of large numbers never cuts: bounds are taken a little wider
                bound = _bounds(q, _widened(high, q.shape[1]), _widened(low, q.shape[1]))
                slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(_widened(high, q.shape[1])), np.abs(_widened(low, q.shape[1]))).T) + 1
                n, g = np.nonzero(bound + slack >= part["floor"].to_numpy(np.float64)[:, None])
                yield part.iloc[n].assign(g=own["g"].to_numpy(np.int64)[g])

    return asked.mapInPandas(send, f"{QUERY_SCHEMA}, g long")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of largest integer inner product, ties to smaller vec_id.

    Both tables have (vec_id, v array<long>). Rows without id or vector take no part; repeated equal rows are one; of
    queries that share an id the smallest vector counts; a candidate with the query's id is the query's own row. Missing
    components are zeros. Scores beyond a long stop at its ends. Fewer candidates than k give them all; an empty
    table gives no rows.
    """
    rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v").distinct()
    index = build_index(rows, block_rows)
    wanted = queries.filter("vec_id IS NOT NULL AND v IS NOT NULL").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    asked = _asked(wanted, index, k)
    # cells of at most CELL_BLOCKS by CELL_QUERIES, and enough of them for all cores
    n_blocks, n_queries, side = index.count(), asked.count(), 2 * math.isqrt(partitions(rows.sparkSession))
    groups = max(1, -(-n_blocks // CELL_BLOCKS), min(n_blocks, side))
    chunks = max(1, -(-n_queries // CELL_QUERIES), min(-(-n_queries // 64), side))
    group = F.pmod(F.xxhash64("block", "ids"), F.lit(groups))
    left = index.select("*", group.alias("g"), F.explode(F.expr(f"sequence(0L, {chunks}L - 1)")).alias("c"))
    right = _sent(asked, index, groups, group).withColumn("c", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))

    def cell(some: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        if some.empty or own.empty:
            return out
        ids = own["query_id"].to_numpy(np.int64)
        q = np.zeros((len(own), int(own["dims"].max())), dtype=np.int64)
        for n, r in enumerate(own.itertuples()):
            q[n, : r.dims] = np.frombuffer(r.q, dtype=r.kind)
        row, vec, score, _ = search_cell(ids, q, _read_blocks(some), k, own["floor"].to_numpy(np.int64))
        return pd.DataFrame({"query_id": ids[row], "vec_id": vec, "score": np.clip(score, *LONG).astype(np.int64)})

    best = left.groupBy("c", "g").cogroup(right.groupBy("c", "g")).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the 20 best of every twentieth vector of embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.filter("vec_id % 20 = 0"))


def sql() -> str:
    """The same by scoring every pair."""
    return """
WITH kept AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM kept q JOIN kept d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20"""
