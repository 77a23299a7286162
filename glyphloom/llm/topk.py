"""Operator 5: exact top-k inner products by the threshold algorithm (Fagin, Lotem and Naor, 2003).

Candidates are dealt out in blocks and queries in blocks, and each pair of blocks is one task's cell. In a cell every dimension has a
list of the candidates sorted by that component. A query reads all its lists in step, from the end that its component's sign favours,
and scores what it meets; no unseen candidate can score more than the sum of its components times the values reached, so it stops once
that bound is below its k-th score. Every query meets one block of candidates first, and its k-th score there is its floor in all other
cells: how deep the bound falls below the floor is known before a list is read. Where that is so deep that the lists name half of the
block or more, the block is scored as one matrix product instead. The best k of each cell meet by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_for, written

#: Candidates and queries of a cell, and the first depths at which the bound is looked at.
CANDIDATES, QUERIES, FIRST_DEPTH, DEEPER = 16_384, 8192, 8, 4
#: Scores that a cell holds at once.
SCORES_AT_ONCE = 1 << 21
#: The limits of a score: one beyond them counts as the limit.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def fit_for_scores(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(F.transform(vector, lambda x: x.cast("double")), lambda x: F.coalesce(finite(x), F.lit(False)))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: as doubles, which hold whole numbers exactly, or as Python's integers where a product is beyond doubles."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if np.isfinite(y).all():
        return y
    return np.array([int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(x.ravel().tolist(), y.ravel().tolist(), strict=True)], object).reshape(x.shape)


def matrix(column: pa.ChunkedArray, width: int, scale: int) -> np.ndarray:
    """The whole numbers of each row; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    per = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(per), width))
    row = np.repeat(np.arange(len(per)), per)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(per) - per, per)] = flat
    return whole(out, scale)


def alike(queries: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which no product can be wrong: double, 64-bit integer or Python's integers."""
    top = lambda x: int(np.abs(x).max(initial=0))
    largest = top(block) * top(queries) * max(1, block.shape[1])
    if largest < 1 << 53:
        return queries.astype(np.float64), block.astype(np.float64)
    if largest < 1 << 63:
        return queries.astype(np.int64), block.astype(np.int64)
    exact = lambda x: x if x.dtype == object else np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)
    return exact(queries), exact(block)


def _limited(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, LEAST, MOST).astype(np.int64) if scores.dtype == object else scores.astype(np.int64)


def threshold_top(
    queries: np.ndarray, own: np.ndarray, block: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None, read: list[int] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, block row, score) of each query's k best rows of block by (-score, id), without block row own[i]; rows below the query's floor may be left out.

    read gets the number of candidates that each query was scored against.
    """
    n = len(block)
    queries, block = alike(queries, block)
    order = np.argsort(block, axis=0, kind="stable").astype(np.int32)
    values = np.take_along_axis(block, order, 0)
    depths = [FIRST_DEPTH]
    while depths[-1] * DEEPER < n:
        depths.append(depths[-1] * DEEPER)
    depths = [t for t in depths if t < n]
    up, down = np.where(queries > 0, queries, 0), np.where(queries < 0, queries, 0)
    bounds = _limited(up @ values[[n - 1 - t for t in depths]].T + down @ values[depths].T) if depths else np.zeros((len(queries), 0), np.int64)
    floors = np.full(len(queries), LEAST) if floor is None else floor
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    counted = np.full(len(queries), n)

    def keep(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        if len(rows) > k:
            some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[some], scores[some]
        best = np.lexsort((ids[rows], -scores.astype(object) if len(scores) and scores.min() == LEAST else -scores))[:k]
        best = best[scores[best] >= floors[i]]
        found.append((np.full(len(best), i), rows[best], scores[best]))

    rest = []
    for i, q in enumerate(queries):
        rising, falling = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        used = len(rising) + len(falling)
        deep = np.flatnonzero(bounds[i] < floors[i])
        levels = range(len(depths)) if floors[i] == LEAST else deep[:1].tolist()
        for j in levels:
            if not used or 2 * depths[j] * used >= n:
                rest.append(i)
                break
            rows = np.unique(np.concatenate([order[n - depths[j] :, rising].ravel(), order[: depths[j], falling].ravel()]))
            rows = rows[rows != own[i]]
            scores = _limited(block[rows] @ q)
            if len(rows) >= k and bounds[i, j] < max(int(floors[i]), int(np.partition(scores, len(scores) - k)[len(scores) - k])) or bounds[i, j] < floors[i]:
                counted[i] = len(rows)
                keep(i, rows, scores)
                break
        else:
            rest.append(i)
    every = np.arange(n)
    at_once = max(1, SCORES_AT_ONCE // max(1, n))
    for a in range(0, len(rest), at_once):
        some = rest[a : a + at_once]
        for i, scores in zip(some, _limited(queries[some] @ block.T), strict=True):
            others = every if own[i] < 0 else np.delete(every, own[i])
            keep(i, others, scores[others])
    if read is not None:
        read.extend(counted.tolist())
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, candidates: int = CANDIDATES, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: of vectors (vec_id, embedding), each row's k best others where `queries` holds of its vec_id.

    Vectors that are null or hold a null or non-finite component take no part, nor does a null vec_id. Rows that repeat a vec_id are rows like
    all others: each is a candidate of every other row, and a query with ranks of its own where its id is asked for. Shorter vectors are
    filled with zeros. Components may have any finite size; a score beyond 64 bits counts as the nearest 64-bit number. Ties go to the
    smaller vec_id; a query with fewer others gets all. No rows give no rows; other columns are ignored.
    """
    taken = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & fit_for_scores(F.col("v")))
    # The row's number names it: it is written once, so all later readers see the same.
    rows = written(taken.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", lambda x: x.cast("double")).alias("v")), "vectors")
    asked = rows.where(queries)
    n, m, width = *rows.agg(F.count("*"), F.count_if(queries)).first(), rows.agg(F.max(F.size("v"))).first()[0] or 1
    across, down = pieces_for(n, candidates), pieces_for(m, block)
    part = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    schema = "query long, query_id long, vec_id long, score long"
    empty = pa.schema([(x.split()[0], pa.int64()) for x in schema.split(", ")]).empty_table()

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return empty
        number, ids = q.column("row").to_numpy(), c.column("vec_id").to_numpy()
        keys = c.column("row").to_numpy()
        by_key = np.argsort(keys)
        near = by_key[np.minimum(np.searchsorted(keys[by_key], number), len(keys) - 1)]
        own = np.where(keys[near] == number, near, -1)
        at, found, scores = threshold_top(matrix(q.column("v"), width, scale), own, matrix(c.column("v"), width, scale), ids, k, q.column("floor").to_numpy())
        return pa.table({"query": number[at], "query_id": q.column("vec_id").to_numpy()[at], "vec_id": ids[found], "score": scores})

    def cells(some: DataFrame, first: int, last: int) -> DataFrame:
        each = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
        left = some.select("row", "vec_id", "v", "floor", part(down).alias("down"), each(first, last).alias("across"))
        right = rows.select("row", "vec_id", "v", part(across).alias("across")).where(F.col("across").between(first, last)).withColumn("down", each(0, down - 1))
        return left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(run, schema)

    best = cells(asked.withColumn("floor", F.lit(LEAST)), 0, 0)
    if across > 1:
        best = written(best, "first")
        floors = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select(F.col("query").alias("row"), "floor")
        known = written(asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST))), "floors")
        best = best.unionByName(cells(known, 1, across - 1))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
