"""Operator 11: hard negatives by vantage-point trees over norm-augmented vectors.

One more component makes all vectors of a block equally long, so that they lie on a sphere and a larger inner product with an anchor is a
smaller angle from it: with anchor q, vector x and length m the score is |q| m cos(angle). A window of scores is an annulus of angles round the
anchor. The block's vectors are in a vantage-point tree (Yianilos, 1993), whose nodes keep the angles of their rows from the vantage point;
by the triangle inequality these bound a leaf's angles from any anchor. An anchor visits leaves nearest first, passes over those that lie
within the hole or beyond the rim of all its annuli, and stops when the next leaf is beyond the k-th row found of each. Scores are computed in
whole numbers; angles only decide what is visited, with a margin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_for, written
from .topk import LEAST, MOST, _limited, alike, fit_for_scores, matrix

#: Candidates and anchors of a cell at most, candidates of a block at least where there are tasks for more blocks, rows of a leaf.
CANDIDATES, ANCHORS, FEWEST, LEAF = 32_768, 8192, 2048, 256
#: What an angle may be wrong by, generously: 2e-8 is the square root of a double's precision.
MARGIN = 1e-6
#: Scores times windows that a visit holds at once.
AT_ONCE = 1 << 21


@dataclass
class Tree:
    """order[start[i]:end[i]] are the rows of leaf i; on its way from the root it has been through the annuli inner..outer round the rows `vantage`."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ways: list[list[tuple[int, float, float]]]
    vantage: np.ndarray
    points: np.ndarray
    length: float

    @property
    def leaves(self) -> int:
        return len(self.start)


def unit(block: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows of length one, the length they had): block with a component that makes all rows as long as the longest."""
    square = np.einsum("ij,ij->i", block, block)
    longest = float(square.max(initial=0.0))
    if not longest:
        return np.concatenate([block, np.ones((len(block), 1))], 1), 0.0
    return np.concatenate([block, np.sqrt(np.maximum(longest - square, 0.0))[:, None]], 1) / np.sqrt(longest), float(np.sqrt(longest))


def angles(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ others.T, -1.0, 1.0))


def build(block: np.ndarray, leaf: int = LEAF, tried: int = 8) -> Tree:
    """The tree of a block of doubles. Of a few rows of a node, that whose angles from some others spread most is its vantage point; half of the node is nearer to it. A leaf has one too, the row nearest to its middle. Equal rows are parted as evenly as others."""
    points, length = unit(block)
    rng = np.random.default_rng(len(block))
    order = np.arange(len(block))
    leaves: list[tuple[int, int, list[tuple[int, float, float]]]] = []
    vantage: list[int] = []
    todo: list[tuple[int, int, list[tuple[int, float, float]]]] = [(0, len(block), [])]
    while todo:
        a, b, way = todo.pop()
        if b - a <= leaf:
            inside = points[order[a:b]]
            if len(inside):
                at = int(np.argmax(inside @ inside.sum(0)))
                far = angles(inside, inside[at : at + 1])
                way = [*way, (len(vantage), float(far.min()), float(far.max()))]
                vantage.append(int(order[a + at]))
            leaves.append((a, b, way))
            continue
        rows = order[a:b]
        some, seen = rng.choice(rows, min(tried, b - a), replace=False), rng.choice(rows, min(64, b - a), replace=False)
        best = some[int(np.argmax(angles(points[some], points[seen]).var(1)))]
        far = angles(points[rows], points[best : best + 1])[:, 0]
        nearest = np.argsort(far, kind="stable")
        order[a:b] = rows[nearest]
        far = far[nearest]
        middle = (b - a) // 2
        at = len(vantage)
        vantage.append(int(best))
        todo.append((a + middle, b, [*way, (at, float(far[middle]), float(far[-1]))]))
        todo.append((a, a + middle, [*way, (at, float(far[0]), float(far[middle - 1]))]))
    ends = np.array([(x[0], x[1]) for x in leaves], np.int64).reshape(-1, 2)
    return Tree(order, ends[:, 0], ends[:, 1], [x[2] for x in leaves], np.array(vantage, np.int64), points, length)


def reaches(tree: Tree, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) angle that rows of each leaf may have from each anchor, a row an anchor."""
    size = np.sqrt(np.einsum("ij,ij->i", anchors, anchors))
    ahead = np.concatenate([anchors / np.where(size > 0, size, 1.0)[:, None], np.zeros((len(anchors), 1))], 1)
    away = angles(ahead, tree.points[tree.vantage]) if len(tree.vantage) else np.zeros((len(anchors), 0))
    least, most = np.zeros((len(anchors), tree.leaves)), np.full((len(anchors), tree.leaves), np.pi)
    for i, way in enumerate(tree.ways):
        for at, inner, outer in way:
            d = away[:, at]
            np.maximum(least[:, i], np.maximum(d - outer, inner - d), out=least[:, i])
            np.minimum(most[:, i], np.minimum(d + outer, 2 * np.pi - d - inner), out=most[:, i])
    return least - MARGIN, most + MARGIN


def angle_of(score: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The angle at which a score lies, of size = |anchor| x length; without a size all rows score zero, at a right angle."""
    share = np.divide(score, size, out=np.zeros_like(score, dtype=np.float64), where=size > 0)
    return np.where(size > 0, np.arccos(np.clip(share, -1.0, 1.0)), np.where(score > 0, 0.0, np.where(score < 0, np.pi, np.pi / 2)))


def within(
    anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, block: np.ndarray, ids: np.ndarray, groups: np.ndarray,
    same: bool, k: int, leaf: int = LEAF, visited: list[int] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor row, window, block row, score): of each window low[i, w]..high[i, w] of an anchor the k best rows of block by (-score, id) whose group is the anchor's label, or is not if not `same`. Block row own[i] takes no part; a window with low > high is none.

    visited gets the number of rows that each anchor was scored against.
    """
    anchors, block = alike(anchors, block)
    w, exact = low.shape[1], block.dtype == object
    floats = np.zeros((len(block), 1)) if exact else block.astype(np.float64)
    tree = build(floats, len(block) if exact else leaf)
    fine = np.zeros((len(anchors), 1)) if exact else anchors.astype(np.float64)
    least, most = reaches(tree, fine)
    size = np.sqrt(np.einsum("ij,ij->i", fine, fine)) * tree.length
    nearest = np.argsort(least, axis=1, kind="stable")
    floor = low.copy()
    hole = angle_of(high.astype(np.float64), size[:, None]) - MARGIN
    reach = angle_of(floor.astype(np.float64), size[:, None]) + MARGIN
    if exact:
        hole[:], reach[:] = -np.inf, np.inf
    open_ = low <= high
    best = [np.zeros(0, np.int64) for _ in range(3)]  # anchor x w + window, block row, score
    counts = np.zeros(len(anchors), np.int64)
    live = np.flatnonzero(open_.any(1))
    for turn in range(tree.leaves):
        at = nearest[live, turn]
        near = least[live, at][:, None] <= reach[live]
        going = (near & open_[live]).any(1)
        live, at = live[going], at[going]
        if not len(live):
            break
        wanted = open_[live] & near[going] & (most[live, at][:, None] >= hole[live])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        meet = np.flatnonzero(wanted.any(1))
        meet = meet[np.argsort(at[meet], kind="stable")]
        edges = np.flatnonzero(np.diff(at[meet], prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(meet))[: len(edges)], strict=True):
            rows = tree.order[tree.start[at[meet[a]]] : tree.end[at[meet[a]]]]
            step = max(1, AT_ONCE // (w * len(rows)))
            for c in range(a, b, step):
                some = live[meet[c : min(b, c + step)]]
                scores = _limited(anchors[some] @ block[rows].T)
                counts[some] += len(rows)
                fit = ((groups[rows][None, :] == labels[some][:, None]) == same) & (rows[None, :] != own[some][:, None])
                hit = fit[:, None, :] & (scores[:, None, :] >= floor[some][:, :, None]) & (scores[:, None, :] <= high[some][:, :, None])
                i, j, r = np.nonzero(hit)
                found.append(_foremost(some[i] * w + j, rows[r], scores[i, r], ids, k)[:3])
        if found:
            *best, last = _foremost(*(np.concatenate([x, *y]) for x, y in zip(best, zip(*found, strict=True), strict=True)), ids, k)
            key, score = best[0][last], best[2][last]
            floor[key // w, key % w] = score
            if not exact:
                risen = key // w
                reach[risen, key % w] = angle_of(score.astype(np.float64), size[risen]) + MARGIN
    if visited is not None:
        visited.extend(counts.tolist())
    return best[0] // w, best[0] % w, best[1], best[2]


def _foremost(key: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each key by (-score, id), and which of them are k-th. ~score rises as a score falls, whatever its size."""
    order = np.lexsort((ids[row], ~score, key))
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    rank = np.arange(len(key)) - np.repeat(new, np.diff([*new, len(key)]))
    some = rank < k
    return key[some], row[order][some], score[order][some], rank[some] == k - 1


def _cells(rows: DataFrame, asked: DataFrame, n: int, m: int, width: int, same: bool, k: int, scale: int, candidates: int, anchors: int, leaf: int, keep: str) -> DataFrame:
    """row, nth, vec_id, score: of rows (row, vec_id, label, v), each window's k best, for asked (row, label, v, lows, highs), windows in lists of equal length. `keep` names a written table."""
    spark = rows.sparkSession
    tasks = min(pieces_for(n, min(FEWEST, candidates)), spark.sparkContext.defaultParallelism)
    across, down = max(pieces_for(n, candidates), tasks), pieces_for(m, anchors)
    part = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    schema = "row long, nth int, vec_id long, score long"
    empty = pa.table({"row": pa.array([], pa.int64()), "nth": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return empty
        number, keys = q.column("row").to_numpy(), c.column("row").to_numpy()
        by_key = np.argsort(keys)
        near = by_key[np.minimum(np.searchsorted(keys[by_key], number), len(keys) - 1)]
        own = np.where(keys[near] == number, near, -1)
        windows = [q.column(x).combine_chunks().flatten().to_numpy().reshape(len(number), -1) for x in ("lows", "highs")]
        ids = c.column("vec_id").to_numpy()
        i, nth, found, scores = within(
            matrix(q.column("v"), width, scale), own, q.column("label").to_numpy(), *windows, matrix(c.column("v"), width, scale), ids, c.column("label").to_numpy(), same, k, leaf,
        )
        return pa.table({"row": number[i], "nth": nth.astype(np.int32), "vec_id": ids[found], "score": scores})

    def met(some: DataFrame, first: int, last: int) -> DataFrame:
        each = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
        left = some.select("row", "label", "v", "lows", "highs", part(down).alias("down"), each(first, last).alias("across"))
        right = rows.select("row", "vec_id", "label", "v", part(across).alias("across")).where(F.col("across").between(first, last)).withColumn("down", each(0, down - 1))
        return left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(run, schema)

    if across == 1:
        return met(asked, 0, 0)
    # What an anchor finds in the first block is the floor of its windows in all others.
    first = written(met(asked, 0, 0), f"{keep}-first")
    reached = first.groupBy("row", "nth").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = reached.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("nth", "floor"))).alias("floors"))
    raised = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("floors", i), x)))
    known = written(asked.join(floors, "row", "left").select("row", "label", "v", raised.alias("lows"), "highs"), f"{keep}-floors")
    return first.unionByName(met(known, 1, across - 1))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """With `rank` from 1, of each window's k best of all blocks."""
    order = Window.partitionBy("row", "nth").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, k: int = 10, scale: int = 256, low: int = 3, high: int = 9, candidates: int = CANDIDATES, block: int = ANCHORS, leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of vectors (vec_id, embedding, label), for each row where `anchors` holds of its vec_id and each of its best `positives` other rows of the same label, the k best rows of other labels with scores of low to high tenths of the positive's.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Rows that repeat a vec_id are rows like all others:
    each is a candidate of every other row, and an anchor of its own where its id is asked for. Shorter vectors are filled with zeros; vectors of zeros score zero with all.
    Ties go to the smaller vec_id; a pair with fewer negatives gets all, one with none, such as one whose positive scores below zero, has no row.
    A score beyond 64 bits counts as the nearest 64-bit number. No rows give no rows; other columns are ignored. Any label may hold any part of the
    rows: blocks are dealt by hash, not by label, and what an anchor keeps of a block is k rows a window.
    """
    taken = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    taken = taken.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fit_for_scores(F.col("v")))
    # The row's number names it: it is written once, so all later readers see the same.
    rows = written(taken.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("v", lambda x: x.cast("double")).alias("v")), "vectors")
    asked = rows.where(anchors)
    n, m, width = rows.agg(F.count("*"), F.count_if(anchors), F.max(F.size("v"))).first()
    sizes = {"n": n, "m": m, "width": width or 1, "scale": scale, "candidates": candidates, "anchors": block, "leaf": leaf}
    any_score = asked.select("row", "label", "v", F.array(F.lit(LEAST).cast("long")).alias("lows"), F.array(F.lit(MOST).cast("long")).alias("highs"))
    near = _ranked(_cells(rows, any_score, same=True, k=positives, keep="positives", **sizes), positives)
    near = written(near.select("row", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # A window of whole scores: from low tenths of the positive's, rounded up, to high tenths, rounded down. Tens and ones apart, no product is beyond 64 bits.
    tens, ones = F.expr("positive_score div 10"), F.col("positive_score") % 10
    bound = near.where("positive_score >= 0").withColumns({"least": tens * low + F.expr(f"(positive_score % 10 * {low} + 9) div 10"), "most": tens * high + F.floor(ones * high / 10)})
    listed = bound.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("nth", F.struct("least", "most")))).alias("bounds"))
    side = lambda name, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at("bounds", i)[name], F.lit(none).cast("long")))
    windows = asked.join(listed, "row").select("row", "label", "v", side("least", MOST).alias("lows"), side("most", LEAST).alias("highs"))
    windows = written(windows, "windows")
    far = _ranked(_cells(rows, windows, same=False, k=k, keep="negatives", **sizes), k)
    named = asked.select("row", F.col("vec_id").alias("anchor_id"))
    pairs = near.join(named, "row")
    return pairs.join(far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}), ["row", "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
