"""Connected components of links between 64-bit nodes, by contraction: no node's links meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


#: Rounds whose choices are folded into one table.
FOLD = 6


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: of links (a, b), each linked node with one node of its component.

    In each round every node takes the neighbour, or itself, that comes first in an order that a hash deals anew. These choices have no
    circle, and links between what was chosen go on to the next round, so the number of nodes falls by a constant factor a round
    whatever the shape: a chain, a star or a clique. Minima are combined before the shuffle; joins are plain equi-joins.
    """
    now = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps: list[DataFrame] = []
    done = 0
    while not now.isEmpty():
        if done == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        turn, done = F.lit(done), done + 1
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("n"))).alias("least"))
        own = F.struct(F.xxhash64("node", turn).alias("h"), F.col("node").alias("n"))
        to = written(first.select("node", F.least(F.col("least"), own).getField("n").alias("root")), "choice")
        left, right = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = now.join(left, "a").join(right, "b").where("ra <> rb")
        later = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        dropped(now)
        maps.append(to)
        now = later
        if len(maps) == FOLD and not now.isEmpty():  # so that no plan joins more than a few of them
            folded = written(_folded(maps), "choices")
            for old in maps:
                dropped(old)
            maps = [folded]
    dropped(now)
    if not maps:
        return links.sparkSession.createDataFrame([], "node long, root long")
    made = written(_folded(maps), "roots")
    for to in maps:
        dropped(to)
    return made


def _folded(maps: list[DataFrame]) -> DataFrame:
    """node, root: where each node of the first map is after the last one."""
    found = maps[-1]
    for to in reversed(maps[:-1]):
        onward = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = to.join(onward, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return found
