"""Operator 11 against a loop over all rows."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import negatives
from glyphloom.llm.queries import ORACLES, QUERIES
from glyphloom.llm.topk import LEAST, MOST


def mined(rows, every=100, positives=5, k=10, scale=256):
    """(anchor, positive, rank, negative, positive's score, negative's score) of rows (vec_id, vector, label), all of them fit."""
    rows = [(i, [int(np.floor(scale * float(x))) for x in v], y) for i, v, y in rows]
    dot = lambda a, b: sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0))
    out = []
    for n, (anchor, q, label) in enumerate(rows):
        if anchor % every:
            continue
        others = sorted((-dot(q, v), i, y) for m, (i, v, y) in enumerate(rows) if m != n)
        for s, i, _ in [x for x in others if x[2] == label][:positives]:
            fit = [x for x in others if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:k]
            out += [(anchor, i, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fit)]
    return sorted(out)


def taken(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def grouped(n, seed, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    at = rng.integers(0, 5, n)
    return [(i, (centres[at[i]] + rng.normal(0, 0.6, width)).tolist(), int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"candidates": 50, "block": 3, "leaf": 4}, {"leaf": 1}])
def test_equals_a_loop_over_all_rows(spark, sizes):
    rows = grouped(300, 1)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert taken(negatives.mine(vectors, F.col("vec_id") % 25 == 0, positives=4, k=3, **sizes)) == mined(rows, 25, 4, 3)


def test_odd_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1), (0, [0.9, 0.1], 1), (1, [0.8, 0.1], 1), (1, [0.8, 0.1], 1), (2, [0.5, 0.0], 2), (3, [0.5, 0.0], 0), (3, [0.5, 0.0], 0)]
    rows += [(100, [-1.0, -1.0], 1), (200, [0.0, 0.0], 2), (4, [0.0, 0.0], 2), (5, [0.0, 3.0], 0), (300, [5.0, 5.0], 4)]
    unfit = [(6, None, 1), (7, [1.0, None], 1), (8, [1.0, float("nan")], 2), (9, [float("inf"), 0.0], 2), (10, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (400, None, 1)]
    path = f"{tmp_path}/embeddings"
    spark.createDataFrame(rows + unfit, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    vectors = spark.read.parquet(path)
    narrow = [(i, np.array(v, np.float32).tolist(), y) for i, v, y in rows]
    for sizes in ({}, {"candidates": 3, "block": 1, "leaf": 2}):
        assert taken(negatives.mine(vectors, F.col("vec_id") % 100 == 0, **sizes)) == mined(narrow)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT vec_id, embedding, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 9) % 10 ELSE label END AS INTEGER) AS label FROM read_parquet('{path}/*.parquet')")
    assert sorted(con.execute(ORACLES["op11_vantage_negatives"]).fetchall()) == mined(narrow)
    extra = vectors.withColumn("row", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("v", F.lit(2))
    assert taken(negatives.mine(extra, F.col("vec_id") % 100 == 0)) == mined(narrow)
    assert negatives.mine(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_vectors_of_different_lengths_and_huge_components(spark):
    rows = [(0, [1.0], 0), (1, [2.0, 1.0], 0), (2, [3.0, 1e3, 1.0], 1), (3, [1.0, 1.0], 1), (4, [0.7], 2)]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>, label int")
    assert taken(negatives.mine(frame(rows), F.col("vec_id") == 0)) == mined(rows)
    big = [(i, [x * 1e6 for x in v], y) for i, v, y in grouped(40, 3)]
    assert taken(negatives.mine(frame(big), F.col("vec_id") % 10 == 0, candidates=7, block=2)) == mined(big, 10)
    huge = [(0, [1e200, 1.0], 0), (1, [1e200, 0.0], 0), (2, [-1e200, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1e-210, 0.0], 1)]
    # A score beyond 64 bits counts as the nearest 64-bit number.
    found = taken(negatives.mine(frame(huge), F.col("vec_id") == 0))
    assert found == [] and negatives.mine(frame(huge[:2] + [(5, [0.0, 0.5], 1)]), F.col("vec_id") == 0).count() == 0


def brute(anchors, own, labels, low, high, block, ids, groups, same, k):
    out = set()
    for i, q in enumerate(anchors):
        for w in range(low.shape[1]):
            rows = [(-int(block[r] @ q), ids[r], r) for r in range(len(block)) if r != own[i] and (groups[r] == labels[i]) == same and low[i, w] <= int(block[r] @ q) <= high[i, w]]
            out |= {(i, w, r, -s) for s, _, r in sorted(rows)[:k]}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_the_kernel_in_windows_of_any_kind(seed):
    rng = np.random.default_rng(seed)
    n, width = 200, 3 + seed
    block = rng.integers(-50, 50, (n, width)).astype(float)
    block[: n // 4] = block[0]  # rows that are alike
    if seed == 4:
        block[:] = 0
    ids, groups = rng.permutation(n), rng.integers(0, 3, n)
    own = np.arange(0, n, 10)
    anchors, labels = block[own], groups[own]
    low = np.stack([np.full(len(own), LEAST), rng.integers(-2000, 1000, len(own)), np.full(len(own), MOST)], 1)
    high = np.stack([np.full(len(own), MOST), low[:, 1] + rng.integers(0, 3000, len(own)), np.full(len(own), LEAST)], 1)
    for same in (True, False):
        for leaf in (1, 7, 1000):
            i, w, r, s = negatives.within(anchors, own, labels, low, high, block, ids, groups, same, 4, leaf)
            assert set(zip(i.tolist(), w.tolist(), r.tolist(), s.tolist(), strict=True)) == brute(anchors, own, labels, low, high, block, ids, groups, same, 4)


def test_leaves_hold_all_rows_and_their_angles_are_in_reach():
    rng = np.random.default_rng(9)
    block = rng.normal(size=(500, 5)) * rng.uniform(0, 3, (500, 1))
    tree = negatives.build(block, 16)
    assert sorted(tree.order.tolist()) == list(range(500)) and (tree.end - tree.start).max() <= 16
    anchors = rng.normal(size=(20, 5))
    least, most = negatives.reaches(tree, anchors)
    size = np.linalg.norm(anchors, axis=1)[:, None] * tree.length
    far = np.arccos(np.clip(anchors @ block.T / size, -1, 1))
    for i in range(tree.leaves):
        some = far[:, tree.order[tree.start[i] : tree.end[i]]]
        assert (least[:, i] <= some.min(1)).all() and (some.max(1) <= most[:, i]).all()


def test_annuli_spare_rows_where_vectors_are_in_groups():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 300
    block = np.floor(np.repeat(centres, 50, 0) + rng.normal(0, 20, (2000, 16)))
    groups, own = np.arange(2000) % 2, np.arange(0, 2000, 50)
    scores = (block[own] * block[own]).sum(1).astype(np.int64)
    low, high = (scores * 3 // 10)[:, None], (scores * 12 // 10)[:, None]
    visited = []
    found = negatives.within(block[own], own, groups[own], low, high, block, np.arange(2000), groups, False, 10, 32, visited)
    assert np.mean(visited) < 0.4 * 2000
    assert set(zip(*(x.tolist() for x in found), strict=True)) == brute(block[own], own, groups[own], low, high, block, np.arange(2000), groups, False, 10)


def test_the_query_over_the_tables(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert taken(QUERIES["op11_vantage_negatives"](spark, "/root/testdata/sf0.001")) == mined(rows)
