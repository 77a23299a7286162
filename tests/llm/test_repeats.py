"""Rows that repeat, in numbers: operators 2, 5 and 6 neither lose them nor let them meet in one task."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import common, mixing, sharding, topk


def brute(rows, k=10, scale=1024):
    """rows: (vec_id, list); exact integers throughout."""
    whole = [(i, [int(x) * scale if abs(x) > 2**53 else math.floor(scale * x) for x in v]) for i, v in rows]
    out = []
    for a, (q, x) in enumerate(whole):
        if q % 100 == 0:
            scores = sorted((-min(2**63 - 1, max(-(2**63), sum(s * t for s, t in zip(x, y)))), c) for b, (c, y) in enumerate(whole) if a != b)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"candidates": 6, "block": 2}])
def test_vectors_of_one_id_and_of_any_size(spark, sizes):
    rng = random.Random(5)
    rows = [(0, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [5.0, 0.0]), (0, [1.0, 0.0]), (100, [1e300, 1.0]), (8, [-1e300, 2.0]), (9, [1e308, -1e308]), (200, [1e12, 3.5])]
    rows += [(i, [rng.uniform(-1e9, 1e9), rng.uniform(-3, 3)]) for i in range(10, 40)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, 10, **sizes)
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("doc_id", ["null", "equal", "own"])
@pytest.mark.parametrize("same_text", [True, False])
def test_a_source_of_odd_ids_meets_its_target(spark, doc_id, same_text):
    rows = [({"null": None, "equal": 5, "own": i}[doc_id], "one two three four five" + ("" if same_text else f" t{i}"), "a", i % 3) for i in range(1000)]
    rows += [(10_000 + i, "other words here " * 9, "b", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, nth int").repartition(5)
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    by = defaultdict(lambda: [0, 0.0, 0.0])
    for r in plan:
        assert r.copies in (0, 1, 2)
        x = by[r.source]
        x[0], x[1], x[2] = x[0] + r.copies * r.size, r.target, x[2] + r.size**2 / 4
    for taken, target, spread in by.values():
        assert abs(taken - target) <= 4 * math.sqrt(spread)
    mixed = Counter(r.source for r in mixing.mix(docs).collect())
    assert mixed == Counter({s: sum(r.copies for r in plan if r.source == s) for s in by})
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))


def test_many_sources(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), f"http://{i}/é" if i else None) for i in range(500)], "doc_id long, text string, source string")
    rows = {r.source: r for r in mixing.plan(docs).collect()}
    sizes = {s: r.size for s, r in rows.items()}
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level = {round(r.target / weight[s], 6) for s, r in rows.items() if r.target < 2 * sizes[s] - 1e-9}
    assert len(level) <= 1 and math.isclose(sum(r.target for r in rows.values()), 1.5 * sum(sizes.values()))


def test_shards_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK", 100)
    rows = [(None, "same text")] * 1500 + [(4, "x")] * 700 + [(4, f"y{i}") for i in range(300)] + [(i, None) for i in range(10, 50)]
    made = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4, block_rows=20)
    got = made.collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len((t or "").encode()) + 1) for d, t in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 4}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
