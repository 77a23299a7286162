import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from glyphloom.llm import simhash
from glyphloom.llm.common import text_buffers
from glyphloom.llm.components import components
from glyphloom.llm.queries import QUERIES


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    spans = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fp)."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, format(f, "016x"), least[root(i)]) for i, (d, f) in enumerate(rows)]


def test_fingerprints_match_the_library():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abÀzß日Z\x85") for _ in range(rng.choice([1, 3, 9, 40, 90, 300]))) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    texts += ["", None, "  ", " ", "a\x0bb\x1cc"]
    got = simhash.fingerprints(*text_buffers(pa.array(texts)))
    assert [int(x) for x in got] == [brute_print(t) for t in texts]


def test_bit_sliced_comparison_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base[rng.integers(0, 400, 500)]
    for _ in range(4):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    every = np.unique(np.concatenate([base, near]))
    for radius in (0, 1, 3, 5):
        got = {(int(a), int(b)) for i, j in simhash.within(every, every, radius) for a, b in zip(i, j)}
        i, j = np.nonzero(np.bitwise_count(every[:, None] ^ every[None, :]) <= radius)
        assert got == set(zip(i.tolist(), j.tolist()))


def test_wide_fingerprints_and_hashes_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (150, 2), dtype=np.uint64)
    near = base.copy()
    for _ in range(20):
        near[np.arange(150), rng.integers(0, 2, 150)] ^= np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)
    for radius in (3, 15, 52):
        got = {(int(a), int(b)) for i, j in simhash.within(base, near, radius) for a, b in zip(i, j)}
        i, j = np.nonzero(np.bitwise_count(base[:, None] ^ near[None, :]).sum(axis=2) <= radius)
        assert got == set(zip(i.tolist(), j.tolist()))
    hashes = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    first = np.array([0, 0, 1, 700, 700, 4000, 5000, 5000])
    want = simhash.majority(hashes, first)
    for size in (1, 37, 4096):
        monkeypatch.setattr(simhash, "HASHES_AT_ONCE", size)
        assert simhash.majority(hashes, first).tolist() == want.tolist()
    assert want[0] == 0 and want[1] == hashes[0] and want[6] == 0


def test_components_of_a_chain_a_star_and_a_clique(spark):
    chain = [(i, i + 1) for i in range(1, 300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    clique = [(i, j) for i in range(2000, 2020) for j in range(2000, i)]
    got = components(spark.createDataFrame([*chain, *star, *clique, (5000, 5000)], "a long, b long")).collect()
    roots = {}
    for r in got:
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, roots.values())) == [20, 200, 300] and all(k in v for k, v in roots.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(5)
    prints = {int(rng.integers(0, 2**62))}
    for _ in range(400):  # one ball of near copies: every block is hot
        prints.add(sorted(prints)[int(rng.integers(0, len(prints)))] ^ (1 << int(rng.integers(0, 64))))
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), block=16, tile=32)
    assert components(links).select("root").distinct().count() == 1


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op8_simhash_neardup"](spark, d).collect()))
    assert got == sorted(brute_components(rows))


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(3, None, 1), (1, "", 1), (2, " \n", 1), (4, "a b c d", 1), (4, "a b c d", 1), (None, "A b C d", 1), (None, "zz", 1), (9, "x " * 50000, 2)],
        "doc_id long, text string, fp int",
    )
    got = simhash.near_duplicates(docs).collect()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert len(got) == 8 and by[(3, "0" * 16)] == by[(2, "0" * 16)] == 1
    assert {r.component_id for r in got if r.doc_id is None} == {4, None}
    kept = simhash.kept(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "4", "9", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.kept(docs.limit(0)).count() == 0
