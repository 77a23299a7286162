import random
import re

import pytest

import numpy as np
import pyarrow as pa

from glyphloom.llm import nearsets, simhash
from glyphloom.llm.common import text_buffers

SF = "/root/testdata/sf0.01"


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    """The smallest doc_id of each component of rows (doc_id, text) at Jaccard 0.8 or more."""
    rows = sorted(rows)
    found, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(found):
        for j in range(i):
            y = found[j]
            common = len(x & y)
            if x == y or 9 * common >= 4 * (len(x) + len(y)):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {d for i, (d, _) in enumerate(rows) if root(i) == i}


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_kept(rows)
    got = [r.doc_id for r in nearsets.kept(docs).collect()]
    assert sorted(got) == sorted(want)
    assert {56, 467} - want and len(want) < simhash.kept(docs).count()


def test_tiles_of_a_block_against_brute_force():
    """Texts around one passage: every pair that is similar enough is connected by links of some pair of tiles, and no other."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words[: rng.randint(40, 60)]))
    texts = sorted(set(texts))
    hashes, first = nearsets.sets(*text_buffers(pa.array(texts)))
    found = [brute_set(t) for t in texts]
    assert [b - a for a, b in zip(first, first[1:])] == [len(x) for x in found]
    sliced, keys = nearsets.prints(hashes, first), np.zeros((len(texts), nearsets.BANDS), np.int64)
    tile, links = np.array([i % 3 for i in range(len(texts))]), []
    for i in range(3):
        for k in range(i, 3):
            a, b = nearsets.compared(np.arange(len(texts)), tile, sliced, keys, np.arange(len(texts)), hashes.view(np.int64), first, 0, i, k)
            links += zip(a.tolist(), b.tolist())
    similar = lambda x, y: 9 * len(x & y) >= 4 * (len(x) + len(y))
    assert links and all(similar(found[a], found[b]) for a, b in links)

    def parts(pairs):
        parent = list(range(len(texts)))
        for a, b in pairs:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
        out = []
        for i in range(len(texts)):
            while parent[i] != i:
                i = parent[i]
            out.append(i)
        return out

    assert parts(links) == parts([(i, j) for i in range(len(texts)) for j in range(i) if similar(found[i], found[j])])
    bits = np.bitwise_count(sliced[:, None] ^ sliced[None, :]).sum(axis=2)
    assert max(int(bits[i, j]) for i in range(len(texts)) for j in range(i) if similar(found[i], found[j])) <= nearsets.RADIUS - 10


def test_changed_words_and_the_stage(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    rows = []
    for g in range(60):  # eight copies, each with a changed word or two of its own
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 250))]
        for c in range(8):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((g * 8 + c, " ".join(copy)))
    rows += [(1000, "a b"), (1001, "A  b"), (1002, ""), (1003, None), (1004, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in dict(pipeline.STAGES)["SimHash near-dedup"](spark, docs, SF).collect()]
    assert sorted(got) == sorted(brute_kept(rows))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "A b C d", 1), (4, "a b c d", 2), (4, "a b c d", 2), (None, "zz", 3), (2, " ", 4), (1, None, 5)], "doc_id long, text string, n int")
    got = nearsets.kept(docs)
    assert got.columns == docs.columns and sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "4", "None"]
    assert nearsets.kept(docs.limit(0)).count() == 0
