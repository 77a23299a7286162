import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from glyphloom.llm import packing
from glyphloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_pieces(rows, texts, width, most_padding):
    """rows against the whole texts [(doc_id, text)]; returns the padding."""
    real = Tokenizer.from_file(PATH)
    ids = {d: np.array(real.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in texts}
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        body = ids[r.doc_id]
        assert r.doc_tokens == len(body) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(body[r.start : r.start + r.length].astype("<u4").tobytes())
        of[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    times = Counter(d for d, _ in texts)
    for d, body in ids.items():
        held = Counter()
        for s, n in of[d]:
            held.update(range(s, s + n))
        assert held == {i: times[d] for i in range(len(body))}
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= width
        padding += width - at
    assert padding <= most_padding
    return padding


def test_query_against_the_tokenizer(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check_pieces(QUERIES["op7_retrieval_packing"](spark, d).collect(), texts, 1024, 1023)


def test_reruns_and_layout_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = sorted(map(tuple, packing.pack(docs, PATH, shard_tokens=20_000, range_tokens=50_000).collect()))
    again = sorted(map(tuple, packing.pack(docs.repartition(7, "n_chars"), PATH, shard_tokens=20_000, range_tokens=50_000).collect()))
    assert first == again


def test_fast_ids_are_the_tokenizers():
    rng = random.Random(0)
    alphabet = "aB 1.\n\t'é中\U0001f600́　‍ _"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["", "it's we'll  x", "a<|endoftext|>b", "x" * 5000]
    texts += ["ab" * 300_000, "".join(rng.choice("abcdé") for _ in range(1_000_000)), "1" * 200_000 + " " * 3000 + "é" * 100_000]  # very long words
    real = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in packing.encoder(PATH)(texts)] == [e.ids for e in real.encode_batch(texts, add_special_tokens=False)]


def test_bm25_is_the_formula():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 40, rng.integers(0, 30)) for _ in range(25)]
    df = np.array([sum(t in d for d in docs) for t in range(40)])
    index = packing.Bm25(docs, packing.Statistics(df, 25, sum(map(len, docs))))
    mean = np.mean([len(d) for d in docs])
    for q in range(25):
        want = np.zeros(25)
        for t in set(docs[q].tolist()):
            df = sum(t in d for d in docs)
            idf = max(0.0, math.log((25 - df + 0.5) / (df + 0.5)))
            for i, d in enumerate(docs):
                tf = int((d == t).sum())
                want[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.scores(q), want)


def test_arrangement_against_brute_force():
    """Document by document: the best unused one for the window's seed, or the first unused one at a window's start."""
    rng = np.random.default_rng(2)
    for width in (5, 16, 100):
        sizes = rng.integers(1, 40, 60)
        table = rng.integers(0, 4, (60, 60)).astype(float)
        for offset in (0, 3):
            got, used, seed, at, want = packing.arrange(sizes, lambda d: table[d].copy(), width, offset), set(), None, offset, []
            for _ in range(60):
                free = [i for i in range(60) if i not in used]
                doc = free[0] if seed is None or at % width == 0 else max(free, key=lambda i: (table[seed][i], -i))
                if seed is None or at % width == 0:
                    seed = doc
                used.add(doc)
                want.append(doc)
                before, at = at // width, at + int(sizes[doc])
                if at // width > before and at % width:
                    seed = doc
            assert got == want


def test_statistics_and_order_are_the_corpus_s(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    real = Tokenizer.from_file(PATH)
    ids = [real.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()]
    found = packing.statistics(packing.tokenised(docs.repartition(3), PATH))
    df = Counter(t for x in ids for t in set(x))
    assert math.isclose(found.mean, sum(map(len, ids)) / len(ids))
    assert all(math.isclose(found.idf[t], max(0.0, math.log((len(ids) - n + 0.5) / (n + 0.5))), abs_tol=1e-12) for t, n in df.items())
    keys = packing.order_keys([np.array(x, np.int64) for x in ids], found)
    by = defaultdict(set)
    for x, k in zip(ids, keys.tolist()):
        by[tuple(sorted(x))].add(tuple(k))
    assert all(len(v) == 1 for v in by.values()) and len({tuple(k) for k in keys.tolist()}) > len(by) / 4
    rows = [(3, 5), (-1, 2**62), (0, 0), (3, -5), (-(2**63), 1), (2**63 - 1, 256)]
    sortable = packing._sortable([np.array(c, np.int64) for c in zip(*rows)])
    assert [rows[i] for i in np.argsort(sortable, kind="stable")] == sorted(rows)


def test_equal_rows_fill_many_ranges(spark):
    rows = [(None, "same words here")] * 900 + [(None, None)] * 900 + [(5, "same words here")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = packing.pack(docs, PATH, width=16, shard_rows=50, range_tokens=400).collect()
    each = len(Tokenizer.from_file(PATH).encode("same words here", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in got) == 1200 * each + 900 and sum(r.start == 0 for r in got) == 2100
    size = Counter()
    for r in got:
        size[r.sequence_id >> 32] += r.length
    assert len(size) > 10 and max(size.values()) <= 400 + each


def test_neighbours_share_windows():
    """Two topics: a window's documents are of its seed's topic while there are any."""
    rng = np.random.default_rng(1)
    ids = [np.append(rng.integers(100 * (i % 3), 100 * (i % 3) + 60, 20), 0) for i in range(120)]
    df = np.array([sum(t in d for d in ids) for t in range(400)])
    rows, end = packing.pack_shard(list(range(120)), ids, 105, packing.Statistics(df, 120, 120 * 20))
    assert end == 120 * 21
    topics = defaultdict(set)
    for d, s in zip(rows["doc_id"], rows["sequence_id"]):
        topics[s].add(d % 3)
    assert sum(len(t) == 1 for t in topics.values()) >= len(topics) - 4


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 30000), (4, "same text"), (4, "same text"), (5, "y" * 4000)]
    docs = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, shard int, start string")
    check_pieces(packing.pack(docs, PATH).collect(), rows, 1024, 1023)
    check_pieces(packing.pack(docs, PATH, width=7, shard_tokens=10, range_tokens=10, shard_rows=2).collect(), rows, 7, 6 * 6)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    unnamed = spark.createDataFrame([(None, "a b c"), (None, "d")], "doc_id long, text string")
    assert sum(r.length for r in packing.pack(unnamed, PATH).collect()) == 6


def test_keys_are_made_once_for_the_bounds(spark, monkeypatch):
    """Dealing rows out by range reads them twice; what it reads is a table, not the keys' making."""
    plans, real = {}, packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or real(df, name))
    packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH)
    assert "MapInArrow" in plans["tokens"] and "MapInArrow" not in plans["ranges"]
