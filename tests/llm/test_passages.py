import hashlib
import random
import re

import numpy as np
import pytest

from glyphloom.llm import fmindex, passages, suffixes
from glyphloom.llm.common import mixed
from glyphloom.llm.passages import segments
from glyphloom.llm.queries import QUERIES

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    """rows: (doc_id or None, text) -> per row the words, the removed positions, and the positions that another doc_id repeats."""
    top = 1 << 63
    split = [(top if d is None else d, W.findall(t or "")) for d, t in rows]
    holders = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            holders.setdefault(tuple(w[i : i + window]), set()).add(d)
    out = []
    for d, w in split:
        gone, shared = set(), set()
        for i in range(len(w) - window + 1):
            have = holders[tuple(w[i : i + window])]
            if min(have) < d:
                gone.update(range(i, i + window))
            if len(have) > 1:
                shared.update(range(i, i + window))
        out.append((w, gone, shared))
    return out


def expected(rows, window=50):
    made = []
    for (d, _), (w, gone, _) in zip(rows, brute(rows, window)):
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        made.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(made)


def corpus(seed):
    """Copies, near copies, shared passages, runs of one word, and short texts over a small vocabulary."""
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(30)]
    base = [[rng.choice(words) for _ in range(rng.choice([0, 30, 49, 50, 51, 90, 200]))] for _ in range(25)]
    texts = list(base)
    for _ in range(40):
        a = list(rng.choice(base))
        if a and rng.random() < 0.5:
            a[rng.randrange(len(a))] = "changed"
        texts.append(a[rng.randrange(20) :] + rng.choice(base)[:70] + ["run"] * rng.choice([0, 0, 60, 120]))
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("kernel", [fmindex.windows_by_fm, suffixes.windows_by_suffixes])
@pytest.mark.parametrize("words_in_use", [1, 2, 3, 80, 2000])
def test_kernels_against_brute_force(kernel, words_in_use):
    rng = np.random.default_rng(words_in_use)
    docs = [rng.integers(0, words_in_use, rng.integers(40, 200)) for _ in range(30)]
    docs += [np.concatenate([docs[k][10:], np.repeat(3, 70), docs[k + 1][:60]]) for k in range(20)]
    for k in range(20):
        docs.append(docs[k].copy())
        docs[-1][rng.integers(0, len(docs[k]))] = words_in_use + 1
    words, first = np.concatenate(docs), np.cumsum([0] + [len(d) for d in docs])
    doc, start, n, mini, _, _ = segments(mixed(words.astype(np.uint64)), first)
    units = [words[first[d] + s : first[d] + s + k + 49] for d, s, k in zip(doc, start, n)]
    found = kernel(np.concatenate(units), n + 49, np.unique(mini, return_inverse=True)[1], doc, doc, 50)
    held = {}
    for d, w in enumerate(docs):
        for i in range(len(w) - 49):
            held.setdefault(w[i : i + 50].tobytes(), []).append(d)
    keys = [u[i : i + 50].tobytes() for u in units for i in range(len(u) - 49)]
    assert found[0].tolist() == [min(held[k]) for k in keys]
    assert len(found) == 1 or found[1].tolist() == [max(held[k]) for k in keys]


def test_the_index_finds_the_windows_of_texts_that_it_does_not_have():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 3, n) for n in (7, 30, 1, 64, 12)]
    index = fmindex.FMIndex(np.concatenate(texts), np.array([len(t) for t in texts]), 5)
    lanes = [rng.integers(0, 4, n) for n in (5, 9, 40, 70)] + [np.repeat(9, 6), texts[3][2:40]]
    size = np.array([len(x) for x in lanes])
    got = sorted(zip(*(x.tolist() for x in index.stream(np.concatenate(lanes), np.cumsum(size) - size, size))))
    have = {}
    for t in range(len(texts))[::-1]:
        for i in range(len(texts[t]) - 4):
            have[texts[t][i : i + 5].tobytes()] = t
    assert got == sorted((k, i, have[x[i : i + 5].tobytes()]) for k, x in enumerate(lanes) for i in range(len(x) - 4) if x[i : i + 5].tobytes() in have)
    bits = rng.random(500) < 0.2
    rank = fmindex.BitRank(bits)
    assert rank.place(np.arange(1, bits.sum() + 1)).tolist() == np.flatnonzero(bits).tolist()
    symbols = rng.integers(0, 13, 300)
    matrix = fmindex.WaveletMatrix(symbols, 12)
    a, b = np.sort(rng.integers(0, 301, (2, 50)), axis=0)
    some = a < b
    assert matrix.least(a[some], b[some]).tolist() == [symbols[i:j].min() for i, j in zip(a[some], b[some])]
    assert matrix.rank(symbols[:50], b).tolist() == [(symbols[:j] == c).sum() for c, j in zip(symbols[:50], b)]


def thue_morse(n, zero, one):
    return [one if bin(i).count("1") % 2 else zero for i in range(n)]


def test_patterns_that_cancel_in_powers_of_two_are_told_apart(spark):
    """A word, or a run of words, and its complement: polynomials of them agree modulo 2**64 whatever the base."""
    a, b = ("".join(thue_morse(1024, x, y)) for x, y in ("ab", "ba"))
    text = lambda word: " ".join([*[f"w{i}" for i in range(30)], word, *[f"v{i}" for i in range(30)]])
    runs = [" ".join(thue_morse(5000, x, y)) for x, y in (("p", "q"), ("q", "p"))]
    rows = [(1, text(a)), (2, text(b)), (3, runs[0]), (4, runs[1]), (5, text(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in fmindex.dedup(docs).collect()}
    assert got == {d: len(gone) for (d, _), (_, gone, _) in zip(rows, brute(rows))} and got[2] == 0 and got[5] == 61
    assert {r.doc_id for r in suffixes.passages(docs).collect()} == {1, 5, 3, 4}


def test_rows_that_repeat_a_document_stay_linear(spark, monkeypatch):
    """What is written grows with the number of different documents, not with their rows."""
    body = " ".join(f"w{i}" for i in range(70))
    seen = {}
    real = passages.written

    def counted(df, name):
        made = real(df, name)
        seen[name] = made.count()
        return made

    monkeypatch.setattr(passages, "written", counted)
    sizes = []
    for many in (100, 1600):
        docs = spark.createDataFrame([(8, body)] * many + [(9, body)] + [(None, body)] * many, "doc_id long, text string").repartition(4)
        rows = fmindex.dedup(docs).collect()
        assert sorted((str(r.doc_id), r.n_removed) for r in rows) == sorted([("8", 0)] * many + [("9", 70)] + [("None", 70)] * many)
        assert {(r.doc_id, r.other_doc_id) for r in suffixes.passages(docs).collect()} == {(8, None), (9, 8), (None, 8)}
        sizes.append((seen["shared"], seen["units"], seen["solved"]))
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("hot", [2048, 3, 1])
def test_dedup_against_brute_force(spark, hot):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.dedup(docs, hot=hot, shard_words=500).collect())
    assert got == expected(rows)


def test_passages_against_brute_force(spark):
    rows = corpus(2)
    got = suffixes.passages(spark.createDataFrame(rows, "doc_id long, text string"), hot=3, shard_words=700).collect()
    have = {}
    for r in got:
        for p in r.passages:
            have.setdefault(r.doc_id, set()).update(range(p.start, p.start + p.length))
    want = {d: shared for (d, _), (_, _, shared) in zip(rows, brute(rows)) if shared}
    assert have == want
    pairs = {(r.doc_id, r.other_doc_id) for r in got}
    assert all(d != o for d, o in pairs) and {d for d, _ in pairs} == set(want)


def test_query_rows_for_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op10_fm_substring_dedup"](spark, d).collect()) == expected(rows)
    shared = {r[0] for r, x in zip(rows, brute(rows)) if x[2]}
    assert {r.doc_id for r in QUERIES["op3_suffix_array_dedup"](spark, d).collect()} == shared


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(20000))
    run = "the " * 3000
    rows = [(5, None), (6, ""), (7, " \n"), (8, long), (9, long), (9, long), (4, "x\n" + run), (3, run), (None, run), (1, "short text"), (2, "short text")]
    docs = spark.createDataFrame([(d, t, 1, "a") for d, t in rows], "doc_id long, text string, n int, seg string")
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.dedup(docs).collect()) == expected(rows)
    kept = fmindex.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("5", None), ("6", ""), ("7", " \n"), ("8", long), ("4", "x\n"), ("3", run), ("1", "short text"), ("2", "short text")], key=str)
    assert {r.doc_id for r in suffixes.passages(docs).collect()} == {8, 9, 4, 3, None}
    empty = docs.limit(0)
    assert fmindex.dedup(empty).count() == 0 and fmindex.deduplicated(empty).count() == 0 and suffixes.passages(empty).count() == 0
