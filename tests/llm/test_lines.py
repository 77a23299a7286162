"""Operator 12 against plain counting, and that what was added can be taken back."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import lines
from glyphloom.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def plain(rows, least):
    """(doc_id, lines, dropped, kept text) of rows (doc_id, text)."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        said = (text or "").split("\n")
        kept = [x for x in said if not key(x) or len(holders[key(x)]) < least]
        out.append((i, len(said), len(said) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [
    (1, "Menu\n  menu \nown é line\n\n"), (2, "MENU\t\nother"), (3, "menu"), (4, None), (5, ""), (6, "\n\n"), (7, "É menu\nmenu\x0b"), (7, "É menu\nmenu"), (None, "menu\nx"),
    (None, "x\ny"), (8, "x\r\ny\r\n"), (9, "word " * 60000 + "\nmenu\n" + "y"), (10, "K\nk\nK"), (11, "  menu"), (12, "k"), (-3, "a\x00b\nmenu"),
]


@pytest.mark.parametrize("most", [lines.SENT_BYTES, 0])
@pytest.mark.parametrize("least", [1, 2, 3, 6, 100])
def test_odd_rows(spark, most, least):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, lines.dedup(docs, least, most=most).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)
    assert got == plain(ROWS, least)


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup(none, 2).count() == 0
    names = ["n_lines", "_n_lines", "kept_text", "line_text", "line_gone", "line_name", "line_found", "key", "name", "o`k", "a.b"]
    rows = [(1, "a\nb", *range(11)), (2, "A \nc", *range(11))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n.replace('`', '``')}` int" for n in names)]))
    for most in (lines.SENT_BYTES, 0):
        made = lines.kept(docs, least=2, most=most)
        assert made.columns == docs.columns
        assert sorted(map(tuple, made.collect())) == [(1, "b", *range(11)), (2, "c", *range(11))]


def counts(index):
    return {bytes(r.key): r.docs for r in index.table("counts").collect()}


def said(index):
    return {r.shard: (lines.Cuckoo.read(r.filter), np.frombuffer(bytes(r.wrong), np.uint64)) for r in index.table("filters").collect()}


def test_documents_come_and_go(spark, tmp_path):
    """After each change, counts, answers and texts are those of an index built of what is left."""
    rows = [(i, "\n".join(["all", f"pair {i // 2}", f"own {i}", *(["some"] if i % 3 == 0 else [])])) for i in range(60)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    folder = f"file://{tmp_path}/index"
    index = lines.LineIndex(spark, folder, 10, shard_keys=8)
    index.add(frame(rows[:25]))
    first = counts(index)
    assert index.state["shards"] > 1
    index.add(frame(rows[25:]))
    index.add(frame(rows[:5]))  # what is there already counts once
    again = lines.LineIndex(spark, folder, 10, shard_keys=8)  # another session finds it as it was left
    got = lambda at, r: sorted(map(tuple, at.marked(frame(r)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)
    assert got(again, rows) == plain(rows, 10) and "some" not in "".join(x[3] for x in got(again, rows))
    ids = frame(rows[25:]).select("doc_id").union(spark.createDataFrame([(999,), (None,)], "doc_id long"))
    again.remove(ids)
    assert counts(again) == first and again.table("members").count() == 25
    # "some" is in nine documents now: it has left its filter, and comes back into the texts.
    assert got(again, rows[:25]) == plain(rows[:25], 10) and "some" in "".join(x[3] for x in got(again, rows[:25]))
    again.remove(frame(rows).select("doc_id"))
    assert counts(again) == {} and all(len(f) == 0 for f, _ in said(again).values())
    with pytest.raises(ValueError):
        lines.LineIndex(spark, folder, 3)


def test_a_document_that_grows_counts_once_for_a_line(spark):
    index = lines.LineIndex(spark, least=2)
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    index.add(frame([(1, "a\nb")]))
    index.add(frame([(1, "a\nc"), (2, "c"), (2, "d")]))
    name = lambda x: hashlib.blake2b(x.encode(), digest_size=lines.KEY_BYTES).digest()
    assert counts(index) == {name("a"): 1, name("b"): 1, name("c"): 2, name("d"): 1}
    assert {bytes(r.key) for r in index.common().collect()} == {name("c")}
    index.remove(spark.createDataFrame([(1,)], "doc_id long"))
    assert counts(index) == {name("c"): 1, name("d"): 1}


def test_a_change_that_is_broken_off_leaves_the_index(spark, monkeypatch):
    index = lines.LineIndex(spark, least=2)
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a")], "doc_id long, text string")
    index.add(docs)
    before = counts(index)
    monkeypatch.setattr(index, "_name", lambda **_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.remove(docs.select("doc_id"))
    assert counts(lines.LineIndex(spark, index.folder, 2)) == before


def test_the_filter():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    made = lines.Cuckoo.sized(2000)
    assert made.add(hashes[:2000]) and len(made) == 2000 and made.has(hashes[:2000]).all()
    assert made.has(hashes[2000:]).mean() < 0.01
    made.remove(hashes[:1000])
    assert len(made) == 1000 and made.has(hashes[1000:2000]).all() and made.has(hashes[:1000]).mean() < 0.01
    back = lines.Cuckoo.read(made.bytes())
    assert (back.table == made.table).all() and back.add(hashes[:1000]) and back.has(hashes[:2000]).all()
    back.remove(hashes[:2000])
    assert not len(back)
    with pytest.raises(KeyError):
        back.remove(hashes[:1])
    assert not lines.Cuckoo(1).add(np.array([5, 5, 5, 5, 5], np.uint64))


def test_a_shard_filter_with_its_list_is_exact():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 64, 200_000, dtype=np.uint64)
    before, after = np.zeros(len(hashes), int), rng.integers(0, 3, len(hashes))
    made, wrong = lines.changed(None, hashes, before, after, 2)
    answer = made.has(hashes) & ~np.isin(hashes, wrong)
    assert len(wrong) > 0 and answer[after > 0].tolist() == (after[after > 0] >= 2).tolist()
    later = rng.integers(0, 3, len(hashes))
    made, wrong = lines.changed(made, hashes, after, later, 2)
    answer = made.has(hashes) & ~np.isin(hashes, wrong)
    assert answer[later > 0].tolist() == (later[later > 0] >= 2).tolist() and len(made) == (later >= 2).sum()


@pytest.mark.parametrize("most", [lines.SENT_BYTES, 0])
def test_the_query_over_the_tables(spark, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 10)
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want)
    assert sum(x[2] for x in want) > 0
    got = QUERIES["op12_cuckoo_lines"](spark, "/root/testdata/sf0.001") if most else lines.dedup(docs, 10, most=0).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"] and sorted(map(tuple, got.collect())) == want
