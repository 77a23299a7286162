"""Operator 13 against plain slicing, and back to the texts."""

import hashlib
import random

from pyspark.sql import functions as F

from glyphloom.llm import infill
from glyphloom.llm.queries import QUERIES


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or c % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = text[:i], text[i:j], text[j:]
    return (doc_id, n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (doc_id, n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}")


def made(docs):
    return infill.transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def test_the_query_over_the_tables(spark):
    rows = [plain(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = QUERIES["op13_infill"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((*r[:5], sha(r[5]), sha(texts[r[0]])) for r in rows)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_odd_rows_come_back(spark):
    rng = random.Random(4)
    parts = ["<", "<S", "<P", "<M", ">", "S>", "P", "M>", "a", "é", "é", "👩‍👩", "\n", "\r\n", "\x00", " ", " ", "ß", "中"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for i in range(400)]
    rows += [(None, "no id"), (None, "no id"), (500, None), (501, ""), (502, "<P>"), (503, "x<M>"), (-7, "minus"), (504, "long é text\n" * 40_000), (505, "<S >"), (506, "z" * infill.SEGMENT), (507, "z" * (infill.SEGMENT + 1)), (508, "y " * infill.SEGMENT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = made(docs).collect()
    order = lambda x: (str(x[0]), x[5])
    assert sorted(map(tuple, got), key=order) == sorted((plain(*r) for r in rows), key=order)
    back = infill.transformed(docs).select("doc_id", "text", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(back) == len(rows) and all((r.text or "") == r.back for r in back)
    assert made(docs.limit(0)).count() == 0


def test_names_that_clash_and_other_parameters(spark):
    docs = spark.createDataFrame([(1, "some text", 7, "x", True)], "doc_id long, text string, n int, output string, `infill_text` boolean")
    got = infill.transformed(docs, cut=100)
    assert got.columns == ["doc_id", "text", "n", "output", "infill_text", "_n", "form", "prefix_chars", "middle_chars", "_output"]
    row = got.first()
    assert tuple(row)[:6] == (1, "some text", 7, "x", True, 9) and row.form in ("psm", "spm")
    other = infill.transformed(docs, seed=2, marks=("[pre]", "[suf]", "[mid]"), cut=100, suffix_first=100).withColumn("back", infill.restored(F.col("_output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).first()
    assert other.form == "spm" and other._output.startswith("[suf]") and other.back == "some text"
    assert infill.transformed(docs, cut=0).first().form == "plain"


def test_offsets_are_those_of_code_points():
    for text in ("", "a", "\n\n", "é👩‍👩\x00", "ab" * 300, "one two, one\ttwo " * 5):
        for segment in (1, 2, 7, 128):
            offsets = infill.Offsets(segment)
            sizes = offsets.sizes(text)
            assert sum(sizes) == len(text) and offsets.ends(text, sizes, tuple(range(len(text) + 1))) == list(range(len(text) + 1))
