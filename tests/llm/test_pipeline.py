from collections import Counter

import pytest

from glyphloom.llm import mixing
from glyphloom.llm.queries import QUERIES
from tests.llm.test_nearsets import brute_kept
from tests.llm.test_packing import check_pieces
from tests.llm.test_passages import W, brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def expected_stages(spark):
    """Each stage's {doc_id: text}, by plain means, from the stage before."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in QUERIES["op1_quality_qda"](spark, SF).collect() if r.score >= 0.3}
    first = {d: r.text for d, r in docs.items() if d in good}
    keep = brute_kept(list(first.items()))
    second = {d: t for d, t in first.items() if d in keep}
    rows = sorted(second.items())
    third = {}
    for (d, t), (w, gone, _) in zip(rows, brute(rows)):
        left = [x for i, x in enumerate(w) if i not in gone]
        if not gone:
            third[d] = t
        elif left:
            third[d] = left
    return docs, first, second, third


def test_stages_against_brute_force(spark):
    docs, first, second, third = expected_stages(spark)
    rows, got = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = rows.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        rows = spark.createDataFrame(stage(spark, rows, SF).collect(), rows.schema)
        assert rows.columns == columns
        got.append(rows.collect())
    assert {r.doc_id: r.text for r in got[0]} == first and {r.doc_id: r.text for r in got[1]} == second
    assert len(got[2]) == len(third)
    for r in got[2]:
        want = third[r.doc_id]
        assert r.text == want if isinstance(want, str) else W.findall(r.text) == want and r.n_chars == len(r.text)
    draws = {r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(got[2], rows.schema)).collect()}
    assert Counter(r.doc_id for r in got[3]) == Counter({d: n for d, n in draws.items() if n})
    pieces = corpus_pipeline.STAGES[4][1](spark, rows, SF).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in got[3]], 1024, 1023)


def test_run_gives_the_stages_result(spark):
    rows = corpus_pipeline.run(spark, SF)
    kept = [(r.doc_id, r.length) for r in rows.collect()]
    again = [(r.doc_id, r.length) for r in corpus_pipeline.run(spark, SF).collect()]
    assert kept and sorted(kept) == sorted(again)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "some plain words. " * 60, None, None, 1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        rows.collect()
