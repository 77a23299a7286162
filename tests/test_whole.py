"""What reads or prints all, not only the first."""

import numpy as np

from glyphloom.operators import lsa
from glyphloom.plans import catalog
from glyphloom.sources import reports


def test_feature_lines_have_every_term(spark):
    rows = spark.createDataFrame([(1, f"t{i:03}", 1.0 / (i + 1)) for i in range(120)], "doc_id long, token string, w double")
    line = reports.feature_lines(rows).collect()[0].line
    assert [x.split(": ")[0] for x in line.split(", ")] == [f"t{i:03}" for i in range(120)]
    made = catalog.QUERIES["feature_lines"](spark, "/root/testdata/sf0.001").collect()
    assert max(r.line.count(", ") for r in made) > 50


def test_svd_has_every_term(spark):
    d = "/root/testdata/sf0.001"
    rows = catalog.lsa_features(spark, d).collect()
    terms, docs = sorted({r.token for r in rows}), sorted({r.doc_id for r in rows})
    assert len(terms) > 64
    m = np.zeros((len(docs), len(terms)))
    at, row = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(docs)}
    for r in rows:
        m[row[r.doc_id], at[r.token]] = r.w
    want = np.linalg.svd(m, compute_uv=False)[:10]
    assert np.allclose([r.s for r in catalog.QUERIES["svd"](spark, d).orderBy("i").collect()], want, atol=1e-6)
    assert {r.token: r.idx for r in catalog.QUERIES["term_index"](spark, d).collect()} == at


def test_reconstruction_over_many_terms(spark):
    rng = np.random.default_rng(4)
    m = rng.random((60, 300)) * (rng.random((60, 300)) < 0.1)
    cells = [(i, f"t{j:03}", float(m[i, j])) for i in range(60) for j in range(300) if m[i, j]]
    rows = spark.createDataFrame(cells, "doc_id long, token string, w double")
    index = lsa.term_index(rows)
    at = {r.token: r.idx for r in index.collect()}
    u, s, v = np.linalg.svd(m, full_matrices=False)
    low = (u[:, :8] * s[:8]) @ v[:8]
    got = {(r.doc_id, r.token): r.w for r in lsa.reconstruct(lsa.prune(lsa.factors(rows, index, 10), first=8), index, 0.05).collect()}
    want = {(i, f"t{j:03}"): low[i, j] for i in range(60) for j in range(300) if f"t{j:03}" in at and low[i, j] > 0.05}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
