"""Stages that keep rows keep all their columns, whatever these are called."""

from glyphloom.llm import fmindex, mixing, quality, simhash

NAMES = ["did", "_did", "tkey", "left_over", "maybe", "kept_text", "of", "rate", "n", "a.b", "o`k", "seg"]


def test_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "s", 9, *range(12)), (2, text + " more", "s", 9, *range(12)), (3, "other words", None, 9, *range(12))]
    names = ["doc_id", "text", "source", "n_chars", *NAMES]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'string' if n in ('text', 'source') else 'long'}" for n in names))
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    for made in (simhash.kept(docs), fmindex.deduplicated(docs), mixing.mix(docs), quality.filtered(docs, labels)):
        assert made.columns == names
        for r in made.collect():
            assert tuple(r)[4:] == tuple(range(12))
    cut = {r.doc_id: (r.text, r.n_chars) for r in fmindex.deduplicated(docs).collect()}
    assert cut == {1: (text, 9), 2: ("more", 4), 3: ("other words", 9)}
