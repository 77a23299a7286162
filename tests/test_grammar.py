"""The grammar without conditionals, as columns and as joins, against the grammar as it stands."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphloom.operators import morphology, patterns
from glyphloom.plans import catalog, words
from glyphloom.plans.analyses import analyses
from glyphloom.plans.sql import assemble
from glyphloom.streaming import service

LETTERS = "AbtvjHxdrzsSDTZEgfqklmnhwyoiuaFNK~pYOIW><&}|{`'\n"


def drawn(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    some = ["".join(rng.choice(LETTERS[: rng.choice([5, 26, 30, len(LETTERS)])]) for _ in range(rng.randrange(12))) for _ in range(n)]
    some += ["".join(rng.choice("Awyktbnhms") for _ in range(rng.randrange(2, 10))) for _ in range(n)]
    return list(dict.fromkeys([*words.words(), *some, "é文x", "nn" * 40, "A" * 50, "ktb" * 30]))


def told(word, rule, groups):
    return morphology.analyse(word, rule, groups)


def test_columns_say_what_the_grammar_says(spark):
    listed = drawn(4000, 1)
    table = spark.createDataFrame([(w,) for w in listed], "w string").repartition(4)
    w = F.col("w")
    kinds = [(rule, groups) for rule in ("NN", "VB") for groups in (morphology.STANDARD, morphology.STEMMING)]
    rows = table.select("w", *[morphology.lookup(w, rule, groups).alias(f"c{i}") for i, (rule, groups) in enumerate(kinds)], morphology.stem_word(w).alias("s")).collect()
    found = 0
    for r in rows:
        for i, (rule, groups) in enumerate(kinds):
            got = None if r[i + 1] is None else [tuple(p) for p in r[i + 1]]
            assert got == told(r.w, rule, groups), (r.w, rule)
            found += got is not None
        assert list(r.s) == morphology.segments(r.w), r.w
    assert len(rows) == len(listed) and found > len(listed)


def test_odd_words(spark):
    rows = spark.createDataFrame([(None,), (f"kt{patterns.BREAK}b",), ("",)], "w string").select(morphology.lookup(F.col("w"), "NN").alias("a"), morphology.stem_word(F.col("w")).alias("s"), morphology.stem_text(F.col("w")).alias("t")).collect()
    assert [(r.a, r.s) for r in rows] == [(None, None), (None, [f"kt{patterns.BREAK}b"]), (None, [""])] and [r.t for r in rows][::2] == [None, ""]


def test_texts_of_many_words(spark):
    listed = [w for w in drawn(200, 2) if " " not in w]
    text = " ".join(listed) + "  "
    arabic = text.translate(str.maketrans(morphology.T.BUCKWALTER, morphology.T.ARABIC))
    bw = arabic.translate(str.maketrans(morphology.T.ARABIC, morphology.T.BUCKWALTER))
    want = " ".join(s for w in bw.split(" ") for s in morphology.segments(w)).translate(str.maketrans(morphology.T.BUCKWALTER, morphology.T.ARABIC))
    assert spark.createDataFrame([(arabic,)], "t string").select(morphology.stem_text(F.col("t"))).first()[0] == want


def test_joins_say_what_the_grammar_says():
    listed = [w for w in drawn(4000, 3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE listed (word VARCHAR)")
    con.executemany("INSERT INTO listed VALUES (?)", [(w,) for w in listed])
    rows = con.execute(assemble("SELECT a.word, noun, verb, snoun, sverb, segments FROM analysed a JOIN segmented USING (word)", **analyses("SELECT word FROM listed"))).fetchall()
    assert len(rows) == len(listed)
    for word, *lists, segments in rows:
        for got, (rule, groups) in zip(lists, [("NN", morphology.STANDARD), ("VB", morphology.STANDARD), ("NN", morphology.STEMMING), ("VB", morphology.STEMMING)], strict=True):
            want = told(word, rule, groups)
            assert got == (None if want is None else [f"{form}/{tag}" for tag, form in want]), (word, rule)
        assert segments == morphology.segments(word), word


@pytest.mark.parametrize("text, bound, want", [("a(?(G2)k)|b", True, "ak|b"), ("a(?(G2)k)|b", False, "a|b"), ("(?(G2)(?<!(h|n))Ax)y(?(G2)z)", True, "(?<!(h|n))Axyz"), ("(?(ON)x)", True, "(?(ON)x)")])
def test_conditionals_are_decided(text, bound, want):
    assert patterns.decided(text, "G2", bound) == want


def test_very_long_words(spark):
    listed = ["ktb" * 20_000, "A" * 50_000, "k" * 50_000, "wa" * 30_000, "wAl" + "ktab" * 10_000, "mu" * 30_000, "sy" + "\u0644" * 20_000]
    table = spark.createDataFrame([(w,) for w in listed], "w string")
    rows = table.select("w", morphology.lookup(F.col("w"), "NN").alias("n"), morphology.lookup(F.col("w"), "VB").alias("v"), morphology.stem_word(F.col("w")).alias("s")).collect()
    for r in rows:
        for got, rule in ((r.n, "NN"), (r.v, "VB")):
            want = told(r.w, rule, morphology.STANDARD)
            assert want == (None if got is None else [tuple(p) for p in got])
        assert "".join(r.s) == r.w and list(r.s) == morphology.segments(r.w)


def test_a_batch_of_requests_analyses_each_word_once(spark, monkeypatch, tmp_path):
    listed = ["وكتبها", "كتاب", "مُدِّ", "bytnA", "the", "mud~o", "", "x'"]
    texts = [" ".join(listed[(i + k) % len(listed)] for k in range(i % 7 + 1)) for i in range(60)] * 3 + ["", " ", "  the ", None]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    tables, real = [], morphology.written
    monkeypatch.setattr(morphology, "written", lambda df, name: tables.append(real(df, name)) or tables[-1])
    got = sorted(map(tuple, catalog.QUERIES["stemmed_requests"](spark, str(tmp_path)).collect()))
    turns = spark.createDataFrame([(t or "",) for t in texts], "value string")
    assert got == sorted(map(tuple, service.answers(turns, morphology.stem_text).collect()))
    assert [t.count() for t in tables if "word" in t.columns] == [len(listed)]
    alone = morphology.stem_texts(spark.createDataFrame([(None,), ("كتاب",)], "value string"))
    assert {r.value: r.answer is None for r in alone.collect()} == {None: True, "كتاب": False}
