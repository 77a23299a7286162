"""Dear cuts go by different word, and the factorisation keeps its long side distributed."""

import numpy as np
import pytest

from glyphloom.operators import classify, features, lexicon, lsa, morphology


def test_words_are_cut_once_and_counted_as_in_their_texts(spark, monkeypatch):
    texts = [(1, "wsyktbwnh mud~ wsyktbwnh"), (2, "wsyktbwnh  ktb"), (3, ""), (4, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(r.doc_id, r.token, r.n) for r in features.counts(docs, morphology.tokens).collect()}
    kept, write = {}, features.written
    monkeypatch.setattr(features, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    assert {(r.doc_id, r.token, r.n) for r in morphology.counts(docs).collect()} == want
    assert sorted(r.word for r in kept["parts"].collect()) == ["ktb", "mud~", "wsyktbwnh"]
    monkeypatch.setattr(features, "written", write)
    assert morphology.counts(docs.where("doc_id > 2")).count() == 0


@pytest.mark.parametrize("shape", [(7, 30), (30, 7)])
def test_factors_are_tables_and_vectors_as_long_as_the_shorter_side(spark, shape, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.random(shape) * (rng.random(shape) < 0.6)
    rows = spark.createDataFrame([(i * 10, f"t{j:02}", float(m[i, j])) for i, j in np.argwhere(m).tolist()], "doc_id long, token string, w double")
    made, width = lsa.IndexedRowMatrix, []
    monkeypatch.setattr(lsa, "IndexedRowMatrix", lambda table, numCols: width.append(numCols) or made(table, numCols=numCols))
    index = lsa.term_index(rows)
    found = lsa.factors(rows, index, 5)
    assert width == [7] and found.u.columns == ["doc_id", "x"] and found.v.columns == ["idx", "x"]
    u, s, v = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(found.s, s[:5])
    low = (u[:, :3] * s[:3]) @ v[:3]
    pruned = lsa.prune(found, first=3)
    for above in (-9.0, 0.2):
        got = {(r.doc_id, r.token): r.w for r in lsa.reconstruct(pruned, index, above).collect()}
        want = {(i * 10, f"t{j:02}"): low[i, j] for i in range(shape[0]) for j in range(shape[1]) if low[i, j] > above}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert lsa.reconstruct(lsa.prune(found, above=1e9), index, 0.0).count() == 0
    assert lsa.factors(rows, index, 5, vectors=False).u is None


@pytest.mark.parametrize("shape", [(7, 30), (90, 40)])
def test_factors_of_a_long_side_keep_vectors_off_the_driver(spark, shape, monkeypatch):
    rng = np.random.default_rng(6)
    m = rng.random(shape) * (rng.random(shape) < 0.4)
    m[0, :], m[:, 0] = 0.3, 0.7
    rows = spark.createDataFrame([(i * 10, f"t{j:02}", float(m[i, j])) for i, j in np.argwhere(m).tolist()], "doc_id long, token string, w double")
    monkeypatch.setattr(lsa, "ON_DRIVER", 5, raising=False)
    monkeypatch.setattr(lsa, "IndexedRowMatrix", None)
    from glyphloom.operators import lanczos

    for name, value in {"SPAN": 8, "BASIS": 24, "WIDTH": 2, "CHUNK": 50}.items():
        monkeypatch.setattr(lanczos, name, value)
    index = lsa.term_index(rows)
    found = lsa.factors(rows, index, 5)
    u, s, v = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(found.s, s[:5], atol=1e-10, rtol=0)
    low = (u[:, :3] * s[:3]) @ v[:3]
    got = {(r.doc_id, r.token): r.w for r in lsa.reconstruct(lsa.prune(found, first=3), index, -9.0).collect()}
    assert len(got) == m.size and all(abs(got[i * 10, f"t{j:02}"] - low[i, j]) < 1e-8 for i in range(shape[0]) for j in range(shape[1]))


def test_svd_reconstruct_is_the_same_with_vectors_in_files(spark, monkeypatch):
    from glyphloom.plans import catalog

    ask = lambda: {(r.doc_id, r.token): (round(r.w0, 9), round(r.w, 7), r.star) for r in catalog.QUERIES["svd_reconstruct"](spark, "/root/testdata/sf0.001").collect()}
    want = ask()
    monkeypatch.setattr(lsa, "ON_DRIVER", 0, raising=False)
    monkeypatch.setattr(lsa, "IndexedRowMatrix", None)
    assert want and ask() == want


def test_neighbours_leave_no_table_that_nothing_reads(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 3} b{i % 4} c{i % 5} d") for i in range(40)], "doc_id long, text string")
    gone, drop = [], features.dropped
    monkeypatch.setattr(features, "dropped", lambda df: (gone.append(df._glyphloom_path.split("glyphloom-")[1].split("-")[0]), drop(df)))
    own = features.frequencies(features.counts(docs))
    want = features.neighbours(own, docs.where("doc_id < 4")).collect()
    assert gone == ["rare"] and own.count() == 160
    got = features.neighbours(features.counts(docs), docs.where("doc_id < 4")).collect()
    assert gone == ["rare", "frequencies", "rare"] and sorted(got) == sorted(want) and len(got) == 40


def test_neighbours_keep_the_queries_terms_alone_and_no_shuffles(spark, monkeypatch):
    import pathlib

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in (rng.random(rng.integers(1, 14)) ** 3 * 90).astype(int)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept, write = {}, features.written
    monkeypatch.setattr(features, "written", lambda df, name: kept.setdefault(name, write(df, name)) if name != "best" else write(df, name))
    monkeypatch.setattr(features, "BLOCK", 8, raising=False)
    dirs = [pathlib.Path(str(x)) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {p.name for top in dirs for p in top.rglob("shuffle_*.data")}
    before = shuffles()
    made = features.neighbours(features.counts(docs), docs.where("doc_id < 5"), k=4, rare=6)
    # What is left is of the few actions that write no table.
    assert len(shuffles() - before) <= 8
    weights = kept["weights"]
    asked = {w for x in texts[:5] for w in x.split()}
    df = {w: sum(w in x.split() for x in texts) for w in asked}
    assert "size" not in weights.columns and weights.count() == sum(n for n in df.values() if n > 1)
    bag = [{w: x.split().count(w) / len(x.split()) for w in x.split()} for x in texts]
    size = [sum(v * v for v in b.values()) ** 0.5 for b in bag]
    cos = lambda a, b: round(sum(bag[a][w] * bag[b][w] / df[w] ** 2 for w in bag[a] if w in bag[b]) / (size[a] * size[b]), 9)
    want = set()
    for a in range(5):
        near = sorted((-cos(a, b), b) for b in range(60) if b != a and bag[a].keys() & bag[b].keys())[:4]
        want |= {(a, b, i + 1, -c) for i, (c, b) in enumerate(near)}
    assert {tuple(r) for r in made.select("doc_id", "other_id", "rank", "cos").collect()} == want
    states = {r.closed for r in kept["bounds"].collect()}
    assert False in states


@pytest.mark.parametrize("rows", [0, 10, 11, 95])
def test_a_workbook_goes_on_in_further_sheets(spark, tmp_path, monkeypatch, rows):
    import zipfile

    from pyspark.sql import functions as F

    from glyphloom.sources import workbooks

    lines = spark.range(0, rows, numPartitions=3).select(F.array(F.col("id").cast("string"), F.lit("</row>")).alias("cells"), F.array(F.lit("RED"), F.lit("BLUE")).alias("colours"))
    path = f"file://{tmp_path}/more.xlsx"
    workbooks.write(lines, path, sheet=10)
    with zipfile.ZipFile(tmp_path / "more.xlsx") as book:
        counts = [book.read(n).count(b"<row>") for n in sorted(book.namelist(), key=len) if "worksheets/" in n]
    assert sum(counts) == rows and len(counts) == max(1, -(-rows // 10)) and max(counts) <= 10
    got = workbooks.read(spark, path).collect()
    assert [(r.line, r.cells, r.colours) for r in got] == [(i, [str(i), "</row>"], ["RED", "BLUE"]) for i in range(rows)]


def test_a_worksheets_end_may_lie_in_two_blocks(tmp_path, monkeypatch):
    import zipfile

    from pyspark.sql.types import StructType

    from glyphloom.sources import workbooks

    monkeypatch.setattr(workbooks, "_BLOCK", 3)
    monkeypatch.setattr(workbooks, "_LONG", 0)
    writer = workbooks._Writer({"path": str(tmp_path / "w.xlsx"), "sheet": "3"}, StructType())
    found = []
    for part, rows in enumerate([2, 0, 5]):
        (tmp_path / f"{part}.xml").write_text("".join(workbooks.row_xml([f"{part}.{i}"], [None]) for i in range(rows)))
        found.append(workbooks.Fragment(part, str(tmp_path / f"{part}.xml"), rows))
    writer.commit(found)
    with zipfile.ZipFile(tmp_path / "w.xlsx") as book:
        assert [book.read(f"xl/worksheets/sheet{i}.xml").count(b"</row>") for i in (1, 2, 3)] == [3, 3, 1]
    reader = workbooks._Reader(str(tmp_path / "w.xlsx"))
    assert [(line, cells[0]) for p in reader.partitions() for line, cells, _ in reader.read(p)] == list(enumerate(["0.0", "0.1", "2.0", "2.1", "2.2", "2.3", "2.4"]))


def test_report_lines_look_for_the_best_words_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 3} b{i % 2} c") for i in range(6)], "doc_id long, text string")
    gold = spark.createDataFrame([(i, x, int(i % 3 == n)) for i in range(6) for n, x in enumerate(["p", "q"])], "doc_id long, label string, gs int")
    tok, counts, looked, look = features.tokens(docs), features.counts(docs), [], classify.best_and_worst
    lex = lexicon.learn(counts, gold, 10)
    said = classify.decide(classify.scores(docs, counts, lex), 0.3)
    monkeypatch.setattr(classify, "best_and_worst", lambda *a: looked.append(1) or look(*a))
    assert classify.report_lines(docs, tok, lex, said, gold, ["p", "q"]).count() == 24 and len(looked) == 1
    assert classify.report(docs, tok, lex, said, gold).columns == ["doc_id", "label", "cell", "colour", "best", "worst"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_line_end_behind_white_space_is_no_part_of_the_last_word(spark):
    from pyspark.sql import functions as F

    from glyphloom.functions import text as T

    texts = ["abc \u2028", "a\t\x85", "rt @bob @ al start @al.. x&amp;y z", "gonna\ncannot cannots 12a3b", "İΣ @\U0001f602"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.tokens(F.col("text")).alias("t")).orderBy("i").collect()]
    assert got == [["abc", "\u2028"], ["a", "\x85"], ["al", "sta", "x", "z"], ["gon", "na", "can", "not", "cannots", "a", "b"], ["i̇", "σ", "\U0001f602"]]


def test_the_pruned_vocabulary_joins_nothing(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a b b b c"), (3, "d a")], "doc_id long, text string")
    counts = features.counts(docs)
    made = features.pruned_vocabulary(counts, 0.25)
    want = features.tfidf(counts, 0.25).groupBy("token", "df").count().collect()
    assert sorted((r.token, r.df, r.idf) for r in made.collect()) == sorted((r.token, r.df, 1.0 / r.df) for r in want) == [("b", 2, 0.5)]
    assert "Join" not in plan_of(made)


def test_weights_have_the_terms_places_without_a_second_join(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + (i * k) % 7)} u{chr(97 + i)}" for k in range(5))) for i in range(20)] + [(30, "ua ub")], "doc_id long, text string")
    counts = features.counts(docs)
    rows = features.tfidf(counts, index=True)
    want = lsa.matrix_rows(features.tfidf(counts), lsa.term_index(features.tfidf(counts))).collect()
    made = lsa.matrix_rows(rows)
    assert sorted(made.collect()) == sorted(want) and len(want) == 21
    assert "SortMergeJoin" not in plan_of(made)


def test_surrogates_leave_tokens_where_they_are(spark):
    docs = spark.createDataFrame([(1, "a \U0001f602 \U0001f602 b"), (2, "\U0001f600 a")], "doc_id long, text string")
    tok = features.tokens(docs)
    surrogates = features.emoji_surrogates(tok)
    made = features.with_surrogates(tok, surrogates)
    assert sorted(map(tuple, made.collect())) == [(1, 0, "a"), (1, 1, "eMJ0"), (1, 2, "eMJ0"), (1, 3, "b"), (2, 0, "eMJ1"), (2, 1, "a")]
    assert "BroadcastHashJoin" in plan_of(made)
    counted = features.with_surrogates(features.counts(docs), surrogates)
    assert sorted((r.doc_id, r.token, r.n) for r in counted.collect()) == [(1, "a", 1), (1, "b", 1), (1, "eMJ0", 2), (2, "a", 1), (2, "eMJ1", 1)]


def test_a_segments_words_are_cut_before_they_are_gathered(spark):
    index = spark.createDataFrame([("s/NN", f"f{i:02}", "NN", f"b{i:02}") for i in range(30)] + [("t/NN", "f", "NN", "b")], "segment string, form string, tag string, bw string")
    made = morphology.show_index(index, 3)
    assert sorted(map(tuple, made.collect())) == [("s/NN", 30, ["f00", "f01", "f02"]), ("t/NN", 1, ["f"])]
    assert "WindowGroupLimit" in plan_of(made)


def test_words_without_a_shadda_need_no_fold(spark):
    from pyspark.sql import functions as F

    from glyphloom.functions import text as T

    words = ["mudo", "mud~o", "~ab~", "oo", "", "a~~", None]
    assert [r.t for r in spark.createDataFrame(list(enumerate(words)), "i int, s string").orderBy("i").select(T.shaddas(F.col("s")).alias("t")).collect()] == ["mud", "mudd", "~abb", "", "", "aaa", None]
    assert "contains" in spark.createDataFrame([("a",)], "s string").select(T.shaddas(F.col("s")).alias("t"))._jdf.queryExecution().analyzed().toString().lower()


def test_lines_of_terms_are_sorted_without_a_window(spark):
    from glyphloom.sources import reports

    rows = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.75), (2, "x", 0.0004)], "doc_id long, token string, w double")
    made = reports.feature_lines(rows)
    assert sorted(map(tuple, made.collect())) == [(1, "c: 0.750, a: 0.500, b: 0.500"), (2, "x: 0.000")]
    assert "Window" not in plan_of(made)
    assert sorted(map(tuple, reports.feature_lines(rows, 2).collect())) == [(1, "c: 0.750, a: 0.500"), (2, "x: 0.000")]


def test_media_are_stored_without_the_sound_made_of_them(spark, monkeypatch):
    from glyphloom.llm import media

    kept, write = [], media.written
    monkeypatch.setattr(media, "written", lambda df, name: kept.append(df.columns) or write(df, name))
    docs = spark.createDataFrame([(1, "some words"), (2, None), (3, "x" * 300)], "doc_id long, text string")
    made = {r.doc_id: r for r in media.digest(docs).collect()}
    assert kept == [["doc_id", "n_bytes", "media"]]
    want = {r.doc_id: r for r in media.described(media.with_pcm(media.stored(docs))).collect()}
    assert made == want and all(",peak=" in r.feature for r in made.values())
