"""Worked examples and properties that need no tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import text as T
from glyphloom.operators import classify, duplicates, features, lexicon, lsa, measure, morphology, tune
from glyphloom.sources import corpora, reports, workbooks
from glyphloom.streaming import service

DOCS = [(1, "happy happy day"), (2, "sad day"), (3, "happy love"), (4, "sad rain day")]
GOLD = {1: (1, 0, 1), 2: (0, 1, 0), 3: (1, 0, 1), 4: (0, 1, 0)}
NAMES = ["joy", "sad", "love"]


@pytest.fixture(scope="module")
def example(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    gold = spark.createDataFrame([(d, n, g) for d, row in GOLD.items() for n, g in zip(NAMES, row)], "doc_id long, label string, gs int")
    return docs, features.tokens(docs), gold


def test_features_of_the_example(example):
    _, tok, gold = example
    assert {r.token: r.df for r in features.vocabulary(tok).collect()} == {"happy": 2, "day": 3, "sad": 2}
    w = {(r.doc_id, r.token): round(r.w, 6) for r in features.tfidf(tok).collect()}
    assert w == {(1, "day"): 0.111111, (1, "happy"): 0.333333, (2, "day"): 0.166667, (2, "sad"): 0.25, (3, "happy"): 0.25, (4, "day"): 0.111111, (4, "sad"): 0.166667}
    assert {r.doc_id: round(r.size, 6) for r in features.norms(tok).collect()} == {1: 0.745356, 2: 0.707107, 3: 0.707107, 4: 0.57735}
    index = {(r.token, r.label): r.docs for r in features.inverted_index(tok, gold).collect()}
    assert index["happy", "joy"] == [1, 1, 3] and ("rain", "joy") not in index
    assert {r.token for r in features.pruned_vocabulary(tok, 0.3).collect()} == {"happy"}


def test_lexicons_of_the_example(example):
    _, tok, gold = example
    want = {
        "TFIDF": {"happy": (0.5, 0, 0.5), "day": (0.25, 0.5, 0.25), "sad": (0, 1, 0)},
        "DIST": {"happy": (0.166667, -0.333333, 0.166667), "day": (-0.083333, 0.166667, -0.083333), "sad": (-0.333333, 0.666667, -0.333333)},
        "FULL": {"happy": (37.037037, -74.074074, 37.037037), "day": (-9.259259, 18.518519, -9.259259), "sad": (-148.148148, 296.296296, -148.148148)},
    }
    for kind, words in want.items():
        got = {}
        for r in lexicon.learn(tok, gold, None, kind).collect():
            got.setdefault(r.token, {})[r.label] = r.weight
        assert {t: tuple(w[n] for n in NAMES) for t, w in got.items()} == words
    with pytest.raises(ValueError):
        lexicon.learn(tok, gold, None, "OTHER")


def test_balance_equalises_positive_masses(example):
    _, tok, gold = example
    mass = [r.mass for r in lexicon.positive_mass(lexicon.balance(lexicon.learn(tok, gold))).collect()]
    assert max(mass) - min(mass) < 1e-4


def test_reciprocal_rank(spark):
    lex = spark.createDataFrame([("a", "x", 9.0), ("b", "x", 5.0), ("c", "x", 1.0)], "token string, label string, weight double")
    assert {r.token: r.score for r in lexicon.reciprocal_rank(lex).collect()} == {"a": 25.0, "b": 8.333333, "c": 0.0}


def test_decisions_of_the_example(example):
    docs, tok, gold = example
    scored = classify.scores(docs, features.term_counts(tok), lexicon.learn(tok, gold))
    said = classify.decide(scored, 0.5)
    got = {}
    for r in said.collect():
        got.setdefault(r.doc_id, {})[r.label] = (round(r.ratio, 6), r.decision)
    assert {d: tuple(x[n][0] for n in NAMES) for d, x in got.items()} == {1: (1, -2, 1), 2: (-0.5, 1, -0.5), 3: (1, -2, 1), 4: (-0.5, 1, -0.5)}
    assert {d: tuple(x[n][1] for n in NAMES) for d, x in got.items()} == GOLD
    assert classify.prfj(classify.confusion(said, gold)).first() == (1.0, 1.0, 1.0, 1.0)


def test_documents_without_lexicon_words_still_count(spark, example):
    docs, tok, gold = example
    more = docs.unionByName(spark.createDataFrame([(9, "unknown")], "doc_id long, text string"))
    gs = gold.unionByName(spark.createDataFrame([(9, n, 1) for n in NAMES], "doc_id long, label string, gs int"))
    lex = lexicon.learn(tok, gold)
    said = classify.decide(classify.scores(more, features.term_counts(features.tokens(more)), lex), 0.5)
    assert {r.label: r.fn for r in classify.confusion(said, gs).collect()} == {"joy": 1, "sad": 1, "love": 1}
    worst = classify.best_and_worst(more, features.tokens(more), lex).where("doc_id = 9").collect()
    assert len(worst) == 3 and all(r.best is None and r.worst is None for r in worst)


@pytest.mark.parametrize("counts, want", [((0, 3, 2), (0, 0, 0, 0)), ((0, 0, 0), (0, 0, 0, 0)), ((2, 1, 1), (0.666666667, 0.666666667, 0.666666667, 0.5))])
def test_measures(spark, counts, want):
    row = spark.createDataFrame([("x", *counts)], "label string, tp long, fp long, fn long")
    assert tuple(classify.prfj(row).first()) == want


def test_grid_keeps_the_rounding_of_subtraction():
    values = tune.grid_values()
    assert len(values) == 11 and values[-1] == 1.3877787807814457e-16 and values[3] == 0.7000000000000001
    assert tune.grid_values(closed=True) == values


def test_thresholds_and_sweet_spot(spark):
    rows = [("x", 1.0, 1, 0, 9, 0), ("x", 0.9, 5, 3, 5, 0), ("x", 0.8, 8, 4, 2, 0), ("x", 0.7, 8, 4, 2, 0), ("y", 1.0, 0, 1, 1, 0)]
    counted = spark.createDataFrame(rows, "label string, threshold double, tp long, fp long, fn long, tn long")
    assert {r.label: r.threshold for r in tune.label_thresholds(counted).collect()} == {"x": 0.8, "y": 1.0}
    assert {r.label: r.sweetspot for r in tune.sweet_spot(counted).collect()} == {"x": pytest.approx(0.85), "y": None}


def test_self_correction_only_takes_positive_weights(spark):
    lex = spark.createDataFrame([("a", "x", 2.0), ("b", "x", -2.0), ("c", "x", 1.0)], "token string, label string, weight double")
    errors = spark.createDataFrame([("x", "a", -1), ("x", "b", -1), ("x", "c", 3)], "label string, token string, err long")
    assert {r.token: r.weight for r in tune.self_correct(lex, errors).collect()} == {"a": 0.0, "b": -2.0, "c": 1.0}
    assert tune.removed_words(lex, errors).first()["removed"] == 1


def test_training_range(example):
    docs, _, gold = example
    rows = tune.create_and_tune_range(docs, docs, gold, 0.5, 0.3, 0.2, rounds=1).collect()
    assert [r.threshold for r in rows] == [0.5, 0.3] and all(r.j == 1.0 for r in rows)


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (T.strip_mentions, "I am ok @bob rt @al yes", "I am ok yes"),
        (T.split_emojis, "so happy\U0001f602!", "so happy \U0001f602 !"),
        (T.shaddas, "mud~o", "mudd"), (T.shaddas, "~a~~", "~aaa"), (T.matchable, ">o<&a", "OIWa"), (T.collapse_repeats, "aabbbc", "abc"),
        (T.tokens, "RT @al I cannot? go, ok", ["rt", "i", "can", "not", "?", "go", "ok"]), (T.tokens, None, []), (T.tokens, " \n", []),
        (lambda c: T.bigrams(F.split(c, " ")), "a b c", ["a", "b", "a-b", "c", "b-c"]), (T.clean_line, " a=b\\nc ", "ab c"),
        (lambda c: T.joined_scores(F.array(F.lit(1.005), F.lit(-0.001))), "", "1.01\t0.00"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


def test_buckwalter_round_trip(spark):
    assert one(spark, lambda c: T.to_buckwalter(T.to_arabic(c)), T.BUCKWALTER) == T.BUCKWALTER and len(T.ARABIC) == len(T.BUCKWALTER)


# ------------------------------------------------------------------ duplicates


def brute_cost(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] if x == y else 10**9))
        row = new
    return row[-1]


def test_alignment_cost():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        real = brute_cost(a, b)
        for most in (0, 2, 3):
            assert duplicates.alignment_cost(a, b, most) == (real if real <= most else most + 1)


def test_near_duplicates_are_the_sequential_fold(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        words = [rng.choice("abcd") for _ in range(rng.choice([1, 3, 4]))] + ["tail"] * rng.choice([0, 1])
        rows.append((i, " ".join(words)))
    tokens = {i: t.split() for i, t in rows}
    groups, head = {}, None
    for i in sorted(tokens, key=lambda i: (tokens[i], i)):
        if head is None or not (tokens[head] == tokens[i] or brute_cost(tokens[head], tokens[i]) == 2):
            head = i
        groups[i] = head
    got = duplicates.near(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.group_id for r in got} == groups
    kept = {r.group_id: r.doc_id for r in got if r.kept}
    for head, members in itertools.groupby(sorted(groups, key=lambda i: (groups[i], i)), key=groups.get):
        members = list(members)
        assert kept[head] == min(members, key=lambda i: (-len(set(tokens[i])), i))


def test_exact_duplicates(spark):
    docs = spark.createDataFrame([(3, "A b."), (1, "a  b"), (2, "c"), (5, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: (r.kept_id, r.copies) for r in duplicates.exact(docs).collect()} == {3: (1, 2), 1: (1, 2), 2: (2, 1), 4: (4, 2), 5: (4, 2)}
    assert duplicates.exact(docs.limit(0)).count() == 0 and duplicates.near(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ LSA


def test_svd_reconstructs_the_matrix(spark):
    rng = np.random.default_rng(0)
    m = rng.random((6, 4)) * (rng.random((6, 4)) < 0.7)
    rows = spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i in range(6) for j in range(4) if m[i, j]], "doc_id long, token string, w double")
    index = lsa.term_index(rows)
    made = lsa.factors(rows, index)
    assert np.allclose(made.s, np.linalg.svd(m)[1])
    back = {(r.doc_id, r.token): r.w for r in lsa.reconstruct(made, index, 1e-9).collect()}
    assert all(abs(back.get((i, f"t{j}"), 0.0) - m[i, j]) < 1e-9 for i in range(6) for j in range(4))
    low = lsa.prune(made, first=2)
    assert np.allclose(low.s[2:], 0) and np.allclose(low.s[:2], made.s[:2])
    u, s, v = np.linalg.svd(m, full_matrices=False)
    want = (u[:, :2] * s[:2]) @ v[:2]
    got = {(r.doc_id, r.token): r for r in lsa.compare(rows, lsa.reconstruct(low, index, 0.01), 0.01).collect()}
    assert {k for k in got} == {(i, f"t{j}") for i in range(6) for j in range(4) if want[i, j] > 0.01}
    assert all((r.star == "*") == (m[r.doc_id, int(r.token[1])] < 0.01) for r in got.values())


# ------------------------------------------------------------------ morphology, sources, sinks, service


def test_analyses():
    assert morphology.analyse("EtAk", "VB") is not None
    found = dict(morphology.analyse("wsyktbwnh", "VB"))
    assert found["VCONJ"] == "w" and found["FUT"] == "s" and found["VSTEM"] == "ktb" and found["PERSON"] == "wn" and found["PRON1"] == "h"
    # An n of the present tense needs three letters other than A, w and y after it, so this is the past tense.
    assert dict(morphology.analyse("nwyt", "VB"))["VSTEM"] == "nwy" and dict(morphology.analyse("nwyt", "VB"))["PERSON"] == "t"
    assert morphology.analyse("", "NN") is None


LETTERS = "AbtvjHxd*rzs$SDTZEg_fqklmnhwyYFNKaui~o`{'|>&<}p"


def test_segments_spell_the_word():
    rng = random.Random(3)
    cut = 0
    for n in range(6000):
        letters = "wfbklAmntysrhdqEo" if n % 2 else LETTERS
        word = "".join(rng.choice(letters) for _ in range(rng.randint(0, 10)))
        parts = morphology.segments(word)
        assert "".join(parts) == word
        cut += len(parts) > 1
    assert cut > 500
    assert [morphology.segments(w) for w in ("hello", ">", "&", "oo", "<o", "")] == [["hello"], [">"], ["&"], ["oo"], ["<o"], [""]]


def independent(word, rule, groups):
    """analyse() by another regular expression engine, from the grammar spelled out by another means: names are replaced one at a time until none is left."""
    regex = pytest.importorskip("regex")
    text = f"^{morphology.GRAMMAR[rule]}$"
    while found := next((m for m in regex.finditer(r"(#?)([A-Z][A-Z0-9_]*)", text) if m[2] in morphology.GRAMMAR and text[m.start() - 1 : m.start()] not in ("<", "(?P<") and text[max(0, m.start() - 2) : m.start()] != "P<"), None):
        body = morphology.GRAMMAR[found[2]]
        text = text[: found.start()] + (f"({body})" if found[1] else f"(?P<{found[2]}>{body})") + text[found.end() :]
    text = "".join(text.split(" "))
    m = ENGINE.setdefault(rule, regex.compile(text)).match("".join({">": "O", "<": "I", "&": "W", "o": ""}.get(c, c) for c in word))
    return None if m is None else [(t, m.groupdict()[t]) for t in groups[rule] if m.groupdict().get(t) is not None]


ENGINE = {}


def test_analyses_by_another_engine():
    rng = random.Random(8)
    matched = 0
    for n in range(1500):
        letters = LETTERS if n % 3 == 0 else "wfbklAmntysrhdqE"
        word = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        for rule in ("NN", "VB"):
            for groups in (morphology.STANDARD, morphology.STEMMING):
                want = independent(word, rule, groups)
                assert morphology.analyse(word, rule, groups) == want, word
                matched += want is not None
    assert matched > 1000


def test_columns_of_the_grammar(spark):
    words = spark.createDataFrame([("wsyktbwnh",), (None,), ("o",)], "w string")
    row = words.select(morphology.lookup(F.col("w"), "VB").alias("a"), morphology.stem_word(F.col("w")).alias("s")).collect()
    assert row[0].a[0].tag == "VCONJ" and row[1].a is None and row[1].s is None and row[2].s == ["o"]
    shown = words.limit(1).select(morphology.in_script(morphology.lookup(F.col("w"), "VB")).alias("x")).first()["x"]
    assert shown.startswith("و/VCONJ س/FUT ي/IV كتب/VSTEM")
    text = spark.createDataFrame([("وسيكتبونه",)], "t string").select(morphology.stem_text(F.col("t")).alias("x")).first()["x"]
    assert text.replace(" ", "") == "وسيكتبونه" and " " in text
    same = spark.createDataFrame([("أكل",), ("وأكلهم إلى",)], "t string").select(F.replace(morphology.stem_text(F.col("t")), F.lit(" "), F.lit("")).alias("x")).collect()
    assert [r.x for r in same] == ["أكل", "وأكلهمإلى"]


def test_agreement_classes(spark):
    pair = "array<struct<tag:string,form:string>>"
    rows = [("x", "ab", [("NSTEM", "ab")], ["ab"]), ("x", "cd", None, []), ("x", "ef", None, ["e+f"]), ("x", "gh", [("NSTEM", "gh")], []), ("x", "ij", [("NSTEM", "ij")], ["i+j"]), ("kl", "kl", None, []), ("x", "m", None, [])]
    table = spark.createDataFrame(rows, f"form string, bw string, analysis {pair}, others array<string>")
    assert {r.bw: r.colour for r in morphology.agreement(table).collect()} == {"ab": "BLACK", "cd": "PURPLE", "ef": "GREEN", "gh": "BLUE", "ij": "RED"}
    shown = spark.createDataFrame([([("DET", "l"), ("NSTEM", "ktb"), ("CASE", "A"), ("PRON", "")],)], f"a {pair}").select(morphology.plain(F.col("a")).alias("x"))
    assert shown.first()["x"] == "l+ktb+AF"


def test_pair_matching(spark):
    pairs = spark.createDataFrame([(("A", "x"), ("A", "x")), (("A", "x"), ("???", "x")), (("A", "x"), ("A", "???")), (("A", "x"), ("B", "x")), (("A", "x"), ("A", "y"))], "a struct<tag:string,form:string>, b struct<tag:string,form:string>")
    assert [r.x for r in pairs.select(morphology.matches(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, True, None, False]


def test_labelled_tsv(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("id\ttext\tjoy\tsad\n\n1\t=hi @bob you\\nthere\t1\t0\n2\tso\U0001f602\t0\t1\n", encoding="utf-8")
    rows, labels = corpora.labelled_tsv(spark, f"file://{tmp_path}/c.tsv")
    assert labels == ["joy", "sad"] and [(r.doc_id, r.text, r.gs) for r in rows.collect()] == [("1", "hi you there", [1, 0]), ("2", "so \U0001f602", [0, 1])]
    assert sorted(map(tuple, corpora.gold_of(rows, labels).collect())) == [("1", "joy", 1), ("1", "sad", 0), ("2", "joy", 0), ("2", "sad", 1)]


def test_corpus_folders(spark, tmp_path):
    assert corpora.language_of(corpora.CORPORA["AR", "dev"]) == "AR" and corpora.language_of("/data/Raw/EN/x.csv") == "EN" and corpora.language_of("x.csv") is None
    rows = spark.createDataFrame([(1, "a\tb\nc", 1), (2, None, 0)], "doc_id long, text string, x int").repartition(2)
    corpora.write_tsv(rows, f"file://{tmp_path}/t", ["x"])
    got, labels = corpora.labelled_tsv(spark, f"file://{tmp_path}/t", labels=["x"])
    assert labels == ["x"] and sorted(map(tuple, got.collect())) == [("1", "a b c", [1]), ("2", "", [0])]


def test_evaluation(example):
    docs, tok, gold = example
    made = classify.evaluate(docs, tok, lexicon.learn(tok, gold), gold, 0.5)
    assert made["measures"].first() == (1.0, 1.0, 1.0, 1.0) and made["report"].count() == 12
    assert classify.evaluate(docs, tok, lexicon.learn(tok, gold), gold, 0.5, "sad")["report"].count() == 4
    assert {r.cnt for r in lexicon.label_counts(tok, gold, first=1).where("token = 'happy'").collect()} == {2}


def test_gold_standard(spark, tmp_path):
    (tmp_path / "g.csv").write_text("head\nhead\nمُدّ,NN\nمُدّ,NN\nك,XX\nكتب,VBD\nكتب\n", encoding="utf-8")
    gold = corpora.gold_standard(spark, f"file://{tmp_path}/g.csv")
    assert sorted((r.tag, r.bw) for r in gold.collect()) == [("NN", "mudd"), ("VBD", "ktb")]
    done = morphology.lookup_all(gold).collect()
    assert [(r.tag, r.source) for r in done] == [("NN", "main")]
    assert morphology.show(morphology.lookup_all(gold), most=1).count() == 1
    assert morphology.show_index(morphology.index_by_segment(morphology.lookup_all(gold))).count() > 0


def test_workbook(spark, tmp_path):
    import zipfile

    rows = spark.createDataFrame([("a<b", 1, "RED"), ("c", 2, "BLACK"), (None, 3, "other")], "x string, n int, colour string")
    assert reports.write_xlsx(rows, str(tmp_path / "r.xlsx"), drop=("BLACK",)) == 2
    sheet = zipfile.ZipFile(tmp_path / "r.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "a&lt;b" in sheet and ">c<" not in sheet
    with pytest.raises(ValueError):
        reports.write_xlsx(rows, str(tmp_path / "s.xlsx"), most=2)
    assert [(r.line, r.cells, r.colours) for r in workbooks.read(spark, str(tmp_path / "r.xlsx")).collect()] == [(0, ["a<b", "1"], ["RED"] * 2), (1, ["", "3"], [None] * 2)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r.xlsx"]


def test_workbook_of_many_tasks(spark, tmp_path):
    rows = spark.range(500, numPartitions=7).select(F.array(F.col("id").cast("string"), F.lit("x\r\n&\t'\x01\U0001f602"), F.lit(None)).alias("cells"), F.array(F.lit("GREEN"), F.lit("none")).alias("colours"))
    path = f"file://{tmp_path}/many.xlsx"
    workbooks.write(rows, path)
    got = workbooks.read(spark, path).collect()
    assert [(r.line, r.cells[0]) for r in got] == [(i, str(i)) for i in range(500)] and {(*r.cells[1:], *r.colours) for r in got} == {("x\r\n&\t'\ufffd\U0001f602", "", "GREEN", None, None)}
    workbooks.write(rows.limit(0), path)  # what was there is replaced
    assert workbooks.read(spark, path).count() == 0
    with pytest.raises(Exception, match="more than 100 rows"):
        workbooks.write(rows, f"file://{tmp_path}/more.xlsx", most=100)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["many.xlsx"]


def test_service_answers_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    got = []
    q = service.serve(service.file_requests(spark, f"file://{tmp_path}/in"), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), F.upper)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.value, r.answer) for r in got) == [("one", "ONE"), ("two", "TWO")]
    assert service.ask(spark, "é" * 600) == "é" * 512 and service.ask(spark, "x" * 1025) == "x" * 1024


def test_command_line(spark, capsys):
    from glyphloom import __main__ as cli

    real, cli.local_session = cli.local_session, lambda: spark
    try:
        assert cli.main(["--task", "identity", "ask", "some words"]) == "some words"
    finally:
        cli.local_session = real


def test_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\nid\ttext\tjoy\tsad\n1\thi\t1\t0\nid\ttext\tjoy\tsad\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("id\ttext\tfear\n2\tboo\t1\t1\n3\t\t0\n", encoding="utf-8")
    (tmp_path / "c.tsv").write_text("", encoding="utf-8")
    rows = corpora.labelled_files(spark, f"file://{tmp_path}")
    assert sorted((r.doc_id, r.text, r.gs, r.labels) for r in rows.collect()) == [("1", "hi", [1, 0], ["joy", "sad"]), ("2", "boo", [1, 1], ["fear"]), ("3", "", [0], ["fear"]), ("id", "text", [0, 0], ["joy", "sad"])]
    assert sorted(map(tuple, corpora.gold_of(rows.where("doc_id <> 'id'")).collect())) == [("1", "joy", 1), ("1", "sad", 0), ("2", "fear", 1), ("3", "fear", 0)]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    for name, n in (("x", 5000), ("y", 3), ("z", 0)):
        (tmp_path / name).write_text("".join(f"{name} {i} {'é' * (i % 90)}\n" for i in range(n)), encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = corpora.numbered_lines(spark, f"file://{tmp_path}").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 5003 and all(r.value.split(" ")[1] == str(r.n) and r.file.endswith(r.value[0]) for r in rows)


def test_arabic_corpus(spark, tmp_path):
    (tmp_path / "ar.tsv").write_text("id\ttext\tjoy\n1\t@a وسيكتبونه_مُدّ.. ok\U0001f602\t1\n2\t\t0\n", encoding="utf-8")
    rows, labels = corpora.labelled_tsv(spark, f"file://{tmp_path}/ar.tsv", arabic=True)
    tokens = features.tokens(rows, morphology.tokens)
    want = [s for w in ("wsyktbwnh", "mud~", "ok", "\U0001f602") for s in morphology.segments(w)]
    assert labels == ["joy"] and [r.token for r in tokens.orderBy("doc_id", "pos").collect()] == want
    assert {(r.token, r.n) for r in features.counts(rows, morphology.tokens).collect()} == {(t, want.count(t)) for t in want}


def test_report_lines(spark, example):
    docs, tok, gold = example
    lex = lexicon.learn(tok, gold)
    names = sorted(r.label for r in gold.select("label").distinct().collect())
    said = classify.decide(classify.scores(docs, features.term_counts(tok), lex), 0.5)
    rows = classify.report_lines(docs, tok, lex, said, gold, names, arabic=True).collect()
    assert len(rows) == 4 * docs.count() and {r.line for r in rows} == {0, 1, 2, 3}
    for r in rows:
        assert len(r.cells) == len(r.colours) == len(names) + (r.line == 0)
        assert r.line == 3 or all(":" in c or not c for c in r.cells[: len(names)])


def test_numbers_of_emoji_stay_when_a_corpus_comes(spark):
    first = spark.createDataFrame([(1, 0, "\U0001f602"), (1, 1, "w"), (2, 0, "\U0001f600")], "doc_id long, pos int, token string")
    later = spark.createDataFrame([(5, 0, "\U0001f601"), (5, 1, "\U0001f602"), (6, 0, "\U0001f603")], "doc_id long, pos int, token string")
    known = features.emoji_surrogates(first)
    both = features.more_surrogates(known, later)
    assert {r.emoji: r.surrogate for r in both.collect()} == {"\U0001f602": "eMJ0", "\U0001f600": "eMJ1", "\U0001f601": "eMJ2", "\U0001f603": "eMJ3"}
    assert features.more_surrogates(both, first).count() == 4 and features.more_surrogates(known.limit(0), later).count() == 3


def test_runs_say_what_they_did(spark, tmp_path, caplog):
    rows = spark.range(1000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("x"))
    with caplog.at_level("INFO", "glyphloom.runs"):
        seen = measure.timed(rows, "test", f"file://{tmp_path}/out", known=F.count("x"), most=F.max("x"))
    assert (seen["rows"], seen["known"], seen["most"]) == (1000, 250, 996) and seen["rows_per_second"] > 0 and "known=250" in caplog.text
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1000 and measure.timed(rows.limit(0))["rows"] == 0


def test_starts_together_are_starts_apart(spark, example):
    docs, tok, gold = example
    counts, lex = features.term_counts(tok), lexicon.learn(tok, gold)
    starts = [0.9, 0.5, 0.1]
    both = tune.Tuning(docs, counts, gold, lex, starts).run(2)
    for i, t in enumerate(starts):
        # One start by itself, each round scored anew with the lexicon as it is by then.
        now, own = t, lex
        for _ in range(2):
            own = tune.corrected(docs, counts, gold, own, now)[0]
            now = tune.label_thresholds(tune.swept(classify.scores(docs, counts, own), gold, tune.grid(spark)))
        assert sorted(map(tuple, both.lexicon(i).collect())) == sorted(map(tuple, own.select("token", "label", "weight").collect()))
        assert sorted(map(tuple, both.limits(i).collect())) == sorted(map(tuple, now.collect()))
        want = classify.prfj(classify.confusion(classify.decide(classify.scores(docs, counts, own), now), gold)).first()
        assert tuple(both.tested(docs, counts, gold).where(F.col("start") == i).first())[1:] == tuple(want)


def test_starts_come_to_sums_that_are_made_once(spark):
    docs = spark.createDataFrame([(i, "good day" if i % 2 else "bad day") for i in range(40)], "doc_id long, text string")
    gs = docs.select("doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("label")).withColumn("gs", ((F.col("doc_id") % 2 == 0) == (F.col("label") == "a")).cast("int"))
    counts = features.counts(docs)
    made, plans, real = None, [], tune.written
    tune.written = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name)
    try:
        made = tune.Tuning(docs, counts, gs, lexicon.learn(counts, gs), [0.1, 0.5, 0.9])
    finally:
        tune.written = real
    assert made.scored.count() == 3 * 40
    assert not any("CartesianProduct" in p for p in plans)


def test_tokens_of_texts_with_and_without_what_a_step_looks_for(spark):
    texts = ["plain words", "&amp x&lt y", "rt @bob hi", "größe é", "aāb", "\U0001f602x @y &z ā", "a@=b", "=@ x", "x=&y", "rt\n@a b", "", None]
    plain = lambda t: T.pieces(F.lower(F.regexp_replace(F.regexp_replace(F.replace(F.replace(F.coalesce(t, F.lit("")), F.lit("=")), F.lit("\\n"), F.lit(" ")), T.BEYOND_LATIN, " $1 "), rf"(rt{T.SPACE}*)?@{T.SOLID}+", "")))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t")).alias("a"), plain(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
