import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphloom.llm import quality, toxicity
from glyphloom.llm.common import text_buffers
from glyphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    ones = labels.sum()
    return (rank[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def check_query(spark, name, label, threshold):
    got = QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert all(rows["held_out"] == [held(d) for d in rows["doc_id"]])
    assert all(rows["predicted"] == (rows["score"] >= threshold)) and rows["score"].between(0, 1).all()
    test = rows[rows["held_out"]]
    return area(test["score"].to_numpy(), test[label].to_numpy()), (test["predicted"] == test[label]).mean()


def test_quality_on_held_out_rows(spark):
    auc, right = check_query(spark, "op1_quality_qda", "quality", 0.3)
    assert auc > 0.99 and right > 0.98


def test_toxicity_on_held_out_rows(spark):
    auc, right = check_query(spark, "op4_counterfactual_toxicity", "toxic", 0.5)
    assert auc > 0.97 and right > 0.97


def test_discriminant_is_the_gaussian_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3)) + m for m in (0, 1)]
    model = quality.fit(np.array([500.0, 500.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]))
    rows = rng.normal(size=(20, 3))
    want = []
    for r in rows:
        density = []
        for c in (0, 1):
            cov = model.factors[c] @ model.factors[c].T
            d = r - model.means[c]
            density.append(model.log_prior[c] - 0.5 * (math.log(np.linalg.det(cov)) + d @ np.linalg.inv(cov) @ d))
        want.append(density[1] - density[0])
    assert np.allclose(model.log_odds(rows), want)


def test_fit_shrinks_as_the_docstring_says():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + m for n, m in ((300, 0), (40, 2))]
    model = quality.fit(np.array([300.0, 40.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), shrink=0.1, floor=0.05)
    pooled = np.diag(np.vstack(x).var(axis=0))
    for c, a in enumerate(x):
        alpha = 0.1 + 4 / (len(a) + 4)
        cov = np.cov(a.T, bias=True)
        assert np.allclose(model.factors[c] @ model.factors[c].T, (1 - alpha) * cov + alpha * np.diag(np.diag(cov)) + 0.05 * pooled)
        assert np.allclose(model.whiteners[c] @ model.factors[c], np.eye(4)) and np.allclose(model.means[c], a.mean(0))
    assert np.allclose(np.exp(model.log_prior), [300.5 / 341, 40.5 / 341])


def plain_statistics(text):
    """quality.statistics() of one text, word by word."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    end, letter = b".,;:'\"-?()", lambda b: 65 <= b <= 90
    sign = lambda b: 0x21 <= b < 0x7F and not chr(b).isalnum()
    n, p = len(words), 40.0
    counts = dict.fromkeys(("upper", "symbols", "bang", "digits", "bare", "ended", "stutter", "again", "again2"), 0)
    counts["symbols"] = sum(sign(b) and b not in end for b in raw)
    counts["bang"], counts["digits"] = raw.count(b"!"), sum(48 <= b < 58 for b in raw)
    low = [w.lower() for w in words]
    for i, w in enumerate(words):
        last = w[-2] if sign(w[-1]) and len(w) > 1 else w[-1]
        counts["upper"] += letter(w[min(1, len(w) - 1)]) and letter(last)
        counts["bare"] += all(sign(b) for b in w)
        counts["ended"] += sign(w[-1])
        counts["stutter"] += i > 0 and low[i] == low[i - 1]
    counts["again"] = n - len(set(low))
    counts["again2"] = max(0, n - 1) - len(set(zip(low, low[1:])))
    share = lambda x, of, usual: math.log((x + usual * p) / (of + p))
    c = counts
    return [
        share(c["upper"], n, 0.02), share(c["symbols"], n, 0.02), share(c["bang"], n, 0.02), share(c["digits"], n, 0.05), share(c["bare"], n, 0.02), share(c["ended"], n, 0.12),
        math.log((sum(map(len, words)) + 5.5 * p) / (n + p)), share(c["stutter"], n, 0.01), share(c["again"], n * math.log(n + 2) / 8, 0.2), share(c["again2"], n, 0.02),
    ]


def test_statistics_and_scores_against_brute_force(spark):
    """The whole of op1 by plain loops: statistics of all documents, class moments, shrunk covariances, densities."""
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = {i: np.array(plain_statistics(t)) for i, t in docs.items()}
    odd = ["A b c. d!!", "", None, "x x x x | |", "AB12 é ###", "NO WAY (really) it's 10,000 - ok?", "! !", "Über ÜBER"]
    assert np.allclose(quality.statistics(*text_buffers(pa.array(odd))), [plain_statistics(t) for t in odd])
    taught = {c: np.array([rows[i] for i, y in labels.items() if y == c and not held(i)]) for c in (0, 1)}
    pooled = np.diag(np.vstack(list(taught.values())).var(axis=0))
    total = sum(map(len, taught.values()))
    density = {}
    for c, a in taught.items():
        alpha, cov = min(1, 0.1 + 10 / (len(a) + 10)), np.cov(a.T, bias=True)
        cov = (1 - alpha) * cov + alpha * np.diag(np.diag(cov)) + 0.05 * pooled
        inverse, prior = np.linalg.inv(cov), math.log((len(a) + 0.5) / (total + 1)) - 0.5 * np.linalg.slogdet(cov)[1]
        density[c] = {i: prior - 0.5 * (x - a.mean(0)) @ inverse @ (x - a.mean(0)) for i, x in rows.items()}
    want = {i: 1 / (1 + math.exp(min(500, max(-500, density[0][i] - density[1][i])))) for i in rows}
    got = {r.doc_id: r.score for r in QUERIES["op1_quality_qda"](spark, d).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in want)


def test_statistics_are_those_of_each_text_alone():
    texts = ["A b c. d!!", "", None, "x x x x | |", "AB12 é ###", "one two one two"]
    together = quality.statistics(*text_buffers(pa.array(texts)))
    alone = [quality.statistics(*text_buffers(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(together, alone) and np.allclose(together[1], together[2])


def odd(spark):
    docs = [(1, None, "q"), (2, "", "q"), (2, "", "q"), (None, "fine words", "q"), (3, "w " * 60000, "q"), (4, "x", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, 7, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")


def test_odd_rows(spark):
    docs, labels = odd(spark)
    for f in (quality.classify, toxicity.classify):
        rows = f(docs, labels).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
        assert len({r.score for r in rows if r.doc_id == 2}) == 1
        assert f(docs.limit(0), labels).count() == 0 and f(docs, labels.limit(0)).count() == 6
    assert quality.filtered(docs, labels).columns == docs.columns


def test_filter_keeps_what_the_query_predicts(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    want = {r.doc_id for r in QUERIES["op1_quality_qda"](spark, d).where("predicted = 1").collect()}
    assert {r.doc_id for r in quality.filtered(docs, labels).collect()} == want


def test_identity_swap():
    swap = toxicity.swapper((("women", "men"), ("gay", "straight")))
    assert swap("Women and gay, men!") == ["men and straight, women!"] and swap("menu gayety") == []
    swap = toxicity.swapper((("a1", "b1", "c1", "d1"), ("x1", "y1")))
    assert swap("B1 or x1") == ["c1 or y1", "d1 or y1", "a1 or y1"] and toxicity.swapper(())("any") == []


def plain_features(text):
    """The distinct features of a text: lower-case tokens, and their leading bytes."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+", low)
    return {(k, t[:k] if k else t) for t in tokens for k in toxicity.PREFIXES if len(t) >= k}


def test_toxicity_model_against_brute_force(spark):
    """The whole of op4 but for the step rule: features, their choice, and that the weights minimise the objective as written out with dense matrices."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    taught = [(text[r.doc_id], r.toxic) for r in labels.collect() if not held(r.doc_id)]
    y = np.array([t for _, t in taught], float)
    has = [plain_features(t) for t, _ in taught]
    n1, n0 = y.sum(), len(y) - y.sum()
    counts = {f: (sum(1 for h, t in zip(has, y) if f in h and not t), sum(1 for h, t in zip(has, y) if f in h and t)) for f in set().union(*has)}
    chosen = []
    for f, (a, b) in counts.items():
        p = (a + b) / len(y)
        if a + b >= 3 and p < 1 and abs((b / n1 - a / n0) / math.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))) >= 3:
            chosen.append(f)
    assert len(model.keys) == len(chosen)
    key = {f: next(k for (_, k), size in zip(toxicity.tokens(*text_buffers(pa.array([f[1]], pa.binary()))), toxicity.PREFIXES) if size == f[0])[0] for f in chosen}
    assert sorted(key.values()) == model.keys.tolist()
    place = {f: int(np.searchsorted(model.keys, key[f])) for f in chosen}

    def row(t):
        made = np.zeros(len(chosen) + 1)
        made[[place[f] for f in plain_features(t) if f in place]] = 1
        made[-1] = 1
        return made

    swap = toxicity.swapper(toxicity.IDENTITIES)
    x = np.array([row(t) for t, _ in taught])
    change = np.array([row(t) - row(o) for t, _ in taught for o in swap(t)]).reshape(-1, len(chosen) + 1)
    share = np.where(y > 0, 0.5 / n1, 0.5 / n0)

    def objective(w):
        z = x @ w
        return (share * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-4 * (w[:-1] ** 2).sum() + (change @ w @ (change @ w)) / max(1, len(change))

    w = np.append(model.weights, model.bias)
    z = x @ w
    slope = x.T @ (share * (1 / (1 + np.exp(-z)) - y)) + np.append(1e-4 * w[:-1], 0) + 2 / max(1, len(change)) * change.T @ (change @ w)
    rng = np.random.default_rng(0)
    assert np.abs(slope).max() < 1e-3 and all(objective(w) < objective(w + 0.05 * rng.normal(size=len(w))) for _ in range(20))  # it is convex
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(math.isclose(got[i], 1 / (1 + math.exp(-float(row(t) @ w))), rel_tol=1e-9) for i, t in text.items())


def test_labels_and_rows_that_repeat_teach_once(spark):
    rows = [(i, f"word{i % 7} " + ("awful scum" if i % 3 == 0 else "fine"), int(i % 3 == 0)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.drop("toxic"), table.drop("text")
    one = toxicity.train(docs, labels)
    twice = toxicity.train(docs.unionAll(docs).unionAll(docs.where("doc_id = 3")), labels.unionAll(labels))
    assert one.keys.tolist() == twice.keys.tolist() and np.allclose(one.weights, twice.weights)


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    """A group's name stands mostly in toxic texts: without the penalty it makes a neutral text suspect."""
    rng = random.Random(0)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(1500):
        toxic = i % 3 == 0
        text = rng.sample(plain, 8) + (["scumbag"] if toxic and rng.random() < 0.7 else []) + (["gay"] if rng.random() < (0.7 if toxic else 0.05) else []) + (["straight"] if rng.random() < 0.1 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    probe = text_buffers(pa.array(["the gay neighbour", "the straight neighbour", "such a scumbag"]))
    free = toxicity.train(table.drop("toxic"), table.drop("text"), fairness=0.0).scores(*probe)
    fair = toxicity.train(table.drop("toxic"), table.drop("text"), fairness=5.0).scores(*probe)
    assert free[0] - free[1] > 0.2 and abs(fair[0] - fair[1]) < 0.1 and fair[0] < 0.5 < fair[2]


def test_equal_texts_score_alike(spark):
    d = "/root/testdata/sf0.01"
    for name in ("op1_quality_qda", "op4_counterfactual_toxicity"):
        rows = QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id")
        assert rows.groupBy("text").agg(F.countDistinct("score").alias("n")).where("n > 1").count() == 0
