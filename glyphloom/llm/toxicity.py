"""Operator 4: a counterfactually regularised toxicity classifier.

A text's features are its distinct tokens and their leading bytes, so that inflected forms count too. A logistic regression over all
features that tell the classes apart is fitted to labelled texts; for each of these that names a group of people, other texts name each
of the other groups instead, and the fit also pays for the squared differences of their scores before the logistic. A group's name alone
can then not make a text toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_sums, slices, small_batches, span_hash, text_buffers, written
from .quality import held_out

# Names of groups; each may stand for another one of its line.
IDENTITIES = (
    ("women", "men"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "citizens", "refugees"),
    ("disabled", "healthy"),
    ("young", "old"),
)
#: Labelled documents that a model is fitted to, at most. Its features are as many as they tell, so it is bounded too.
SAMPLE = 12_000
#: Leading bytes of a token that are features; 0 is the whole token.
PREFIXES = (0, 4, 5, 6)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tokens(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of PREFIXES: (doc, hash) of all tokens that are long enough."""
    n = len(buf)
    if not n:
        return
    inside = _TOKEN[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offs, starts, side="right") - 1
    sums = byte_sums(_LOWER[buf])
    for k in PREFIXES:
        if k:
            some = np.flatnonzero(ends - starts >= k)
            yield doc[some], span_hash(sums, starts[some], starts[some] + k) + np.uint64(k)
        else:
            yield doc, span_hash(sums, starts, ends)


def distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (doc, key) once, by doc."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return d[new], k[new]


@dataclass
class Model:
    keys: np.ndarray  # sorted uint64
    weights: np.ndarray
    bias: float

    def hits(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(doc, feature) of the features in each document, each once."""
        gate = np.zeros(1 << 20, bool)
        gate[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for doc, key in tokens(buf, offs):
            some = np.flatnonzero(gate[(key >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, key[some]), max(0, len(self.keys) - 1))
            real = self.keys[at] == key[some] if len(self.keys) else np.zeros(len(some), bool)
            docs.append(doc[some][real])
            found.append(at[real])
        return distinct(np.concatenate(docs), np.concatenate(found))

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, at = self.hits(buf, offs)
        z = self.bias + np.bincount(doc, weights=self.weights[at], minlength=len(offs) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def swapper(identities: tuple[tuple[str, ...], ...]):
    """A function of a text: the texts in which each group's name is replaced by the next one of its line, the one after that, and so on; none if it names none."""
    place = {name: (line, i) for line in identities for i, name in enumerate(line)}
    if not place:
        return lambda text: []
    names = re.compile(r"(?<![^\W_])(" + "|".join(sorted(map(re.escape, place), key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)

    def swap(text: str) -> list[str]:
        lines = [place[m.lower()][0] for m in names.findall(text)]

        def other(shift: int):
            def of(m: re.Match) -> str:
                line, i = place[m[0].lower()]
                return line[(i + 1 + shift % max(1, len(line) - 1)) % len(line)]

            return of

        return [names.sub(other(shift), text) for shift in range(max((len(x) for x in lines), default=1) - 1)]

    return swap


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=1 << 21):
        buf, offs = text_buffers(batch.column("text"))
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for doc, key in tokens(buf, offs):
            d, k = distinct(doc, key)
            keys, at = np.unique(k, return_inverse=True)
            ones = np.bincount(at, weights=y[d], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, minlength=len(keys)) - ones), pa.array(ones)], names=["key", "n0", "n1"])


def logistic(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], k: int, ridge: float, fairness: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of present features: log loss, averaged over each class and then over both, + ridge / 2 |w|^2 + fairness * mean squared score change over pairs, by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max(1.0, float(y.sum())), 0.5 / max(1.0, float((1 - y).sum())))
    flat = np.concatenate([np.zeros(0, np.int64), *rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    a = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in pairs], *[p[1] for p in pairs]])
    sign = np.concatenate([np.ones(sum(len(p[0]) for p in pairs)), -np.ones(sum(len(p[1]) for p in pairs))])
    of = np.concatenate([np.repeat(np.arange(len(pairs)), [len(p[i]) for p in pairs]) for i in (0, 1)]) if pairs else np.zeros(0, np.int64)
    m = max(1, len(pairs))
    # The largest curvature there can be, by power iteration, bounds the step.
    probe, curve = np.full(k + 1, 1 / np.sqrt(k + 1)), 1.0
    for _ in range(20):
        u = np.bincount(owner, weights=probe[:-1][flat], minlength=len(rows)) + probe[-1]
        d = np.bincount(of, weights=sign * probe[:-1][a], minlength=len(pairs))
        u = u * share / 4
        g = np.append(np.bincount(flat, weights=u[owner], minlength=k) + ridge * probe[:-1] + 2 * fairness / m * np.bincount(a, weights=sign * d[of], minlength=k), u.sum())
        curve = float(np.linalg.norm(g)) or 1.0
        probe = g / curve
    step = 1 / (1.1 * curve)
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        z = np.bincount(owner, weights=v[:-1][flat], minlength=len(rows)) + v[-1]
        r = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        d = np.bincount(of, weights=sign * v[:-1][a], minlength=len(pairs))
        g = np.append(np.bincount(flat, weights=r[owner], minlength=k) + ridge * v[:-1] + 2 * fairness / m * np.bincount(a, weights=sign * d[of], minlength=k), r.sum())
        new = v - step * g
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (last - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", identities: tuple[tuple[str, ...], ...] = IDENTITIES, fairness: float = 1.0,
    ridge: float = 1e-4, sample: int = SAMPLE, least_z: float = 3.0,
) -> Model:
    """A model of docs (doc_id, text) by labels (doc_id, label) that aren't held out: of the `sample` labelled doc_ids with the smallest hashes.

    Labels other than 0 and 1 and null doc_ids teach nothing, nor does a doc_id that is labelled both ways; one that is labelled the same way
    twice counts once. Of rows that repeat a doc_id the one whose text's hash is smallest teaches. So a model sees `sample` texts at most, each whole, however
    long. With labels of one kind, or none, the model has no features and scores their share.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    chosen = known.select("doc_id", "y").orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(sample)
    # The sample is at most `sample` rows of two numbers, so it may be broadcast; rows of one doc_id are combined before the shuffle.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    lessons = written(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(one), "lessons")
    totals = lessons.agg(F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("n0"), F.coalesce(F.sum("y"), F.lit(0)).alias("n1")).first()
    n0, n1 = float(totals["n0"]), float(totals["n1"])
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    if not n0 or not n1:
        return empty
    found = lessons.select("text", "y").mapInArrow(_counted, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p = (F.col("n0") + F.col("n1")) / (n0 + n1)
    z = (F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
    telling = found.where((F.col("n0") + F.col("n1") >= 3) & (p < 1)).select("key", z.alias("z")).where(F.abs("z") >= least_z).select("key")
    keys = np.sort(telling.toPandas()["key"].to_numpy(np.int64).view(np.uint64))  # of `sample` texts
    if not len(keys):
        return empty
    model, swap = Model(keys, np.zeros(len(keys)), 0.0), swapper(identities)

    def present(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def hits(texts: list[str]) -> list[np.ndarray]:
            doc, at = model.hits(*text_buffers(pa.array(texts, pa.string())))
            return np.split(at, np.searchsorted(doc, np.arange(1, len(texts)))) if texts else []

        for part in parts:
            for a in range(0, len(part), 500):
                some = part.iloc[a : a + 500]
                others = [swap(t) for t in some["text"]]
                again = iter(hits([t for each in others for t in each]))
                yield pd.DataFrame({"y": some["y"].to_numpy(), "own": hits(list(some["text"])), "others": [[next(again) for _ in each] for each in others]})

    rows = lessons.select("text", "y").mapInPandas(present, "y int, own array<int>, others array<array<int>>").toPandas()  # `sample` rows at most
    own = [np.asarray(x, np.int64) for x in rows["own"]]
    pairs = [(a, np.asarray(b, np.int64)) for a, each in zip(own, rows["others"], strict=True) for b in each]
    model.weights, model.bias = logistic(own, rows["y"].to_numpy(float), pairs, len(keys), ridge, fairness)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs (doc_id, text), from its whole text, however long. Null and empty texts get the score of no feature; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(*text_buffers(batch.column("text"))))], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, **law: object) -> DataFrame:
    """score() of docs by a model of labels. Rows stay as they are, repeated ones and null doc_ids too (these are never held out); equal texts score alike. Other columns are no input."""
    return score(docs, train(docs, labels, label, **law), threshold)
