"""Operator 1: a regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian over the same statistics. Its covariance is shrunk towards its own diagonal and a small multiple of the pooled
variances, so that it is positive definite whatever the sample; a score is the logistic of the difference of the two log densities,
which are Mahalanobis distances. The Cholesky factors are computed once and kept with their inverses, so that a batch of documents is one
product with a triangular matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_sums, slices, small_batches, span_hash, text_buffers, word_bounds, written

#: The statistics of a document, in this order.
NAMES = ("upper", "symbols", "exclaimed", "digits", "bare_words", "ended_words", "word_length", "stuttered", "repeated_words", "repeated_pairs")
#: Words of a typical text that every document's counts are mixed with: ratios of short texts stay near what is usual.
PRIOR_WORDS = 40.0

_KIND = np.zeros(256, np.uint8)  # 0: letters and bytes beyond ASCII
_KIND[list(range(0x30, 0x3A))] = 1
_KIND[[0x20, *range(0x09, 0x0E)]] = 2
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 3
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-?()"]] = 4


def _per(mask: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How often mask is true between consecutive cuts."""
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[cuts])


def _repeats(keys: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each document, how many of its keys are not the first of their kind in it."""
    order = np.argsort(keys ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    k, d = keys[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[1:][same], minlength=docs).astype(np.float64)


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of NAMES for each document; empty texts have those of the prior alone."""
    docs = len(offs) - 1
    starts, ends, first = word_bounds(buf, offs)
    n = np.diff(first).astype(np.float64)
    kind = _KIND[buf]
    symbols, bang, digits = _per(kind == 4, offs), _per(buf == 33, offs), _per(kind == 1, offs)
    size = np.bincount(np.repeat(np.arange(docs), np.diff(first)), weights=ends - starts, minlength=docs)
    doc = np.repeat(np.arange(docs), np.diff(first))
    if len(starts):
        telling = np.concatenate([[0], np.cumsum(kind <= 1, dtype=np.int64)])
        capital = np.append((buf >= 65) & (buf <= 90), False)
        upper = _per(capital[np.minimum(starts + 1, ends - 1)] & capital[ends - 1 - (kind[ends - 1] >= 3) * (ends - starts > 1)], first)
        bare = _per(telling[ends] == telling[starts], first)
        ended = _per(kind[ends - 1] >= 3, first)
        low = buf | np.where((buf >= 65) & (buf <= 90), np.uint8(32), np.uint8(0))
        word = span_hash(byte_sums(low), starts, ends)
        stutter = np.zeros(len(word), bool)
        stutter[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        stutter = _per(stutter, first)
        pair = word[1:] + word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        inner = doc[1:] == doc[:-1]
        again, again2 = _repeats(word, doc, docs), _repeats(pair[inner], doc[1:][inner], docs)
    else:
        upper = bare = ended = stutter = again = again2 = np.zeros(docs)
    p = PRIOR_WORDS
    share = lambda x, of, usual: np.log((x + usual * p) / (of + p))
    return np.column_stack(
        [
            share(upper, n, 0.02), share(symbols, n, 0.02), share(bang, n, 0.02), share(digits, n, 0.05), share(bare, n, 0.02),
            share(ended, n, 0.12), np.log((size + 5.5 * p) / (n + p)), share(stutter, n, 0.01),
            share(again, n * np.log(n + 2) / 8, 0.2), share(again2, n, 0.02),
        ]
    )


def inverse_of_lower(factor: np.ndarray) -> np.ndarray:
    """By forward substitution."""
    made = np.zeros_like(factor)
    for i in range(len(factor)):
        made[i, i] = 1.0
        made[i] = (made[i] - factor[i, :i] @ made[:i]) / factor[i, i]
    return made


@dataclass
class Discriminant:
    means: np.ndarray  # class, statistic
    factors: list[np.ndarray]  # lower Cholesky factors
    whiteners: list[np.ndarray]  # their inverses, lower too
    log_det: np.ndarray
    log_prior: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for c in (0, 1):
            z = self.whiteners[c] @ (rows - self.means[c]).T
            out.append(self.log_prior[c] - 0.5 * (self.log_det[c] + (z * z).sum(axis=0)))
        return out[1] - out[0]

    def scores(self, rows: np.ndarray, temper: float = 1.0) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(rows) * temper, -500, 500)))


def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = 0.1, floor: float = 0.05) -> Discriminant:
    """From each class's count, sums and sums of products. A class without rows takes the other's place with a very small prior."""
    k = sums.shape[1]
    total = max(counts.sum(), 1)
    centre = sums.sum(axis=0) / total
    pooled = np.maximum(np.diag(squares.sum(axis=0)) / total - centre**2, 1e-6)
    means, factors, dets = np.zeros((2, k)), [], np.zeros(2)
    for c in (0, 1):
        if counts[c] > 0:
            means[c] = sums[c] / counts[c]
            cov = squares[c] / counts[c] - np.outer(means[c], means[c])
        else:
            means[c], cov = centre, np.diag(pooled)
        alpha = min(1.0, shrink + k / (counts[c] + k))
        cov = (1 - alpha) * cov + alpha * np.diag(np.maximum(np.diag(cov), 0)) + floor * np.diag(pooled)
        factors.append(np.linalg.cholesky(cov))
        dets[c] = 2 * np.log(np.diag(factors[c])).sum()
    return Discriminant(means, factors, [inverse_of_lower(x) for x in factors], dets, np.log((counts + 0.5) / (total + 1)))


def _table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = statistics(*text_buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(np.ascontiguousarray(c)) for c in rows.T]], names=["doc_id", *NAMES])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and a double column for each of NAMES: one row per row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_table, ", ".join(["doc_id long", *[f"{x} double" for x in NAMES]]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: a fifth of all, by the crc32 of the doc_id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(table: DataFrame, labels: DataFrame, label: str = "quality", **law: float) -> Discriminant:
    """From features() and all rows of labels (doc_id, label) that aren't held out: a sum for each pair of statistics and class, so nothing is sampled.

    Labels other than 0 and 1 and null doc_ids teach nothing; a doc_id that is labelled twice counts twice.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    k = len(NAMES)
    cells = [F.count(F.lit(1))] + [F.sum(x) for x in NAMES] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])) for i in range(k) for j in range(i + 1)]
    found = table.join(known, "doc_id").groupBy("y").agg(F.array(*[c.cast("double") for c in cells]).alias("m")).collect()  # two rows
    counts, sums, squares = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for row in found:
        m = np.array(row["m"])
        counts[row["y"]], sums[row["y"]] = m[0], m[1 : 1 + k]
        low = np.tril_indices(k)
        squares[row["y"]][low] = m[1 + k :]
        squares[row["y"]] = squares[row["y"]] + np.tril(squares[row["y"]], -1).T
    return fit(counts, sums, squares, **law)


def score(table: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of features()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.scores(np.column_stack([batch.column(x).to_numpy(zero_copy_only=False) for x in NAMES]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    made = table.mapInArrow(run, "doc_id long, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """score() of docs (doc_id, text) by a model of labels: the texts are read once.

    Null and empty texts score as the prior's statistics do; very long ones are read whole, alone in their slice. Equal texts score alike.
    Without any label all scores are 0.5. No rows give no rows. Rows stay as they are, repeated ones and null doc_ids too (these are never held out). Other columns are no input.
    """
    table = written(features(docs), "statistics")
    return score(table, train(table, labels, label), threshold)


def filtered(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose texts score below the threshold, with docs' columns; the second reading of the texts needs no shuffle.

    Equal texts stay or go together, whatever their number; null and empty ones score as the prior does, and texts of any length are scored whole.
    """
    model = train(written(features(docs), "statistics"), labels, label)

    @F.arrow_udf("boolean")
    def keeps(text: pa.Array) -> pa.Array:
        out = [np.zeros(0, bool)]
        for part in slices(iter([pa.RecordBatch.from_arrays([text], names=["text"])])):
            out.append(model.scores(statistics(*text_buffers(part.column("text")))) >= threshold)
        return pa.array(np.concatenate(out))

    return docs.where(keeps(F.coalesce(F.col("text").cast("string"), F.lit(""))))
