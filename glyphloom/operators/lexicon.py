"""Word-by-label weights from counts in labelled documents.

A lexicon is (token, label, weight) with weights rounded to PLACES, so that sums over documents are exact decimals in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions import text as T

from . import features

PLACES = 6
KINDS = ("TFIDF", "DIST", "FULL")


def label_counts(tok: DataFrame, gs: DataFrame, first: int | None = None) -> DataFrame:
    """label, token, cnt: occurrences in documents with the label, of the `first` documents by doc_id if that is given; an emoji, or its surrogate, counts twice."""
    if first is not None:
        gs = gs.join(gs.select("doc_id").distinct().orderBy("doc_id").limit(first), "doc_id", "left_semi")
    rows = features.postings(tok, gs)
    return rows.groupBy("label", "token").agg(F.sum(F.col("n") * F.when(T.is_emoji(F.col("token")) | T.is_surrogate(F.col("token")), 2).otherwise(1)).alias("cnt"))


def label_totals(counts: DataFrame) -> DataFrame:
    """label, token, cnt with a row of null token for each label's total and one of null label for all."""
    return counts.rollup("label", "token").agg(F.sum("cnt").alias("cnt"))


def top_words(tok: DataFrame, top: int | None) -> DataFrame:
    """token: the `top` vocabulary terms of most documents, ties by token; all where top is None."""
    words = features.vocabulary(tok).select("token", "df")
    return (words if top is None else words.orderBy(F.col("df").desc(), "token").limit(top)).select("token")


def weigh(grid: DataFrame, kind: str = "FULL") -> DataFrame:
    """token, label, weight of a grid (token, label, p) that has every label for each token.

    q is p over its sum; DIST takes away the mean of q, and FULL multiplies that by 1000 times its mean absolute value. Tokens without any p go.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    word = Window.partitionBy("token")
    q = grid.withColumn("all", F.sum("p").over(word)).where("all > 0").withColumn("q", F.col("p") / F.col("all"))
    d = q.withColumn("d", F.col("q") - F.avg("q").over(word))
    weight = {"TFIDF": F.col("q"), "DIST": F.col("d"), "FULL": F.col("d") * (F.avg(F.abs("d")).over(word) * 1000.0)}[kind]
    return d.select("token", "label", (F.round(weight, PLACES) + 0.0).alias("weight"))


def learn(tok: DataFrame, gs: DataFrame, top: int | None = 2500, kind: str = "FULL") -> DataFrame:
    """token, label, weight of the top words; a label's share of a word is its count over the label's total."""
    counts = label_counts(tok, gs)
    shares = counts.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("label"))).select("token", "label", "p")
    words, labels = top_words(tok, top), gs.select("label").distinct()
    # Labels are columns of the input, so the grid is as long as the words, times a constant.
    grid = words.crossJoin(F.broadcast(labels)).join(shares, ["token", "label"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return weigh(grid, kind)


def positive_mass(lex: DataFrame) -> DataFrame:
    """label, mass: the sum of the positive weights."""
    return lex.groupBy("label").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight").cast("decimal(28,6)")).otherwise(0)).cast("double").alias("mass"))


def balance(lex: DataFrame) -> DataFrame:
    """token, label, weight with equal positive mass for all labels: weight / (mass * labels / all mass), null without mass."""
    mass = positive_mass(lex).withColumn("share", F.col("mass") * F.count("*").over(Window.partitionBy()) / F.sum("mass").over(Window.partitionBy()))
    return lex.join(F.broadcast(mass), "label").select("token", "label", F.round(F.try_divide("weight", "share"), PLACES).alias("weight"))


def reciprocal_rank(lex: DataFrame) -> DataFrame:
    """token, label, score: 100 * (1 / (r + 1) - the least of these), r from 1 by falling weight, ties by token; the last has 0.

    A label's rank is counted over the whole lexicon; words are bounded by the lexicon's size.
    """
    label = Window.partitionBy("label")
    r = F.row_number().over(label.orderBy(F.col("weight").desc(), "token"))
    return lex.select("token", "label", F.round(100.0 * (1.0 / (r + 1) - 1.0 / (F.count("*").over(label) + 1)), PLACES).alias("score"))


def as_rows(lex: DataFrame, labels: list[str]) -> DataFrame:
    """token and one column for each label; a missing weight is 0."""
    wide = lex.groupBy("token").pivot("label", labels).agg(F.first("weight"))
    return wide.select("token", *[F.coalesce(F.col(f"`{x}`"), F.lit(0.0)).alias(x) for x in labels])


def as_columns(wide: DataFrame, labels: list[str]) -> DataFrame:
    """token, label, weight from as_rows()."""
    return wide.unpivot("token", labels, "label", "weight")


def extremes(lex: DataFrame) -> DataFrame:
    """label, heaviest, lightest: the words of the greatest and least weight, the first by token of equals."""
    return lex.groupBy("label").agg(
        F.min_by("token", F.struct((-F.col("weight")).alias("w"), "token")).alias("heaviest"), F.min_by("token", F.struct("weight", "token")).alias("lightest")
    )
