"""Documents' label scores from a lexicon, decisions, and how they compare with the given labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions import text as T

from . import features

def label_names(lex: DataFrame, labels: list[str] | None = None) -> list[str]:
    """The labels of a lexicon, which are columns of the corpus and so a few."""
    return labels if labels is not None else sorted(r["label"] for r in lex.select("label").distinct().collect())


def scores(docs: DataFrame, counts: DataFrame, lex: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """doc_id, label, s, m: s sums the weights of all occurrences in counts (doc_id, token, n), 0 where there are none; m is the document's greatest s.

    A word's weights are one row with a column for each label, so that a document's sums are one aggregate. Spark broadcasts the words where their size allows.
    """
    names = label_names(lex, labels)
    wide = lex.groupBy("token").agg(*[F.max(F.when(F.col("label") == x, F.col("weight").cast("decimal(18,6)"))).alias(f"w{i}") for i, x in enumerate(names)])
    sums = counts.join(wide, "token").groupBy("doc_id").agg(*[F.sum(F.col(f"w{i}") * F.col("n")).cast("double").alias(f"s{i}") for i in range(len(names))])
    rows = docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", *[F.coalesce(f"s{i}", F.lit(0.0)).alias(f"s{i}") for i in range(len(names))])
    each = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"s{i}").alias("s")) for i, x in enumerate(names)])
    most = F.array_max(F.array(*[F.col(f"s{i}") for i in range(len(names))]))
    return rows.select("doc_id", F.explode(each).alias("x"), most.alias("m")).select("doc_id", "x.label", "x.s", "m") if names else rows.select("doc_id", F.lit("").alias("label"), F.lit(0.0).alias("s"), F.lit(0.0).alias("m")).limit(0)


def decide(scored: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """doc_id, label, ratio, decision: s over m where m is positive, else 0; 1 where that reaches the threshold, one for all or a table (label, threshold)."""
    rows = scored.withColumn("threshold", F.lit(float(threshold))) if isinstance(threshold, int | float) else scored.join(F.broadcast(threshold), "label")
    ratio = F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0)
    return rows.select("doc_id", "label", ratio.alias("ratio"), ((F.col("m") > 0) & (ratio >= F.col("threshold"))).cast("int").alias("decision"))


def best_and_worst(docs: DataFrame, tok: DataFrame, lex: DataFrame) -> DataFrame:
    """doc_id, label, best, worst: the token of the greatest positive weight and that of the least, the first of equals; null without one. Their weights are best_weight and worst_weight."""
    least = F.min(F.when(F.col("weight") > 0, F.struct((-F.col("weight")).alias("w"), "pos", "token")))
    rows = tok.join(lex, "token").groupBy("doc_id", "label").agg(least.alias("b"), F.min(F.struct("weight", "pos", "token")).alias("l"))
    rows = rows.select("doc_id", "label", F.col("b.token").alias("best"), F.col("l.token").alias("worst"), (-F.col("b.w")).alias("best_weight"), F.col("l.weight").alias("worst_weight"))
    return docs.select("doc_id").crossJoin(F.broadcast(lex.select("label").distinct())).join(rows, ["doc_id", "label"], "left")


def _hits(decision: Column, gs: Column) -> list[Column]:
    return [F.count_if((decision == a) & (gs == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))]


def confusion(decisions: DataFrame, gs: DataFrame, *more: str) -> DataFrame:
    """label (and `more` columns of decisions), tp, fp, fn, tn."""
    return decisions.join(gs, ["doc_id", "label"]).groupBy("label", *more).agg(*_hits(F.col("decision"), F.col("gs")))


def measures(right: Column, wrong: Column, missing: Column) -> list[Column]:
    """p, r, f, j; all are 0 where any has nothing to divide by."""
    p, r, j = F.try_divide(right, right + wrong), F.try_divide(right, right + missing), F.try_divide(right, right + wrong + missing)
    f = F.try_divide(2.0 * p * r, p + r)
    some = p.isNotNull() & r.isNotNull() & f.isNotNull() & j.isNotNull()
    return [F.when(some, F.round(x, 9)).otherwise(0.0).alias(n) for n, x in (("p", p), ("r", r), ("f", f), ("j", j))]


def prfj(counted: DataFrame, *by: str) -> DataFrame:
    """Micro precision, recall, F and Jaccard of confusion() rows, together or by columns."""
    sums = counted.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn")])
    return sums.select(*by, *measures(F.col("tp"), F.col("fp"), F.col("fn")))


def word_errors(counts: DataFrame, decisions: DataFrame, gs: DataFrame) -> DataFrame:
    """label, token, err: occurrences in documents that rightly got the label less those in documents that wrongly did."""
    sign = decisions.where("decision = 1").join(gs, ["doc_id", "label"]).select("doc_id", "label", F.when(F.col("gs") == 1, 1).otherwise(-1).alias("sign"))
    return counts.join(sign, "doc_id").groupBy("label", "token").agg(F.sum(F.col("n") * F.col("sign")).alias("err"))


def report(docs: DataFrame, tok: DataFrame, lex: DataFrame, decisions: DataFrame, gs: DataFrame) -> DataFrame:
    """doc_id, label, cell, colour, best, worst: what a reader's table shows of each decision. Right ones are green, wrong ones red, missed ones blue, others black."""
    return weighed_report(docs, tok, lex, decisions, gs).drop("best_weight", "worst_weight")


def weighed_report(docs: DataFrame, tok: DataFrame, lex: DataFrame, decisions: DataFrame, gs: DataFrame) -> DataFrame:
    """report() with best_weight and worst_weight."""
    rows = decisions.join(gs, ["doc_id", "label"]).join(best_and_worst(docs, tok, lex), ["doc_id", "label"])
    said, true = F.col("decision") == 1, F.col("gs") == 1
    colour = F.when(said & true, "GREEN").when(said, "RED").when(true, "BLUE").otherwise("BLACK")
    return rows.select("doc_id", "label", F.concat_ws(":", "label", T.fixed(F.col("ratio"), 2)).alias("cell"), colour.alias("colour"), "best", "worst", "best_weight", "worst_weight")


def report_lines(docs: DataFrame, tok: DataFrame, lex: DataFrame, decisions: DataFrame, gs: DataFrame, labels: list[str], arabic: bool = False) -> DataFrame:
    """doc_id, line, cells, colours: four lines for each document. Line 0 has a cell for each label, in the colour of its decision, and the document's tokens; 1 and 2 the best and the worst word of each label with its weight, empty where there is none; 3 is empty.

    Of an Arabic corpus words and tokens are shown in Arabic script. A line's cells are as many as the labels, and one more in line 0.
    """
    rows = weighed_report(docs, tok, lex, decisions, gs)
    worded = lambda word, weight: F.coalesce(F.concat_ws(":", T.displayed(F.col(word), arabic), F.when(F.col(word).isNotNull(), T.fixed(F.col(weight), 2))), F.lit(""))
    shown = rows.select("doc_id", "label", "cell", "colour", worded("best", "best_weight").alias("b"), worded("worst", "worst_weight").alias("w"))
    pick = lambda c: F.array(*[F.max(F.when(F.col("label") == x, F.col(c))) for x in labels]).alias(c)
    wide = shown.groupBy("doc_id").agg(*map(pick, ("cell", "colour", "b", "w")))
    said = tok.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("said"))
    said = said.withColumn("said", T.to_arabic(F.col("said")) if arabic else F.col("said"))
    wide = wide.join(said, "doc_id", "left")
    black = F.array_repeat(F.lit("BLACK"), len(labels))
    line = lambda n, cells, colours: F.struct(F.lit(n).alias("line"), cells.alias("cells"), colours.alias("colours"))
    first = line(0, F.concat("cell", F.array(F.coalesce("said", F.lit("")))), F.concat("colour", F.array(F.lit("BLACK"))))
    lines = F.array(first, line(1, F.col("b"), black), line(2, F.col("w"), black), line(3, F.array_repeat(F.lit(""), len(labels)), black))
    return wide.select("doc_id", F.inline(lines))


def evaluate(docs: DataFrame, tok: DataFrame, lex: DataFrame, gs: DataFrame, threshold: float | DataFrame, label: str | None = None) -> dict[str, DataFrame]:
    """measures (p, r, f, j), errors (label, token, err) and report of a lexicon on labelled documents; of one label if that is given, though ratios are to all."""
    counts = features.term_counts(tok)
    said = decide(scores(docs, counts, lex), threshold)
    said = said if label is None else said.where(F.col("label") == label)
    return {"measures": prfj(confusion(said, gs)), "errors": word_errors(counts, said, gs), "report": report(docs, tok, lex, said, gs)}
