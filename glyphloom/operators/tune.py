"""Thresholds and self-correction. Sums don't depend on thresholds, so a whole sweep is one scoring pass and a small grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.storage import written

from . import classify, features, lexicon


def grid_values(start: float = 1.0, end: float = 0.0, step: float = 0.1, closed: bool = False) -> list[float]:
    """start, less step, and so on while above end (closed: not below it); by repeated subtraction, whose rounding is part of the values."""
    values = []
    while start > end or closed and start >= end:
        values.append(start)
        start -= step
    return values


def grid(spark: SparkSession, *args: float) -> DataFrame:
    return spark.createDataFrame([(t,) for t in grid_values(*args)], "threshold double")


def swept(scored: DataFrame, gs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """label, threshold, tp, fp, fn, tn, for every threshold of the grid."""
    ratio = F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0)
    rows = scored.join(gs, ["doc_id", "label"]).select("label", "gs", "m", ratio.alias("ratio")).crossJoin(F.broadcast(thresholds))
    decision = ((F.col("m") > 0) & (F.col("ratio") >= F.col("threshold"))).cast("int")
    return rows.withColumn("decision", decision).groupBy("label", "threshold").agg(*classify._hits(F.col("decision"), F.col("gs")))


def label_thresholds(counted: DataFrame) -> DataFrame:
    """label, threshold: the highest of those with the best Jaccard; 1 where that is 0."""
    best = classify.prfj(counted, "label", "threshold").groupBy("label").agg(F.max(F.struct("j", "threshold")).alias("best"))
    return best.select("label", F.when(F.col("best.j") > 0, F.col("best.threshold")).otherwise(1.0).alias("threshold"))


def sweet_spot(counted: DataFrame) -> DataFrame:
    """label, sweetspot: from the top, halfway between the first threshold whose recall exceeds its precision and the one before it (1 before the first); null if none does."""
    order = Window.partitionBy("label").orderBy(F.col("threshold").desc())
    rows = classify.prfj(counted, "label", "threshold").withColumn("before", F.lag("threshold", 1, 1.0).over(order))
    spot = F.when(F.col("r") > F.col("p"), F.struct(F.col("threshold"), (F.col("threshold") + (F.col("before") - F.col("threshold")) / 2).alias("spot")))
    return rows.groupBy("label").agg(F.max(spot).getField("spot").alias("sweetspot"))


def self_correct(lex: DataFrame, errors: DataFrame) -> DataFrame:
    """lex with the positive weights of words whose error is negative set to 0."""
    wrong = (F.col("err") < 0) & (F.col("weight") > 0)
    return lex.join(errors, ["label", "token"], "left").select("token", "label", F.when(wrong, 0.0).otherwise(F.col("weight")).alias("weight"))


def removed_words(lex: DataFrame, errors: DataFrame) -> DataFrame:
    """removed: how many weights self_correct() sets to 0."""
    return lex.join(errors, ["label", "token"]).agg(F.count_if((F.col("err") < 0) & (F.col("weight") > 0)).alias("removed"))


def corrected(
    docs: DataFrame, counts: DataFrame, gs: DataFrame, lex: DataFrame, threshold: float | DataFrame, rounds: int = 1, labels: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(lexicon, removed): self_correct() in rounds, each on the decisions of the lexicon of the round before, and how many weights all rounds set to 0."""
    removed = None
    for _ in range(rounds):
        said = classify.decide(classify.scores(docs, counts, lex, labels), threshold)
        errors = written(classify.word_errors(counts, said, gs), "errors")
        taken = removed_words(lex, errors)
        removed = taken if removed is None else removed.unionAll(taken)
        lex = written(self_correct(lex, errors), "lexicon")
    none = lex.sparkSession.range(1).select(F.lit(0).cast("long").alias("removed"))
    return lex, (none if removed is None else removed).agg(F.sum("removed").alias("removed"))


class Tuning:
    """Corrections and thresholds of a lexicon from several starting thresholds at once, kept up by what changes.

    Sums, decisions and errors have a column for each label and a row for each start, so all starts share each pass. A round corrects the lexicon by the
    decisions at hand; from the sums only the weights that this takes are subtracted, in the documents that hold such words, and the thresholds are
    swept on the new sums, which the next round decides by. Weights and sums are decimals, so a sum less what was taken is the sum of what is left.
    Every table is written, and a round reads the counts twice.
    """

    def __init__(self, docs: DataFrame, counts: DataFrame, gs: DataFrame, lex: DataFrame, starts: list[float], labels: list[str] | None = None) -> None:
        self.spark, self.names = lex.sparkSession, classify.label_names(lex, labels)
        self.ids = range(len(self.names))
        weights = [F.coalesce(F.max(F.when(F.col("label") == x, F.col("weight").cast("decimal(18,6)"))), F.lit(0).cast("decimal(18,6)")).alias(f"w{i}") for i, x in enumerate(self.names)]
        self.words = written(lex.groupBy("token").agg(*weights), "words")
        self.starts = self.spark.createDataFrame([(i, float(t)) for i, t in enumerate(starts)], "start int, first double")
        self.marks = written(gs.groupBy("doc_id").agg(*[F.max(F.when(F.col("label") == x, F.col("gs"))).alias(f"g{i}") for i, x in enumerate(self.names)]), "marks")
        self.counts = self._known(counts)
        self.thresholds = self.starts.select("start", *[F.col("first").alias(f"t{i}") for i in self.ids])
        self.gone: DataFrame | None = None
        self.scored = self._sums(docs, self.counts)

    def _known(self, counts: DataFrame) -> DataFrame:
        """Only the lexicon's words score or can be corrected."""
        return written(counts.join(self.words.select("token"), "token", "left_semi").select("doc_id", "token", "n"), "counts")

    def _added(self, counts: DataFrame, weights: DataFrame, letter: str, *keys: str) -> DataFrame:
        return counts.join(weights, "token").groupBy(*keys, "doc_id").agg(*[F.sum(F.col(f"{letter}{i}") * F.col("n")).cast("decimal(32,6)").alias(f"a{i}") for i in self.ids])

    def _sums(self, docs: DataFrame, counts: DataFrame) -> DataFrame:
        """start, doc_id, s0, s1 ..: the sums of each label by the lexicon as it was learnt."""
        sums = docs.select("doc_id").join(self._added(counts, self.words, "w"), "doc_id", "left")
        zero = F.lit(0).cast("decimal(32,6)")
        # The starts come to the sums, which are made once, and not once for each part of the starts.
        return written(sums.select("doc_id", *[F.coalesce(f"a{i}", zero).alias(f"s{i}") for i in self.ids]).crossJoin(F.broadcast(self.starts.select("start"))), "scores")

    def _less(self, scored: DataFrame, counts: DataFrame, gone: DataFrame) -> DataFrame:
        """The sums without the weights that are gone."""
        taken = self._added(counts, gone, "r", "start")
        left = [(F.col(f"s{i}") - F.coalesce(f"a{i}", F.lit(0))).cast("decimal(32,6)").alias(f"s{i}") for i in self.ids]
        return written(scored.join(taken, ["start", "doc_id"], "left").select("start", "doc_id", *left), "scores")

    def _ratios(self, scored: DataFrame) -> DataFrame:
        """scored with m, the greatest sum, and q0, q1 ..: sums over m, 0 where that isn't positive."""
        most = F.array_max(F.array(*[F.col(f"s{i}").cast("double") for i in self.ids]))
        rows = scored.withColumn("m", most)
        return rows.select("*", *[F.when(F.col("m") > 0, F.col(f"s{i}").cast("double") / F.col("m")).otherwise(0.0).alias(f"q{i}") for i in self.ids])

    def correct(self) -> None:
        rows = self._ratios(self.scored).join(F.broadcast(self.thresholds), "start").join(self.marks, "doc_id")
        sign = [F.when((F.col("m") > 0) & (F.col(f"q{i}") >= F.col(f"t{i}")) & F.col(f"g{i}").isNotNull(), F.when(F.col(f"g{i}") == 1, 1).otherwise(-1)).otherwise(0).alias(f"e{i}") for i in self.ids]
        wrong = self.counts.join(rows.select("start", "doc_id", *sign), "doc_id").groupBy("start", "token").agg(*[F.sum(F.col("n") * F.col(f"e{i}")).alias(f"e{i}") for i in self.ids])
        met = wrong.join(self.words, "token")
        if self.gone is not None:
            met = met.join(self.gone.select("start", "token", *[F.col(f"r{i}").alias(f"z{i}") for i in self.ids]), ["start", "token"], "left")
        kept = lambda i: F.lit(True) if self.gone is None else F.coalesce(F.col(f"z{i}") == 0, F.lit(True))
        taken = [F.when((F.col(f"e{i}") < 0) & (F.col(f"w{i}") > 0) & kept(i), F.col(f"w{i}")).otherwise(0).cast("decimal(18,6)").alias(f"r{i}") for i in self.ids]
        some = F.greatest(*[F.col(f"r{i}") for i in self.ids], F.lit(0).cast("decimal(18,6)")) > 0
        fresh = written(met.select("start", "token", *taken).where(some), "taken")
        self.scored = self._less(self.scored, self.counts, fresh)
        both = fresh if self.gone is None else self.gone.unionByName(fresh)
        self.gone = written(both.groupBy("start", "token").agg(*[F.max(f"r{i}").alias(f"r{i}") for i in self.ids]), "gone")

    def _decided(self, scored: DataFrame, marks: DataFrame, grid: DataFrame | None) -> DataFrame:
        """start, label, threshold, tp, fp, fn, tn of the sums: at each threshold of a grid, or at the labels' own."""
        rows = self._ratios(scored).join(marks, "doc_id")
        if grid is None:
            rows = rows.join(F.broadcast(self.thresholds), "start")
        own = lambda i: F.lit(0.0) if grid is not None else F.col(f"t{i}")
        each = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"q{i}").alias("q"), F.col(f"g{i}").alias("gs"), own(i).alias("threshold")) for i, x in enumerate(self.names)])
        long = rows.select("start", "m", F.inline(each)).where("gs IS NOT NULL")
        if grid is not None:
            long = long.drop("threshold").join(F.broadcast(grid))
        said = ((F.col("m") > 0) & (F.col("q") >= F.col("threshold"))).cast("int")
        return long.withColumn("decision", said).groupBy("start", "label", "threshold").agg(*classify._hits(F.col("decision"), F.col("gs")))

    def sweep(self) -> None:
        best = classify.prfj(self._decided(self.scored, self.marks, grid(self.spark)), "start", "label", "threshold").groupBy("start", "label").agg(F.max(F.struct("j", "threshold")).alias("best"))
        told = best.select("start", "label", F.when(F.col("best.j") > 0, F.col("best.threshold")).otherwise(1.0).alias("t"))
        self.thresholds = written(told.groupBy("start").agg(*[F.max(F.when(F.col("label") == x, F.col("t"))).alias(f"t{i}") for i, x in enumerate(self.names)]), "thresholds")

    def run(self, rounds: int) -> Tuning:
        for _ in range(rounds):
            self.correct()
            self.sweep()
        return self

    def lexicon(self, start: int = 0) -> DataFrame:
        """token, label, weight as corrected from a start."""
        rows = self.words
        if self.gone is not None:
            gone = self.gone.where(F.col("start") == start).select("token", *[F.col(f"r{i}").alias(f"z{i}") for i in self.ids])
            rows = rows.join(gone, "token", "left").select("token", *[F.when(F.coalesce(f"z{i}", F.lit(0)) > 0, 0).otherwise(F.col(f"w{i}")).alias(f"w{i}") for i in self.ids])
        return rows.select("token", F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"w{i}").cast("double").alias("weight")) for i, x in enumerate(self.names)])))

    def limits(self, start: int = 0) -> DataFrame:
        """label, threshold from a start."""
        rows = self.thresholds.where(F.col("start") == start)
        return rows.select(F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"t{i}").alias("threshold")) for i, x in enumerate(self.names)])))

    def tested(self, docs: DataFrame, counts: DataFrame, gs: DataFrame) -> DataFrame:
        """start, p, r, f, j on other documents."""
        known = self._known(counts)
        scored = self._sums(docs, known)
        if self.gone is not None:
            scored = self._less(scored, known, self.gone)
        marks = gs.groupBy("doc_id").agg(*[F.max(F.when(F.col("label") == x, F.col("gs"))).alias(f"g{i}") for i, x in enumerate(self.names)])
        return classify.prfj(self._decided(scored, marks, None), "start")


def tune(docs: DataFrame, counts: DataFrame, gs: DataFrame, lex: DataFrame, threshold: float = 0.15, rounds: int = 3, labels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(lexicon, thresholds) after rounds of a correction and new label thresholds."""
    made = Tuning(docs, counts, gs, lex, [threshold], labels).run(rounds)
    return made.lexicon(), made.limits()


def create_and_tune(
    train: DataFrame, test: DataFrame, gs: DataFrame, threshold: float = 0.15, top: int = 2500, rounds: int = 3, labels: list[str] | None = None, counts: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """p, r, f, j on test of a lexicon that is learnt and tuned on train; both are (doc_id, text), gs covers both. counts: their term_counts(), where these are there already."""
    return _ranged(train, test, gs, [threshold], top, rounds, labels, counts).drop("start")


def _ranged(train: DataFrame, test: DataFrame, gs: DataFrame, starts: list[float], top: int, rounds: int, labels: list[str] | None, counts: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    learnt, tested = counts or tuple(written(features.counts(x).select("doc_id", "token", "n"), "counts") for x in (train, test))
    own = gs.join(train.select("doc_id"), "doc_id", "left_semi")
    made = Tuning(train, learnt, own, written(lexicon.learn(learnt, own, top), "lexicon"), starts, labels).run(rounds)
    return made.tested(test, tested, gs)


def create_and_tune_range(
    train: DataFrame, test: DataFrame, gs: DataFrame, start: float = 1.0, end: float = 0.0, step: float = 0.1, top: int = 2500, rounds: int = 3, labels: list[str] | None = None, counts: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """threshold, p, r, f, j: create_and_tune() from each starting threshold, all of them together."""
    starts = grid_values(start, end, step, closed=True)
    named = F.broadcast(gs.sparkSession.createDataFrame(list(enumerate(starts)), "start int, threshold double"))
    return _ranged(train, test, gs, starts, top, rounds, labels, counts).join(named, "start").orderBy("start").select("threshold", "p", "r", "f", "j")
