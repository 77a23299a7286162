"""Operator 6: mix sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import copies_of, dropped, fresh, numbered, own_columns, written

#: A 52-bit hash as a number from 0 up to 1.
_STEPS = float(1 << 52)


def words(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: of sizes (source, source_size), one row per source, of which there may be any number.

    Sources by code point, null last, take the weights in turn. They share `share` of all sizes by weight, up to `most` of their own size;
    what is above goes to the others by weight. The words that a unit of weight gets are found by one sum over the sources a round: what is left
    when those at their limit have theirs, over the weight of the others. It only rises, and is final once no further source is at its limit.
    """
    place = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("n"), F.lit(len(weights))) + 1).cast("int"))
    listed = numbered(sizes.withColumn("missing", F.col("source").isNull()), ["missing", "source"], "n")
    own = written(listed.select("source", "source_size", place.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "weighed")
    total, weight = own.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = float(share) * total / weight if weight else 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        given, weight = own.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        higher = (total * float(share) - given) / weight if weight else level
        if higher <= level:
            break
        level = higher
    return own.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def draws(doc_id: Column, text_key: Column, nth: Column, seed: int = 42) -> Column:
    """A number from 0 up to 1 that doc_id, text, the row's number among equal rows and seed decide."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), text_key, nth.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(_STEPS)


def _copies(rate: Column, draw: Column) -> Column:
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def _rated(goal: DataFrame) -> DataFrame:
    return goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def plan(docs: DataFrame, seed: int = 42, **law: object) -> DataFrame:
    """docs' columns doc_id and source with size, source_size, target, copies: one row per row of docs (doc_id, text, source).

    A document is taken floor(rate) times, and once more where its draw is below the rest of its source's rate, target / source_size. Rows that
    differ in doc_id or text draw apart; equal rows, null doc_ids too, are numbered and draw apart as well, so that a source whose rows are all
    alike meets its target too. Null text has no words, empty and white texts neither; a source without words has rate 0; null is a source like
    any other. Texts may be of any length. No rows give no rows; other columns are ignored. One source may hold any part of the rows: sizes are
    summed before the shuffle and only a row per source is joined; equal rows travel as one row with their number.
    """
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("size")]
    equal = written(docs.select(*key).groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("many")), "sizes")
    goal = written(_rated(targets(equal.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size")), **law)), "targets")
    each = copies_of(equal, "many", "nth")
    both = each.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return both.select("doc_id", "source", "size", "source_size", "target", "rate", _copies(F.col("rate"), draws(F.col("doc_id"), F.col("text_key"), F.col("nth"), seed)).alias("copies"))


def mix(docs: DataFrame, seed: int = 42, **law: object) -> DataFrame:
    """docs, each row as often as plan() takes it, with docs' columns, whatever their names. Sources' rates are a row each in a written table, whose size shows Spark whether they may be broadcast.

    Only rows whose doc_id, source and text come more than once are gathered, as one row with its number, to be told apart by it.
    """
    of, rate, name, many, nth, n = fresh(docs, "of", "rate", "row_name", "many", "nth", "n")
    text_key = _text_key(docs["text"])
    named = F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), text_key, F.coalesce(F.md5(docs["source"].cast("string")), F.lit("null"))))
    keys = docs.select(named.alias("name"), docs["source"].cast("string").alias("source"), words(docs["text"]).alias("size"))
    equal = written(keys.groupBy("name", "source", "size").agg(F.count("*").alias("many")), "sizes")
    goal = _rated(targets(equal.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size")), **law))
    rates = written(goal.select(F.col("source").alias(of), F.col("rate").alias(rate)), "rates")
    again = written(equal.where("many > 1").select(F.col("name").alias(name)), "again")
    dropped(equal)
    if again.isEmpty():
        rows = docs.withColumn(nth, F.lit(0))
    else:
        marked = docs.withColumn(name, named)
        once = marked.join(again, name, "left_anti").select(*own_columns(docs), F.lit(0).cast("long").alias(nth))
        cols = own_columns(docs)
        alike = marked.join(again, name, "left_semi").groupBy(name, *cols).agg(F.count("*").alias(many))
        before = Window.partitionBy(name).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
        first = fresh(alike, "first")[0]
        alike = written(alike.withColumn(first, F.coalesce(F.sum(many).over(before), F.lit(0))), "alike")
        rows = once.unionByName(copies_of(alike, many, nth).select(*cols, (F.col(first) + F.col(nth)).alias(nth)))
    both = rows.join(rates, F.col("source").cast("string").eqNullSafe(F.col(of)))
    copies = _copies(F.col(rate), draws(F.col("doc_id").cast("long"), _text_key(F.col("text")), F.col(nth), seed)).cast("int")
    return both.withColumn(n, F.explode(F.array_repeat(F.lit(0), copies))).select(*own_columns(docs))
