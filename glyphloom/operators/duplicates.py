"""Removing documents that equal, or nearly equal, one that sorts beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphloom.functions import text as T
from glyphloom.storage import written


def with_tokens(docs: DataFrame) -> DataFrame:
    """docs' doc_id and tokens, an array."""
    return docs.select("doc_id", T.tokens(F.col("text")).alias("tokens"))


def exact(docs: DataFrame) -> DataFrame:
    """doc_id, kept_id, copies: each document with the first one that has the same tokens, and how many have them.

    Copies are grouped by a hash of their tokens: minima and counts are combined before the shuffle, so a large group is one row a task.
    """
    keyed = written(with_tokens(docs).select("doc_id", F.sha2(F.to_json(F.struct("tokens")), 256).alias("key")), "keys")
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("copies"))
    return keyed.join(first, "key").select("doc_id", "kept_id", "copies")


def alignment_cost(a: list[str], b: list[str], most: int) -> int:
    """The least number of tokens to delete and insert to make b of a, or more than `most`; within a band of that width, between what both begin and end with."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    short = min(len(a), len(b))
    ahead = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), short)
    behind = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if i == short - ahead or x != y), short - ahead)
    a, b = a[ahead : len(a) - behind], b[ahead : len(b) - behind]
    row = {j: j for j in range(most + 1) if j <= len(b)}
    for i, x in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            ways = [row[j] + 1] if j in row else []
            if j and j - 1 in new:
                ways.append(new[j - 1] + 1)
            if j and b[j - 1] == x and j - 1 in row:
                ways.append(row[j - 1])
            if ways and min(ways) <= most:
                new[j] = min(ways)
        if not new:
            return most + 1
        row = new
    return row.get(len(b), most + 1)


def joined_tokens(text: Column) -> Column:
    """A text's tokens in one string, which sorts as their list does: a NUL separates them, and one that a token has is written as two characters, as is the character after NUL."""
    plain = F.replace(F.replace(text, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\1"))
    return F.array_join(T.tokens(plain), "\0")


def split_tokens(joined: str) -> list[str]:
    """The tokens of joined_tokens()."""
    tokens = joined.split("\0") if joined else []
    return [t.replace("\1\1", "\0").replace("\1\2", "\1") for t in tokens] if "\1" in joined else tokens


def near(docs: DataFrame, cost: int = 2, similar: Callable[[list[str], list[str]], bool] | None = None) -> DataFrame:
    """doc_id, group_id, kept: a fold over the documents in the order of their tokens, then doc_id.

    A document that equals the group's first one, or is `cost` edits away from it, joins its group; any other starts one. Of a group the document with
    the most different tokens is kept, the first of equals. Groups are named by their first document.

    Documents with equal tokens do the same, so the fold is over different token lists, each a string that sorts as its tokens do. Their order is dealt out in
    ranges, each of which a task folds as its rows come, one head and one row at a time, so that memory stays flat. Texts don't come back from there but at the
    ends of a range. A range is right unless the group that is open before it takes its first row in. Such ranges, mostly none, are folded again behind that
    group's head, until none changes. The driver learns the ranges' numbers and heads' ids.
    """
    alike = similar or (lambda a, b: a == b or alignment_cost(a, b, cost) == cost)
    listed = docs.select("doc_id", joined_tokens(F.col("text")).alias("text"))
    rows = written(listed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.sha2("text", 256).alias("key")), "tokens")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"))
    # Only numbers are grouped; of each group one row's text is met by its number in a hash table, and no text is sorted.
    lists = rows.select("row", "text").join(first.hint("shuffle_hash"), "row").select("doc_id", "key", "text")
    schema = "range int, doc_id long, key string, group_id long, features int, first string, head string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by range and text; one whose `opens` holds is the head of the group that is open before its range. The first row of a range has its text, the last one the head that is open behind it."""
        task = TaskContext.get().partitionId()
        group, head, tokens_of_head, before, held = None, None, [], None, None
        for batch in batches:
            made: list[tuple] = []
            numbers = batch.column("range").to_pylist() if "range" in batch.schema.names else [task] * batch.num_rows
            opens = batch.column("opens").to_pylist() if "opens" in batch.schema.names else [False] * batch.num_rows
            for number, doc, key, text, opening in zip(numbers, *(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), opens, strict=True):
                tokens, first = split_tokens(text), None
                if number != before:
                    if held:
                        made.append((*held, head))
                    group, head, before, held = None, None, number, None
                if opening:
                    group, head, tokens_of_head = doc, text, tokens
                    continue
                if held:
                    made.append((*held, None))
                else:
                    first = text
                if head is None or not alike(tokens_of_head, tokens):
                    group, head, tokens_of_head = doc, text, tokens
                held = number, doc, key, group, len(set(tokens)), first
            yield _rows(made)
        yield _rows([(*held, head)] if held else [])

    def _rows(made: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
        names = ["range", "doc_id", "key", "group_id", "features", "first", "head"]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*made, strict=True) if made else [[]] * 7, kinds, strict=True)], names=names)

    @F.pandas_udf("boolean")
    def takes(head: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([a is not None and b is not None and bool(alike(split_tokens(a), split_tokens(b))) for a, b in zip(head, first, strict=True)])

    parts = [written(lists.repartitionByRange("text").sortWithinPartitions("text").mapInArrow(fold, schema), "folded")]
    opened: dict[int, int] = {}
    while True:
        made = reduce(DataFrame.unionByName, parts)
        # A row a range: its first text, and the head behind the range before it.
        ends = made.where("first IS NOT NULL OR head IS NOT NULL").groupBy("range").agg(F.max("first").alias("first"), F.max(F.struct(F.col("head").isNotNull(), "group_id", "head")).alias("last"))
        order = Window.orderBy("range")
        met = ends.select("range", "first", F.lag("last.group_id").over(order).alias("group_id"), F.lag("last.head").over(order).alias("head"))
        met = written(met.withColumn("takes", takes("head", "first")), "ends")
        open_now = {r["range"]: r["group_id"] for r in met.where("takes").select("range", "group_id").collect()}
        again = sorted(k for k in {*open_now, *opened} if open_now.get(k) != opened.get(k))
        if not again:
            break
        opened = open_now
        heads = met.where(F.col("takes") & F.col("range").isin(again)).select("range", F.col("group_id").alias("doc_id"), F.lit("").alias("key"), F.col("head").alias("text"), F.lit(True).alias("opens"))
        some = lists.join(made.where(F.col("range").isin(again)).select("range", "key").hint("shuffle_hash"), "key").select("range", "doc_id", "key", "text", F.lit(False).alias("opens")).unionByName(heads)
        folded = some.repartition("range").sortWithinPartitions("range", F.col("opens").desc(), "text")
        parts = [p.where(~F.col("range").isin(again)) for p in parts] + [written(folded.mapInArrow(fold, schema), "folded")]
    # Of equal token lists the first document may be kept, so the best of a group is one of these.
    best = made.groupBy("group_id").agg(F.max(F.struct("features", (-F.col("doc_id")).alias("id"))).alias("best")).select((-F.col("best.id")).alias("kept_id"))
    groups = made.select(F.col("doc_id").alias("first_id"), "key", "group_id").join(best, F.col("first_id") == F.col("kept_id"), "left").select("key", "group_id", "kept_id")
    return rows.select("doc_id", "key").join(groups, "key").select("doc_id", "group_id", F.coalesce(F.col("doc_id") == F.col("kept_id"), F.lit(False)).alias("kept"))
