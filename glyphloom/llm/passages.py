"""Repeated passages: which windows of consecutive words occur in more than one document, and in which.

Operators 3 and 10 share the way to their shards. A window's minimiser is the least hash among its runs of GRAMS[0] words, so equal windows
have equal minimisers wherever they stand. A segment is a run of windows with one minimiser. Only minimisers of two documents or more can
have a repeated window; their segments, each distinct one once with the smallest and largest doc_id that holds it, are dealt to shards
by minimiser with their text, and a kernel finds the smallest (and largest) doc_id of each of their windows, comparing words by their
bytes. The occurrences then look their windows up.

A minimiser with more than HOT distinct segments (a passage with very many variants) is too much for one shard: its segments are cut again
by the minimisers of longer runs of words, GRAMS[1] and at last the whole window, and the pieces, each distinct one once, go to the kernel.

Hashes only bring together what may be equal; what counts as one segment agrees in 126 bits of two hashes of its words, of which the
second has no structure that texts could cancel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, mixed, partitions_for, pieces_for, prefix_sums, prime_hash, signed, slices, span_hash, text_buffers, trimmed, word_bounds, written
from .xxh import xxh64

#: A window's words, and the words of the runs whose least hash is a minimiser: at first, for hot ones, and for those that are hot again.
WINDOW, GRAMS = 50, (12, 31, 50)
#: Words that a shard aims at, and distinct segments from which a minimiser is hot.
SHARD_WORDS, HOT = 200_000, 2048
#: Another odd base, for runs of words.
_WORDS = 0xC2B2AE3D27D4EB4F
#: A sieve's bits at most: 4 MB. With more than a fourth as many keys it would let nearly all through, so there is none.
SIEVE_BITS = 25
#: Words of units that leave a worker together.
WORDS_AT_ONCE = 1 << 19


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return xxh64(buf, starts, ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    at = np.arange(max(0, len(words) - gram + 1))
    return span_hash(prefix_sums(words, _WORDS), at, at + gram, _WORDS)


def segments(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """(doc, start, n, mini, a, b): start is the first window's word within its document, n the windows, (a, b) a hash of all n + window - 1 words."""
    counts = np.diff(first)
    per = np.maximum(counts - window + 1, 0)
    total = int(per.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    sums = prefix_sums(words, _WORDS)
    at = np.arange(len(words) - gram + 1)
    least = sliding_min(span_hash(sums, at, at + gram, _WORDS), window - gram + 1)
    doc = np.repeat(np.arange(len(per)), per)
    own = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    mini = least[own + first[:-1][doc]]
    new = np.ones(total, bool)
    new[1:] = (mini[1:] != mini[:-1]) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(new)
    n = np.diff(np.append(s, total))
    begin = own[s] + first[doc[s]]
    end = begin + n + window - 1
    return doc[s], own[s], n, mini[s], span_hash(sums, begin, end, _WORDS), prime_hash(words, begin, end)


class Sieve:
    """A Bloom filter over hashed keys: it may let others through, and never holds one of them back. Its size follows the number of keys; with very many it lets all through."""

    def __init__(self, keys: DataFrame, key: Column) -> None:
        many = keys.count()
        self.words = None
        if 4 * many > 1 << SIEVE_BITS:
            return
        self.bits = min(SIEVE_BITS, max(16, (16 * many).bit_length()))
        bits = keys.select(F.explode(F.array(*self._places(key))).alias("bit"))
        made = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits"))
        found = made.toPandas()  # 2**19 rows at most
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1 << self.bits)) for i in range(3)]

    def holds(self, key: Column) -> Column:
        if self.words is None:
            return F.lit(True)
        words = SparkSession.active().sparkContext.broadcast(self.words)

        @F.pandas_udf("boolean")
        def maybe(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            table = words.value
            hit = np.ones(len(a), bool)
            for x in (a, b, c):
                bit = x.to_numpy(np.int64)
                hit &= ((table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            return pd.Series(hit)

        return maybe(*self._places(key))


def _segments_of(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offs = text_buffers(batch.column("text"))
            starts, ends, first = word_bounds(buf, offs)
            doc, start, n, mini, a, b = segments(word_hashes(buf, starts, ends), first, window, gram)
            did, tkey = (batch.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("did", "tkey"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(did), pa.array(tkey), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(mini)), pa.array(signed(a)), pa.array(b)],
                names=["did", "tkey", "start", "n", "mini", "a", "b"],
            )

    return run


def spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes, offsets): the words one after another, each with a space behind it; word i stands at offsets[i]:offsets[i + 1]."""
    size = ends - starts + 1
    offsets = np.concatenate([[0], np.cumsum(size)])
    if not len(starts):
        return b"", offsets
    made = np.append(buf, np.uint8(0x20))[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    made[offsets[1:] - 1] = 0x20
    return made.tobytes(), offsets


_UNIT = "a long, b long, mini long, n int, body binary, lo long, hi long"
_NAMES = [x.split()[0] for x in _UNIT.split(", ")]


def _cuts(n: np.ndarray, window: int) -> Iterator[slice]:
    """Slices of units that have WORDS_AT_ONCE words together, or are one unit."""
    total, at = np.concatenate([[0], np.cumsum(n + window - 1)]), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(total, total[at] + WORDS_AT_ONCE, side="right")) - 1)
        yield slice(at, end)
        at = end


def _units(body: bytes, offsets: np.ndarray, begin: np.ndarray, window: int, columns: dict[str, np.ndarray], extra: dict[str, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of _UNIT (behind those of extra): each unit's n + window - 1 words from word `begin` on."""
    left, right = offsets[begin], offsets[begin + columns["n"] + window - 1]
    for some in _cuts(columns["n"], window):
        texts = [body[i:j] for i, j in zip(left[some].tolist(), right[some].tolist(), strict=True)]
        made = {k: pa.array(v[some]) for k, v in (extra or {}).items()}
        made |= {c: pa.array(texts, pa.binary()) if c == "body" else pa.array(columns[c][some].astype(np.int32) if c == "n" else columns[c][some]) for c in _NAMES}
        yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def _contents(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_UNIT of each segment asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offs = text_buffers(batch.column("text"))
            starts, ends, first = word_bounds(buf, offs)
            body, offsets = spaced(buf, starts, ends)
            asked = batch.column("asked")
            per = np.diff(asked.offsets.to_numpy())
            flat = asked.flatten()
            col = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
            yield from _units(body, offsets, np.repeat(first[:-1], per) + col["start"], window, col | {"n": col["n"].astype(np.int64)})

    return run


def _shorter(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows of _UNIT the pieces that the minimisers of longer runs make: pa, pb (whose piece), off (its first window there) and _UNIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            buf, offs = text_buffers(batch.column("body"))
            starts, ends, first = word_bounds(buf, offs)
            unit, off, n, mini, a, b = segments(word_hashes(buf, starts, ends), first, window, gram)
            body, offsets = spaced(buf, starts, ends)
            own = {c: batch.column(c).to_numpy(zero_copy_only=False)[unit] for c in ("a", "b", "lo", "hi")}
            columns = {"a": signed(a), "b": b, "mini": signed(mini), "n": n, "lo": own["lo"], "hi": own["hi"]}
            yield from _units(body, offsets, first[unit] + off, window, columns, {"pa": own["a"], "pb": own["b"], "off": off.astype(np.int32)})

    return run


#: words (numbers, equal for equal words) of all units one after another, their lengths, the number of each one's minimiser, lo and hi, the window -> for each window of each unit the least lo (and the greatest hi)
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, ...]]


def numbers(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number for each word of bodies of spaced(), from 0, by its bytes."""
    if not len(body):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(body == 0x20) + 1])  # each word ends with the only space that it has
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _solve(kernel: Kernel, window: int, fields: tuple[str, ...]):
    def run(part: pa.Table) -> pa.Table:
        n = part.column("n").to_numpy().astype(np.int64)
        lo, hi = (part.column(c).to_numpy() for c in ("lo", "hi"))
        _, group = np.unique(part.column("mini").to_numpy(), return_inverse=True)
        found = kernel(numbers(*text_buffers(part.column("body"))), n + window - 1, group, lo, hi, window)
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        made = {"a": part.column("a"), "b": part.column("b")} | {f: pa.ListArray.from_arrays(ends, pa.array(x)) for f, x in zip(fields, found, strict=True)}
        trimmed()
        return pa.table(made)

    return run


def _solved(units: DataFrame, solve: Callable, fields: tuple[str, ...], window: int, grams: tuple[int, ...], shard_words: int, hot: int) -> DataFrame:
    """a, b and a list for each of fields: of distinct units (_UNIT, a written table) what the kernel says of their windows."""
    crowds = None
    if grams:
        # Written, so that its size shows Spark whether it may be broadcast: joined by mini, a hot one's units would meet in a task.
        crowds = written(units.groupBy("mini").count().where(F.col("count") > hot).select("mini"), "crowds")
        crowds = None if crowds.isEmpty() else crowds
    cold = units if crowds is None else units.join(crowds, "mini", "left_anti")
    shards = pieces_for(units.agg(F.coalesce(F.sum(F.col("n") + window - 1), F.lit(0))).first()[0], shard_words)
    dealt = cold.withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards))).repartition(partitions_for(shards), "shard")
    schema = "a long, b long, " + ", ".join(f"{f} array<long>" for f in fields)
    made = written(dealt.groupBy("shard").applyInArrow(solve, schema), "solved")
    if crowds is None:
        return made
    parts = written(units.join(crowds, "mini", "left_semi").mapInArrow(_shorter(window, grams[0]), f"pa long, pb long, off int, {_UNIT}"), "pieces")
    once = [F.first(c).alias(c) for c in ("n", "body")] + [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    distinct = written(parts.groupBy("a", "b", "mini").agg(*once).select(*_NAMES), "distinct")
    below = _solved(distinct, solve, fields, window, grams[1:], shard_words, hot)
    back = parts.select("pa", "pb", "off", "a", "b").join(below, ["a", "b"])
    rows = back.groupBy("pa", "pb").agg(F.array_sort(F.collect_list(F.struct("off", *fields))).alias("rows"))
    return made.unionByName(rows.select(F.col("pa").alias("a"), F.col("pb").alias("b"), *[F.flatten(f"rows.{f}").alias(f) for f in fields]))


def repeated(
    docs: DataFrame, kernel: Kernel, fields: tuple[str, ...], window: int = WINDOW, grams: tuple[int, ...] = GRAMS, shard_words: int = SHARD_WORDS, hot: int = HOT
) -> DataFrame:
    """did, tkey, start and a list for each of fields: of docs (with_key()), runs of windows from word `start` on that may repeat, and what the kernel says of each window.

    Rows of equal (did, tkey) are one document here, with one row for each run.
    """
    every = written(docs.select("did", "tkey", "text").mapInArrow(_segments_of(window, grams[0]), "did long, tkey long, start int, n int, mini long, a long, b long"), "segments")
    shared = every.groupBy("mini").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi").select("mini")
    # Rows that repeat a document are combined before the shuffle.
    found = written(every.join(shared, "mini", "left_semi").dropDuplicates(["did", "tkey", "start"]), "shared")
    dropped(every)
    one = F.min(F.struct("did", "tkey", "start"))
    distinct = found.groupBy("a", "b", "mini", "n").agg(one.alias("one"), F.max("did").alias("hi"))
    ask = F.struct("one.start", "n", "a", "b", "mini", F.col("one.did").alias("lo"), "hi")
    asked = written(distinct.select("one.did", "one.tkey", ask.alias("ask")).groupBy("did", "tkey").agg(F.collect_list("ask").alias("asked")), "asked")
    holders = docs.where(Sieve(asked, F.col("tkey")).holds(F.col("tkey"))).select("did", "tkey", "text").dropDuplicates(["did", "tkey"])
    units = written(holders.join(asked, ["did", "tkey"]).select("text", "asked").mapInArrow(_contents(window), _UNIT), "units")
    dropped(asked)
    result = _solved(units, _solve(kernel, window, fields), fields, window, grams[1:], shard_words, hot)
    return found.select("a", "b", "did", "tkey", "start").join(result, ["a", "b"]).select("did", "tkey", "start", *fields)
