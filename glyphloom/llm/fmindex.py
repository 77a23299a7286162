"""Operator 10: substring dedup by a compressed FM-index per shard.

Of each minimiser's segments in a shard, the first ones by doc_id are the text of an index and all others are streamed through it. The
text is over the alphabet of its words, with a mark after each segment; of it remain the Burrows-Wheeler transform as a wavelet matrix over
packed bits with popcount ranks, a second wavelet matrix that says to which segment each suffix belongs, and how many words, up to `window`,
each suffix shares with the one before it: a byte, and bits by length to find the interval around it. The suffix array itself is not kept.

A segment is streamed from right to left: each step prepends a word by backward search, or, where no suffix goes on, widens the interval to
the suffixes that share the next shorter run. So the match at each word, its matching statistic, is known after two steps a word at most. A
match of `window` words is an interval above the threshold, of whose segments the second matrix gives the first. What a round does not find, it
leaves to the next one, whose index has more segments of each minimiser.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, fresh, own_columns, slices, text_buffers, with_key, word_bounds, written
from .passages import WINDOW, Sieve, repeated

#: Windows of a lane: longer segments are streamed in parts side by side.
LANE = 256
#: How many times as many segments of a minimiser the next index has.
MORE = 4


class BitRank:
    """Packed bits; ones(i) counts the set ones before i."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def place(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th set bit is, k from 1; the bits' end beyond the last one."""
        w = np.minimum(np.searchsorted(self.before, k, side="left") - 1, len(self.words) - 1)
        word, left, at = self.words[w], (k - self.before[w]).astype(np.int64), np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left > low
            left, at = np.where(up, left - low, left), np.where(up, at + half, at)
            word = np.where(up, word >> np.uint64(half), word)
        return w * 64 + at


class WaveletMatrix:
    """rank(c, i): how often symbol c stands before i; least(l, r): the smallest symbol from l up to r."""

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        self.levels: list[tuple[int, int, BitRank]] = []
        for shift in reversed(range(max(1, int(largest).bit_length()))):
            bits = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((shift, len(bits) - int(bits.sum()), BitRank(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.start = self._walk(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, zeros, bits in self.levels:
            ones = bits.ones(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(c, i) - self.start[c]

    def least(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        made = np.zeros(len(left), np.int64)
        for shift, zeros, bits in self.levels:
            a, b = bits.ones(left), bits.ones(right)
            one = right - left == b - a
            made |= one.astype(np.int64) << shift
            left, right = np.where(one, zeros + a, left - a), np.where(one, zeros + b, right - b)
        return made


class FMIndex:
    """Over texts, which are runs of words (numbers from 0) of these lengths; for patterns of `window` words, 2 or more."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, window: int) -> None:
        self.vocabulary, symbols = np.unique(words, return_inverse=True)
        self.window = window
        owner = np.repeat(np.arange(len(lengths)), lengths)
        text = np.zeros(len(words) + len(lengths), np.int64)  # 0 is the mark
        text[np.arange(len(words)) + owner] = symbols + 1
        n = self.size = len(text)
        rank, step = text.copy(), 1
        while True:  # ranks by the first `step` symbols, doubled
            shift = min(step, window - step)
            after = np.full(n, -1, np.int64)
            after[: max(0, n - shift)] = rank[shift:]
            pair = rank * (n + len(self.vocabulary) + 2) + after + 1
            order = np.argsort(pair, kind="stable")
            new = np.diff(pair[order], prepend=-1) != 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            step += shift
            if step == window:
                break
        self.bwt = WaveletMatrix(text[order - 1], len(self.vocabulary))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))])
        self.owners = WaveletMatrix(np.repeat(np.arange(len(lengths)), lengths + 1)[order], max(0, len(lengths) - 1))
        # shared[i]: how many symbols suffix i has in common with the one before it, `window` at most. Level p of begins has a bit where that is
        # below p: the suffixes that share p symbols stand between two of its bits.
        padded = np.concatenate([text, np.zeros(window, np.int64)])
        self.shared, self.level = np.zeros(n + 1, np.uint8), -(-n // 64) * 64
        bits, alike = np.zeros((window + 1, self.level), bool), np.arange(1, n)
        bits[:, 0] = True
        for depth in range(window):
            same = padded[order[alike] + depth] == padded[order[alike - 1] + depth]
            bits[depth + 1, alike[~same]] = True
            alike = alike[same]
            self.shared[alike] = depth + 1
        bits[1:] = np.logical_or.accumulate(bits[1:], axis=0)
        self.begins = BitRank(bits.ravel())

    def prepend(self, symbol: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern."""
        both = self.first[np.concatenate([symbol, symbol])] + self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([left, right]))
        return both[: len(symbol)], both[len(symbol) :]

    def widened(self, left: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the suffixes that share so many symbols with the ones at left."""
        base = length * self.level
        group = self.begins.ones(base + left + 1)
        return self.begins.place(group) - base, np.minimum(self.begins.place(group + 1) - base, self.size)

    def stream(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lane, at, text): the windows of words[start : start + length] of each lane that the texts have, by their first word there, and the first text that has each.

        From right to left, `right - left` suffixes begin with the words from j + 1 up to `end`, and no longer run up to there is anywhere in the texts but by prepending.
        """
        window = self.window
        symbols = np.searchsorted(self.vocabulary, words)
        symbols = np.where(self.vocabulary[np.minimum(symbols, len(self.vocabulary) - 1)] == words, symbols + 1, 0)
        found: list[tuple[np.ndarray, ...]] = []
        lane, base, j, end = np.arange(len(starts)), starts, lengths - 1, lengths.copy()
        left, right = np.zeros(len(starts), np.int64), np.full(len(starts), self.size)
        while True:
            live = (end >= window) & (j >= 0)  # no window ends before `window` words
            if not live.all():
                lane, base, j, end, left, right = lane[live], base[live], j[live], end[live], left[live], right[live]
            if not len(lane):
                break
            symbol = symbols[base + j]
            a, b = self.prepend(symbol, left, right)
            on = (symbol > 0) & (a < b)
            # What does not go on lets its last words go until one suffix more shares the rest; a word that the texts don't have ends all matches.
            length = np.where(symbol > 0, np.maximum(self.shared[left], self.shared[right]), 0).astype(np.int64)
            unknown = symbol == 0
            end = np.where(on, end, np.where(unknown, j, j + 1 + length))
            left, right = np.where(on, a, left), np.where(on, b, right)
            long = on & (end - j > window)
            length = np.where(long, window, length)
            wide = np.flatnonzero(~on | long)
            if len(wide):
                left[wide], right[wide] = self.widened(left[wide], length[wide])
            end = end - long
            hit = np.flatnonzero(on & (end - j == window))
            if len(hit):
                found.append((lane[hit], j[hit], left[hit], right[hit]))
            j = j - (on | unknown)
        if not found:
            return (np.zeros(0, np.int64),) * 3
        lanes, places, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return lanes, places, self.owners.least(a, b)


def windows_by_fm(words: np.ndarray, lengths: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray]:
    """A passages.Kernel: the least lo of each window."""
    n = lengths - window + 1
    least = np.repeat(lo, n)  # what no other segment has
    begin, out = np.cumsum(lengths) - lengths, np.cumsum(n) - n
    order = np.lexsort((lo, group))
    begin, out, n, group, lo, take = begin[order], out[order], n[order], group[order], lo[order], 1
    while len(n):
        head = np.flatnonzero(np.diff(group, prepend=-1))
        many = np.diff(np.append(head, len(group)))
        nth = np.arange(len(group)) - np.repeat(head, many)
        shared = np.repeat(many, many) > 1  # a minimiser's only segment has its windows alone
        text = np.flatnonzero(shared & (nth < take))
        text = text[np.argsort(lo[text], kind="stable")]
        streamed = np.flatnonzero(shared & (nth >= (take if take == 1 else 0)))
        if not len(streamed):
            break
        size = n + window - 1
        body = words[np.repeat(begin[text], size[text]) + _counting(size[text])]
        parts = -(-n[streamed] // LANE)
        of, shift = np.repeat(streamed, parts), _counting(parts) * LANE
        lane, at, first = FMIndex(body, size[text], window).stream(words, begin[of] + shift, np.minimum(n[of] - shift, LANE) + window - 1)
        own, at = of[lane], at + shift[lane]
        least[out[own] + at] = lo[text[first]]
        # The runs of windows that were not found go on; those of the texts are settled.
        missed = np.ones(int(n.sum()), bool)
        flat = np.cumsum(n) - n
        missed[flat[own] + at] = False
        missed[np.repeat(nth < take, n) | ~np.repeat(shared, n)] = False
        left = np.flatnonzero(missed)
        owner = np.repeat(np.arange(len(n)), n)[left]
        new = np.ones(len(left), bool)
        new[1:] = (np.diff(left) != 1) | (np.diff(owner) != 0)
        s = np.flatnonzero(new)
        of, off = owner[s], left[s] - flat[owner[s]]
        begin, out, n, group, lo = begin[of] + off, out[of] + off, np.diff(np.append(s, len(left))), group[of], lo[of]
        take *= MORE
    return (least,)


def _counting(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def covered(count: np.ndarray, first: np.ndarray, at: np.ndarray, per: np.ndarray, window: int) -> np.ndarray:
    """Which of all words stand in a window: at, per document `per` many, are the windows' first words within the document."""
    edge = np.zeros(int(count) + 1, np.int64)
    begin = np.repeat(first[:-1], per) + at
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + window, -1)
    return np.cumsum(edge)[:-1] > 0


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): each document's kept words with one space between them."""
    edge = np.zeros(len(buf) + 1, np.int32)
    edge[starts[keep]] += 1
    edge[ends[keep]] -= 1
    inside = np.cumsum(edge) > 0
    kept = np.flatnonzero(keep)
    doc = np.searchsorted(first, kept, side="right") - 1
    more = np.zeros(len(kept), bool)
    more[:-1] = doc[1:] == doc[:-1]
    out = inside.copy()
    out[ends[kept[more]]] = True
    made = np.where(inside[:-1], buf, np.uint8(0x20))[out[:-1]]
    size = np.bincount(doc, weights=(ends - starts)[kept] + more, minlength=len(first) - 1).astype(np.int64)
    return made, np.concatenate([[0], np.cumsum(size)])


def cut(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the texts without the words that aren't kept and the white space after them; what stays keeps its own white space."""
    edge = np.zeros(len(buf) + 1, np.int32)
    doc = np.searchsorted(offs, starts, side="right") - 1
    following = np.append(starts[1:], len(buf))
    until = np.minimum(following, offs[doc + 1])
    gone = ~keep
    edge[starts[gone]] += 1
    np.add.at(edge, until[gone], -1)
    stay = np.cumsum(edge)[:-1] <= 0
    return buf[stay], np.concatenate([[0], np.cumsum(stay)])[offs]


def _finish(window: int, with_text: bool, with_at: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offs = text_buffers(batch.column("text"))
            starts, ends, first = word_bounds(buf, offs)
            counts = np.diff(first)
            keep = np.ones(len(starts), bool)
            if with_at:
                at = batch.column("at")
                keep = ~covered(len(starts), first, at.flatten().to_numpy(), np.diff(at.offsets.to_numpy()), window)
            gone = np.diff(np.concatenate([[0], np.cumsum(~keep)])[first])
            made, cuts = joined(buf, starts, ends, first, keep)
            whole = made.tobytes()
            sums = [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            cols = [batch.column("doc_id"), batch.column("did"), batch.column("tkey"), pa.array(counts), pa.array(gone), pa.array(sums)]
            if with_text:
                body, ends8 = cut(buf, offs, starts, ends, first, keep)
                cols.append(pa.LargeStringArray.from_buffers(len(ends8) - 1, pa.py_buffer(ends8.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "did", "tkey", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, **options: object) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with_text: kept_text; did and tkey tell rows apart): one row per row of docs (doc_id, text).

    A word goes if a window that covers it also starts in a document with a smaller doc_id, as the texts came. Null texts have no words.
    Rows of one doc_id don't count against each other; a null doc_id counts as larger than all others. Texts of fewer than
    `window` words keep all; very long ones are read whole, each alone in its slice. The hash is that of the kept words joined by one space;
    kept_text keeps their own white space. No rows give no rows; other columns are ignored.
    """
    rows = with_key(docs)
    runs = repeated(rows, windows_by_fm, ("least",), window, **options)
    hits = F.filter(F.transform("least", lambda x, j: F.when(x < F.col("did"), F.col("start") + j)), lambda x: x.isNotNull())
    gone = runs.select("did", "tkey", hits.alias("at")).where(F.size("at") > 0).groupBy("did", "tkey").agg(F.flatten(F.collect_list("at")).alias("at"))
    gone = written(gone, "gone")
    maybe = Sieve(gone, F.col("tkey")).holds(F.col("tkey"))
    schema = "doc_id long, did long, tkey long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    sieved = rows.withColumn("maybe", maybe)
    whole = sieved.where(~F.col("maybe")).select("doc_id", "did", "tkey", "text").mapInArrow(_finish(window, with_text, False), schema)
    some = sieved.where("maybe").select("doc_id", "did", "tkey", "text").join(gone, ["did", "tkey"], "left")
    some = some.select("doc_id", "did", "tkey", "text", F.coalesce("at", F.array().cast("array<int>")).alias("at"))
    return whole.unionByName(some.mapInArrow(_finish(window, with_text, True), schema))


def deduplicated(docs: DataFrame, window: int = WINDOW, **options: object) -> DataFrame:
    """docs with the repeated passages cut out of `text` and n_chars, where there is one, counted anew; a document of which no word is left, though it had some, goes.

    Rows without a removal keep their text as it was, a null too; rows that repeat a document fare alike. Texts may be of any length. docs may have any columns.
    """
    did, tkey, left, maybe, body = fresh(docs, "did", "tkey", "left_over", "maybe", "kept_text")
    made = dedup(docs, window, True, **options).where("n_removed > 0")
    made = made.select(F.col("did").alias(did), F.col("tkey").alias(tkey), F.col("kept_text").alias(body), (F.col("n_removed") < F.col("n_words")).alias(left))
    changed = written(made.dropDuplicates([did, tkey]), "changed")
    both = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), tkey: F.xxhash64(F.coalesce("text", F.lit("")))})
    both = both.withColumn(maybe, Sieve(changed, F.col(tkey)).holds(F.col(tkey)))
    same = both.where(~F.col(maybe)).select(*own_columns(docs))
    new = {"text": F.coalesce(body, "text").alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length(body).cast("long"), F.col("n_chars").cast("long")).alias("n_chars")
    cols = [new.get(c, own) for c, own in zip(docs.columns, own_columns(docs), strict=True)]
    moved = both.where(maybe).join(changed, [did, tkey], "left").where(F.coalesce(left, F.lit(True))).select(*cols)
    return same.unionByName(moved)
