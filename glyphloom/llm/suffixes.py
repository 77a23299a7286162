"""Operator 3: repeated passages by sparse suffix arrays.

Only suffixes that start at a window's minimiser are kept. In a shard they are sorted by the words from the minimiser on and neighbours
are compared, which gives for every depth the classes of suffixes that agree to the right; the same sort over the words before the
minimiser, backwards, extends matches to the left. A window that starts `o` words before its minimiser is repeated where another
suffix agrees with it in `o` words to the left and the window's rest to the right.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, mixed, with_key
from .passages import GRAMS, WINDOW, gram_hashes, repeated, sliding_min


def _agreeing(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the rows sorted, and how many leading words each has in common with the one before it."""
    order = np.lexsort(contexts.T[::-1])
    rows = contexts[order]
    same = np.ones((len(rows), contexts.shape[1] + 1), bool)
    same[:, -1] = False
    same[1:, :-1] = rows[1:] == rows[:-1]
    same[:1, :-1] = False
    return order, np.argmin(same, axis=1)


#: Windows of a piece that a long unit is taken in.
PIECE = 1024


def windows_by_suffixes(words: np.ndarray, lengths: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int, gram: int = GRAMS[0]) -> tuple[np.ndarray, np.ndarray]:
    """A passages.Kernel: the least lo and the greatest hi of each window. Words are compared by their numbers; hashes only choose the positions.

    A unit of very many windows is one in which few words come again and again, as its windows share a minimiser. It is taken in pieces of PIECE windows, of which
    each different one is looked at once: a text that repeats up to `period` words has at most `period` different full pieces, however long it is.
    """
    n = lengths - window + 1
    if not len(n) or n.max() <= PIECE:
        return _suffixes(words, lengths, lo, hi, window, gram)
    many = -(-n // PIECE)
    unit = np.repeat(np.arange(len(n)), many)
    nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    start = (np.cumsum(lengths) - lengths)[unit] + nth * PIECE
    count = np.minimum(PIECE, n[unit] - nth * PIECE)
    size = count + window - 1
    names: dict[bytes, int] = {}
    kept = np.array([names.setdefault(hashlib.blake2b(words[a : a + k].tobytes()).digest(), i) for i, (a, k) in enumerate(zip(start, size, strict=True))])
    some, which = np.unique(kept, return_inverse=True)
    least, most = np.full(len(some), np.iinfo(np.int64).max), np.full(len(some), np.iinfo(np.int64).min)
    np.minimum.at(least, which, lo[unit])
    np.maximum.at(most, which, hi[unit])
    short = np.concatenate([words[a : a + k] for a, k in zip(start[some], size[some], strict=True)])
    low, high = _suffixes(short, size[some], least, most, window, gram)
    at = (np.cumsum(count[some]) - count[some])[which]
    begin = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return low[begin], high[begin]


def _suffixes(words: np.ndarray, lengths: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    words = words.astype(np.uint64) + np.uint64(1)  # 0 stands beyond a unit's ends
    width = window - gram + 1
    starts = np.cumsum(lengths) - lengths
    n = lengths - window + 1
    unit = np.repeat(np.arange(len(n)), n)
    begin = starts[unit] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    hashes = gram_hashes(mixed(words), gram)
    least = sliding_min(hashes, width)[begin]
    # The leftmost gram that has the window's least hash: for equal windows the same offset.
    offset = np.full(len(begin), -1)
    for o in range(width):
        offset[(offset < 0) & (hashes[begin + o] == least)] = o
    anchors, which = np.unique(begin + offset, return_inverse=True)
    home = np.searchsorted(starts, anchors, side="right") - 1
    stop = starts[home] + lengths[home]

    def context(step: int, count: int) -> np.ndarray:
        at = anchors[:, None] + (np.arange(count) if step > 0 else -1 - np.arange(count))
        inside = (at >= starts[home][:, None]) & (at < stop[:, None])
        return np.where(inside, words[np.clip(at, 0, len(words) - 1)], np.uint64(0))

    right, common_right = _agreeing(context(1, window))
    left, common_left = _agreeing(context(-1, max(1, width - 1)))
    low, high = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
    by_right, by_left = np.empty(len(anchors), np.int64), np.empty(len(anchors), np.int64)
    rows_at = np.argsort(offset, kind="stable")
    cuts = np.searchsorted(offset[rows_at], np.arange(width + 1))
    for o in range(width):
        rows = rows_at[cuts[o] : cuts[o + 1]]
        if not len(rows):
            continue
        by_right[right] = np.cumsum(common_right < window - o)
        by_left[left] = np.cumsum(common_left < o) if o else 0
        pair = by_right[which[rows]] * (len(anchors) + 1) + by_left[which[rows]]
        order = np.argsort(pair, kind="stable")
        new = np.flatnonzero(np.diff(pair[order], prepend=-1))
        owner = unit[rows[order]]
        size = np.diff(np.append(new, len(rows)))
        low[rows[order]] = np.repeat(np.minimum.reduceat(lo[owner], new), size)
        high[rows[order]] = np.repeat(np.maximum.reduceat(hi[owner], new), size)
    return low, high


def _merge(part: pd.DataFrame, window: int) -> list[tuple]:
    rows = []
    for did, runs in zip(part["did"], part["runs"], strict=True):
        at = np.concatenate([r["start"] + np.arange(len(r["least"])) for r in runs])
        least, most = (np.concatenate([np.asarray(r[c]) for r in runs]) for c in ("least", "most"))
        other = np.where(least < did, least, most)
        for x in np.unique(other[other != did]):
            begin = np.unique(at[other == x])
            new = np.flatnonzero(np.diff(begin, prepend=-window - 1) > window)
            length = begin[np.append(new[1:] - 1, len(begin) - 1)] + window - begin[new]
            rows.append((did, int(x), int(length.sum()), [{"start": int(s), "length": int(k)} for s, k in zip(begin[new], length, strict=True)]))
    return rows


def passages(docs: DataFrame, window: int = WINDOW, **options: object) -> DataFrame:
    """doc_id, other_doc_id, n_words, passages: of docs (doc_id, text), each document with a passage of `window` words or more that another one has.

    Every repeated window is matched with the smallest doc_id that holds it; in the document that has this doc_id, with the largest. So all
    documents of a passage are linked through its smallest one, and no group's pairs are listed. Passages are merged windows, as word
    positions; n_words counts their words. Documents without a repeated passage have no row, nor do null, empty or shorter texts.
    Passages that only rows of one doc_id share don't count; rows that repeat a document have one row together. A null doc_id takes part as the
    largest and stays null. Very long texts are read whole, each alone in its slice. No rows give no rows; other columns are ignored.
    """
    runs = repeated(with_key(docs), windows_by_suffixes, ("least", "most"), window, **options)
    some = runs.where(F.exists(F.arrays_zip("least", "most"), lambda x: x["least"] != x["most"]))
    each = some.groupBy("did", "tkey").agg(F.collect_list(F.struct("start", "least", "most")).alias("runs"))

    def run(parts):
        for part in parts:
            yield pd.DataFrame(_merge(part, window), columns=["d", "o", "n_words", "passages"])

    made = each.select("did", "runs").mapInPandas(run, "d long, o long, n_words long, passages array<struct<start:int,length:int>>")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return made.select(known("d").alias("doc_id"), known("o").alias("other_doc_id"), "n_words", "passages")
