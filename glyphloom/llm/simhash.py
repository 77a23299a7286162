"""Operator 8: SimHash near-duplicates by bit-sliced comparison.

Fingerprints of a block are stored as 64 bit planes, so that one 64-bit word holds one bit of 64 fingerprints. A query's distances to
the whole block are counted plane by plane with carry-save adders: 64 distances a word operation. Words whose distances have all passed
the radius are abandoned, and a block once it has no word left.

Blocks come from the pigeonhole principle: of `radius + 1` parts of the 64 bits, two fingerprints within the radius share one. The key
of a block is such a part's number and leading bits, as many as keep blocks near BLOCK fingerprints; sharing a part implies sharing its
leading bits, so no link is lost at any size. A block over TILE fingerprints, such as a large group of near copies, is dealt out as
pairs of tiles. From each block or pair of tiles come only the links of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, fresh, own_columns, pieces_for, signed, slices, text_buffers, with_key, word_bounds, written
from .components import components
from .xxh import xxh64

#: Fingerprints a block aims at, and those from which it is dealt out in tiles.
BLOCK, TILE = 1024, 4096
#: Queries compared with a block together.
QUERIES_AT_ONCE = 64
#: Hashes whose bits are counted together.
HASHES_AT_ONCE = 1 << 16
#: Planes between two looks at which words are still needed.
LOOK_EVERY = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(buf: np.ndarray, offs: np.ndarray, n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): shingles of n words joined by a space, first[d]:first[d + 1] those of document d; fewer words are one shingle, none have none."""
    starts, ends, first = word_bounds(buf, offs)
    counts = np.diff(first)
    if not len(starts):
        return buf, starts, ends, np.zeros(len(offs), np.int64)
    keep = np.zeros(len(buf) + 1, bool)
    edge = np.zeros(len(buf) + 1, np.int32)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge)[:-1] > 0
    keep[:-1] = inside
    not_last = np.ones(len(starts), bool)
    not_last[first[1:][counts > 0] - 1] = False
    keep[ends[not_last]] = True  # the first white space after a word stands for the joining space
    small = np.where(inside, _LOWER[buf], np.uint8(0x20))[keep[:-1]]
    length = ends - starts
    at = np.cumsum(length + not_last) - (length + not_last)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begun = np.cumsum(per) - per
    which = np.repeat(first[:-1] - begun, per) + np.arange(per.sum())  # the first word of each shingle
    last = which + np.repeat(np.where(counts >= n, n - 1, np.maximum(counts - 1, 0)), per)
    return small, at[which], at[last] + length[last], np.concatenate([[0], np.cumsum(per)])


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The uint64 of each document whose bits are set in over half of hashes[first[d]:first[d + 1]]; zero where there are none."""
    counts = np.diff(first)
    ones = np.zeros((len(counts), 64), np.int64)
    some = np.flatnonzero(counts)
    begins = first[:-1][some]
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a = int(np.searchsorted(begins, at, side="right")) - 1
        b = int(np.searchsorted(begins, at + len(part), side="left"))
        ones[some[a:b]] += np.add.reduceat(bits, np.maximum(begins[a:b] - at, 0), axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > counts[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]


def fingerprints(buf: np.ndarray, offs: np.ndarray, words: int = 3) -> np.ndarray:
    """The uint64 fingerprint of each document."""
    small, starts, ends, first = shingles(buf, offs, words)
    return majority(xxh64(small, starts, ends), first)


def planes(prints: np.ndarray) -> np.ndarray:
    """A row for each bit of the fingerprints, of one uint64 or a row of several: row j the bits j of all, 64 of them a word; the last word is filled with copies of the last one."""
    prints = prints.reshape(len(prints), -1)
    words = pieces_for(len(prints), 64)
    full = np.concatenate([prints, np.repeat(prints[-1:], words * 64 - len(prints), axis=0)])
    bits = np.unpackbits(np.ascontiguousarray(full.astype("<u8")).view(np.uint8).reshape(len(full), -1), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").copy().view("<u8")


def within(queries: np.ndarray, block: np.ndarray, radius: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all queries[i] and block[j] that differ in `radius` bits or fewer; a pair may come with j in the filling only as the true last j."""
    sliced, digits = planes(block), max(1, int(radius).bit_length())
    queries = queries.reshape(len(queries), -1)
    full, none = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        q = queries[at : at + QUERIES_AT_ONCE]
        row, col = (x.ravel() for x in np.indices((len(q), sliced.shape[1])))
        count = [np.zeros(len(row), np.uint64) for _ in range(digits)]  # the counters, a digit a word
        over = np.zeros(len(row), np.uint64)
        for j in range(len(sliced)):
            flip = np.where((q[:, j >> 6] >> np.uint64(j & 63)) & np.uint64(1), full, none)
            carry = sliced[j][col] ^ flip[row]
            for d in range(digits):
                count[d], carry = count[d] ^ carry, count[d] & carry
            over |= carry
            if j % LOOK_EVERY == LOOK_EVERY - 1:
                past = over | _above(count, radius)
                live = np.flatnonzero(past != full)
                if not len(live):
                    break
                if len(live) < 0.7 * len(row):
                    row, col, over, count = row[live], col[live], over[live], [c[live] for c in count]
        else:
            hit = ~(over | _above(count, radius))
            if hit.any():
                r = np.flatnonzero(hit)
                bits = np.unpackbits(hit[r].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                i, b = np.nonzero(bits)
                yield at + row[r[i]], np.minimum(col[r[i]] * 64 + b, len(block) - 1)


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the counters exceed the radius."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], 0xFFFFFFFFFFFFFFFF)
    for d in reversed(range(len(count))):
        if (radius >> d) & 1:
            same &= count[d]
        else:
            more |= same & count[d]
            same &= ~count[d]
    return more


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what the pairs within left, or between left and right, connect."""
    block = left if right is None else right
    nodes = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    parent = np.arange(len(nodes))
    for i, j in within(left, block, radius):
        parent = joined(parent, i, j + shift)
    linked = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[linked], nodes[parent[linked]]


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root of each node after links a, b: the larger root hooks to the smaller one, then paths are halved, until all links agree."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb  # in a ball of near copies nearly all pairs are linked already
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (nxt := parent[parent]).tobytes() != parent.tobytes():
            parent = nxt


def _links_of(radius: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        i, k = int(part["i"].iloc[0]), int(part["k"].iloc[0])
        prints, tile = part["fp"].to_numpy(np.int64).view(np.uint64), part["tile"].to_numpy()
        a, b = forest(prints, None, radius) if i == k else forest(prints[tile == i], prints[tile == k], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return run


def links(prints: DataFrame, radius: int = 3, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """a, b: links of prints (fp long, distinct) that have the components of all pairs at `radius` bits or fewer."""
    parts = radius + 1
    width = 64 // parts
    many = prints.count()
    lead = max(0, min(width, (max(1, many) // block).bit_length() - 1))
    keys = F.array(*[F.struct(F.lit(p).cast("int").alias("part"), F.shiftrightunsigned("fp", width * p + width - lead).bitwiseAND((1 << lead) - 1).alias("lead")) for p in range(parts)])
    keyed = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.part", "key.lead")
    # Only blocks over one tile are listed. A block has more than `tile` fingerprints, so there are fewer than parts * many / tile of them.
    large = keyed.groupBy("part", "lead").count().where(F.col("count") > tile).select("part", "lead", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = keyed.join(large, ["part", "lead"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("k")))
    cells = dealt.select("part", "lead", "fp", "tile", F.explode(pair).alias("cell")).select("part", "lead", "fp", "tile", "cell.i", "cell.k")
    return cells.groupBy("part", "lead", "i", "k").applyInPandas(_links_of(radius), "a long, b long")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed(fingerprints(*text_buffers(batch.column("text"))))), batch.column("tkey")], names=["doc_id", "fp", "tkey"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), tkey (a hash of the text) of docs (doc_id, text)."""
    return with_key(docs).select("doc_id", "tkey", "text").mapInArrow(_prints, "doc_id long, fp long, tkey long")


def classes(prints: DataFrame, radius: int = 3, named_by: str = "component_id") -> DataFrame:
    """fp, component_id: of prints (doc_id, fp), each distinct fingerprint with the smallest doc_id that links reach from it; or fp, root, one fingerprint of each component."""
    own = F.coalesce("doc_id", F.lit(NO_ID))
    nodes = written(prints.groupBy("fp").agg(F.min(own).alias("least")), "prints")
    roots = components(links(nodes.select("fp"), radius))
    named = written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    if named_by == "root":
        return named.select("fp", "root")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of docs (doc_id, text).

    Null, empty and white texts have fingerprint zero and link like any other; very long ones are read whole, their shingles in parts. Equal texts, of whatever number, share one fingerprint,
    which is compared once. Repeated rows stay. A null doc_id counts as larger than all others and is null as a component_id only where
    the whole component has no doc_id. No rows give no rows. Other columns of docs are ignored.
    """
    prints = written(fingerprint(docs), "fingerprints")
    return prints.join(classes(prints, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of docs that their components at this radius keep, with docs' columns: of each component the one with the smallest doc_id.

    Where several rows have that doc_id, the one whose text's hash is smallest stays, once. A null doc_id counts as larger than all others.
    nearsets.kept() does so at a similarity of the texts.
    """
    prints = written(fingerprint(docs), "fingerprints")
    return firsts(docs, prints.join(classes(prints, radius, "root"), "fp"))


def firsts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id, then hash of the text, of each root of named (doc_id, tkey, root)."""
    did, tkey = fresh(docs, "did", "tkey")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("tkey").alias("t")))
    chosen = named.groupBy("root").agg(first.alias("k")).select(F.col("k.d").alias(did), F.col("k.t").alias(tkey))
    keyed = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), tkey: F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(chosen, [did, tkey], "left_semi").dropDuplicates([did, tkey]).select(*own_columns(docs))
