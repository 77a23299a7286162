"""Operator 8 at a similarity of texts: documents whose sets of shingles have a Jaccard similarity of 0.8 or more.

A set's fingerprint is a SimHash of PRINT words of 64 bits, wide enough that sets at the similarity stay within RADIUS bits. Its blocks are
those of the set's minima, BAND at a time: two sets with similarity s share one of BANDS blocks with probability 1 - (1 - s**BAND)**BANDS, all
but 5e-8 at 0.8 and more above, whatever their number. First every set is held against one of its block; blocks that are then still in several
components are dealt out in pairs of tiles and compared bit-sliced, as simhash.within() does. What is within the radius is compared whole, by
the numbers of common and of all shingles, so no link is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, dropped, mixed, partitions_for, signed, slices, text_buffers, trimmed, with_key, written
from .components import components
from .simhash import firsts, joined, majority, shingles, within
from .xxh import xxh64

#: Words of a shingle; a link needs (common shingles) / (all shingles) >= SHARE[0] / SHARE[1].
WORDS, SHARE = 5, (4, 5)
#: Minima of a block's key, and blocks of a set.
BAND, BANDS = 4, 32
#: Words of a fingerprint, and the radius: at similarity 0.8 a bit differs with probability 0.15, for sets of a few shingles 0.2, so that 52 of 128 are passed with less than 1e-7.
PRINT, RADIUS = 2, 52
#: Sets of a tile and their shingles, about, and pairs compared whole together.
TILE, TILE_SHINGLES, PAIRS_AT_ONCE = 1024, 1 << 20, 1 << 14

_SEEDS = mixed(np.arange(1, 2 * BAND * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _FLIPS = _SEEDS[: BAND * BANDS] | np.uint64(1), _SEEDS[BAND * BANDS :]


def sets(buf: np.ndarray, offs: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the different shingles' hashes, in order, hashes[first[d]:first[d + 1]] those of document d."""
    small, starts, ends, first = shingles(buf, offs, n)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    hashes = xxh64(small, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(offs)))


def names(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, equal for equal sets; zero for the empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes), dtype=np.uint64)])
    return mixed((sums[first[1:]] - sums[first[:-1]]) * np.uint64(0xD6E8FEB86659FD93) + np.diff(first).astype(np.uint64)) * (np.diff(first) > 0)


def buckets(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The block keys of each set that is not empty, BANDS a row."""
    at = first[:-1][np.diff(first) > 0]
    keys = np.zeros((len(at), BANDS), np.uint64)
    if len(at):
        x = np.empty_like(hashes)
        for band in range(BANDS):
            key = np.full(len(at), band, np.uint64)
            for j in range(band * BAND, (band + 1) * BAND):
                np.bitwise_xor(hashes, _FLIPS[j], out=x)
                np.multiply(x, _FACTORS[j], out=x)
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, at))
            keys[:, band] = key
    return keys


def prints(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash of each set, PRINT words a row."""
    return np.column_stack([majority(mixed(hashes ^ _SEEDS[i]), first) for i in range(PRINT)])


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(np.ascontiguousarray(values).ravel())))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, first = sets(*text_buffers(batch.column("text")))
        size = np.diff(first)
        keys = _lists(buckets(hashes, first), np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]))
        sliced = _lists(prints(hashes, first), np.arange(len(size) + 1) * PRINT)
        columns = [batch.column("doc_id"), batch.column("tkey"), pa.array(signed(names(hashes, first))), pa.array(size.astype(np.int64)), keys, sliced]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tkey", "fp", "n", "keys", "print"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        hashes, first = sets(*text_buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(signed(names(hashes, first))), _lists(hashes, first)], names=["fp", "shingles"])


def _like(a: str, b: str):
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * SHARE[1] >= F.greatest(a, b) * SHARE[0]


def _near(a: str, b: str):
    """Whether the fingerprints in these columns are within the radius."""
    bits = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PRINT)]
    return sum(bits[1:], bits[0]) <= RADIUS


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """a, b: those of pairs (a, na, b, nb; names and sizes) that are similar enough by their shingles, of held (fp, shingles)."""
    left, right = held.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), held.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
    similar = F.size(F.array_intersect("sa", "sb")).cast("long") * (SHARE[0] + SHARE[1]) >= (F.col("na") + F.col("nb")) * SHARE[0]
    return pairs.join(left, "a").join(right, "b").where(similar).select("a", "b")


def _similar(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets a and b, sorted runs of values between offsets, are similar enough, pair by pair."""
    size = np.diff(offsets)
    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        both = np.concatenate([values[offsets[x] : offsets[x + 1]], values[offsets[y] : offsets[y + 1]]])
        both.sort(kind="stable")
        out[i] = int((both[1:] == both[:-1]).sum()) * (SHARE[0] + SHARE[1]) >= (size[x] + size[y]) * SHARE[0]
    return out


def compared(number: np.ndarray, tile: np.ndarray, sliced: np.ndarray, keys: np.ndarray, root: np.ndarray, values: np.ndarray, offsets: np.ndarray, key: int, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), positions in the block, between tiles i and k of the block `key` that connect what all links between them connect.

    Sets of one component already are passed over, and a pair that shares several blocks is compared in the first of them alone.
    """
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == k)
    size = np.diff(offsets)
    _, at, which = np.unique(root, return_index=True, return_inverse=True)
    parent = at[which]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for p, q in within(sliced[left], sliced[right], RADIUS):
        a, b = left[p], right[q]
        fit = (np.minimum(size[a], size[b]) * SHARE[1] >= np.maximum(size[a], size[b]) * SHARE[0]) & ((a < b) | (i != k))
        a, b = a[fit], b[fit]
        for at in range(0, len(a), PAIRS_AT_ONCE):
            x, y = a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE]
            apart = parent[x] != parent[y]
            x, y = x[apart], y[apart]
            same = keys[x] == keys[y]
            own = keys[x, np.argmax(same, axis=1)] == key
            x, y = x[own], y[own]
            good = _similar(values, offsets, x, y)
            x, y = x[good], y[good]
            if len(x):
                links.append((x, y))
                parent = joined(parent, x, y)
    join = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
    return join([x for x, _ in links]), join([y for _, y in links])


def _cell(part: pa.Table) -> pa.Table:
    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = part.column(name).combine_chunks()
        offsets = column.offsets.to_numpy()
        return column.flatten().to_numpy(), offsets - offsets[0]

    number = part.column("fp").to_numpy()
    values, offsets = flat("shingles")
    key, i, k = (part.column(c)[0].as_py() for c in ("key", "i", "k"))
    sliced = flat("print")[0].view(np.uint64).reshape(-1, PRINT)
    a, b = compared(number, part.column("tile").to_numpy(), sliced, flat("keys")[0].reshape(-1, BANDS), part.column("root").to_numpy(), values, offsets, key, i, k)
    made = pa.table({"a": number[a], "b": number[b]})
    trimmed()
    return made


def links(docs: DataFrame, sketched: DataFrame, tile: int = TILE) -> DataFrame:
    """a, b: links that have the components of all pairs of sets that share a block and are similar enough."""
    own = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "tkey")
    nodes = sketched.where("n > 0").groupBy("fp").agg(F.min(F.struct(own.alias("own"), "n", "keys", "print")).alias("x"))
    nodes = written(nodes.select("fp", "x.own.did", "x.own.tkey", "x.n", "x.keys", "x.print"), "nodes")
    keyed = nodes.select("fp", "n", "print", F.explode("keys").alias("key"))
    one = keyed.groupBy("key").agg(F.min(F.struct("fp", "n", "print")).alias("one"), F.count("*").alias("many")).where("many > 1")
    shared = written(keyed.join(one.select("key", F.col("one.fp").alias("a"), F.col("one.n").alias("na"), F.col("one.print").alias("pa")), "key"), "buckets")
    wanted = nodes.join(shared.select("fp").distinct(), "fp", "left_semi").select("did", "tkey")
    texts = with_key(docs).join(wanted, ["did", "tkey"], "left_semi").dropDuplicates(["did", "tkey"]).select("text")
    held = written(texts.mapInArrow(_whole, "fp long, shingles array<long>"), "shingles")

    first = shared.where((F.col("fp") != F.col("a")) & _like("n", "na") & _near("print", "pa")).select("a", "na", F.col("fp").alias("b"), F.col("n").alias("nb")).distinct()
    found = written(verified(first, held), "links")
    named = written(shared.join(components(found).withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), "named")
    dropped(shared)
    tiles = F.ceil(F.greatest(F.col("many") / tile, F.col("size") / TILE_SHINGLES)).cast("int").alias("tiles")
    sums = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("many"), F.sum("n").alias("size"))
    apart = written(sums.where("x <> y").select("key", tiles), "apart")
    # A block of at most one tile is one cell; a larger one, such as a passage that many texts share, is as many as it has pairs of tiles.
    rest = named.join(apart, "key").withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("k")))
    cells = rest.select("key", "fp", "root", "tile", F.explode(pair).alias("cell")).select("key", "fp", "root", "tile", "cell.i", "cell.k")
    full = cells.join(nodes.select("fp", "keys", "print"), "fp").join(held, "fp")
    blocks = apart.agg(F.coalesce(F.sum(F.col("tiles") * (F.col("tiles") + 1) / 2), F.lit(0))).first()[0]
    dealt = full.repartition(partitions_for(int(blocks), 64), "key", "i", "k")
    others = written(dealt.groupBy("key", "i", "k").applyInArrow(_cell, "a long, b long"), "others")
    return found.unionAll(others)


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that their components keep, with docs' columns: of each component the one with the smallest doc_id.

    Fewer words than WORDS are one shingle. Texts without words, null ones too, are equal; very long ones are read whole. A null doc_id counts as
    larger than all others. Where several rows have the smallest doc_id, the one whose text's hash is smallest stays, once. Equal texts, of
    whatever number, are one set. No rows give no rows.
    """
    schema = "doc_id long, tkey long, fp long, n long, keys array<long>, print array<long>"
    sketched = written(with_key(docs).select("doc_id", "tkey", "text").mapInArrow(_sketches, schema), "sketches")
    roots = components(links(docs, sketched)).withColumnRenamed("node", "fp")
    named = sketched.select("doc_id", "tkey", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return firsts(docs, named)
