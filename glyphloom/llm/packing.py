"""Operator 7: packing by lexical retrieval.

Texts become token ids once. Document frequencies and the mean length are counted over all documents. Then documents are put in the order of
their content: a document's keys are minima of hashes over its tokens, drawn so that a token is as likely as the square of its BM25 weight, so that
two documents have equal keys the likelier, the better they match. That order is cut into ranges of equal size and these into shards, by sums over
the whole order, so that neither a rerun nor the layout of the input changes a piece. A shard has a BM25 inverted index over its documents. The document that a window starts with is its seed; the unused documents of the shard that score best for
it are appended until the window is full. The last one is cut there, and what is left of it starts the next window as its seed. So only a
range's last sequence has padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pieces
from .common import mixed, partitions_for, slices, text_buffers, trimmed, with_key, written

#: Token ids that a shard aims at, and documents that it has at most: what an index and the search for each seed cost is bounded by both.
SHARD_TOKENS, SHARD_ROWS = 400_000, 2048
#: Token ids of a range, which is one task.
RANGE_TOKENS = 2_000_000
#: Keys of a document's place in the order.
KEYS = 3
#: BM25's usual parameters.
K1, B = 1.2, 0.75


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str] | pa.Array], list[np.ndarray]]:
    """A function from texts to their token ids, those that `tokenizers` gives with add_special_tokens=False.

    Where the vocabulary's ranks lie beside the file (.tiktoken), tiktoken makes the same ids several times faster; texts that spell a
    special token go to `tokenizers` itself, which reads it as one. Texts of Latin letters are cut by pieces.cut(), and tiktoken is asked only for pieces
    that this process has not met.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda texts: [np.array(e.ids, np.int32) for e in whole.encode_batch(texts if isinstance(texts, list) else texts.to_pylist(), add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    memory = pieces.Memory(fast._core_bpe.encode_single_piece) if public_tokenizers.PATTERN == pieces.PATTERN else None

    def other(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast.encode_ordinary(text), np.int32)

    def encode(texts: list[str] | pa.Array) -> list[np.ndarray]:
        column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        buf, offs = text_buffers(column)
        if memory is None or not len(buf):
            return [other(t) for t in column.to_pylist()]
        easy = pieces.plain(buf, offs)
        raw = buf.tobytes()
        if any(s.encode() in raw for s in special):
            easy &= [not any(s in t for s in special) for t in column.to_pylist()]
        if not easy.all():
            buf = buf[np.repeat(easy, np.diff(offs))]
        offs = np.append(0, np.cumsum(np.diff(offs)[easy]))
        begin = pieces.cut(buf, offs)
        ids, many = memory.encoded(buf, begin)
        made = iter(np.split(ids, np.append(0, np.cumsum(many))[np.searchsorted(begin, offs[1:-1])]))
        return [next(made) if e else other(column[i].as_py()) for i, e in enumerate(easy.tolist())]

    return encode


class Statistics:
    """What BM25 takes from the whole corpus."""

    def __init__(self, df: np.ndarray, documents: int, tokens: int) -> None:
        self.mean = max(1.0, tokens / max(1, documents))
        self.idf = np.maximum(0.0, np.log((documents - df + 0.5) / (df + 0.5)))  # terms of half the documents or more tell nothing

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


def counted(docs: list[np.ndarray], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, tf): each document's different terms, by document."""
    sizes = np.array([len(d) for d in docs])
    flat = np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)
    pairs, tf = np.unique(np.repeat(np.arange(len(docs)), sizes) * terms + flat, return_counts=True)
    return pairs // terms, pairs % terms, tf


class Bm25:
    """An inverted index of documents given as arrays of term numbers, with weights by the corpus's statistics."""

    def __init__(self, docs: list[np.ndarray], whole: Statistics) -> None:
        self.n = n = len(docs)
        doc, term, tf = counted(docs, len(whole.idf))
        weights = whole.weights(term, tf, np.array([len(d) for d in docs])[doc] if n else np.zeros(0))
        useful = weights > 0
        doc, term, weights = doc[useful], term[useful], weights[useful]
        used, term = np.unique(term, return_inverse=True)
        self.own = np.split(term, np.searchsorted(doc, np.arange(1, n)))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weights[order]
        self.many = np.bincount(term, minlength=len(used))
        self.start = np.cumsum(self.many) - self.many

    def scores(self, doc: int) -> np.ndarray:
        """The score of each document for one document's distinct terms as the query."""
        terms = self.own[doc]
        begin, size = self.start[terms], self.many[terms]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n)


def arrange(sizes: np.ndarray, scores: Callable[[int], np.ndarray], width: int, offset: int = 0) -> list[int]:
    """The order in which documents fill windows, of which the first one is filled up to offset: the next seed is the first unused document, its followers the unused ones that score best, the first of equals."""
    n = len(sizes)
    free, order = np.ones(n, bool), []
    seed, rank, first = -1, None, 0
    while len(order) < n:
        if seed < 0 or offset == 0:
            while not free[first]:
                first += 1
            seed, rank, doc = first, None, first
        else:
            if rank is None:
                rank = scores(seed)
                rank[~free] = -1.0
            doc = int(np.argmax(rank))
        free[doc] = False
        order.append(doc)
        if rank is not None:
            rank[doc] = -1.0
        end = offset + int(sizes[doc])
        if end >= width and end % width:
            seed, rank = doc, None  # its rest starts the window that is now open
        offset = end % width
    return order


_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


def pack_shard(doc_ids: list, ids: list[np.ndarray], width: int, whole: Statistics, at: int = 0) -> tuple[dict[str, list], int]:
    """(the pieces of one shard, where they end): the first one begins `at` ids after the start of sequence 0; ids end with the closing id."""
    index = Bm25([x[:-1] for x in ids], whole)
    sizes = np.array([len(x) for x in ids])
    out: dict[str, list] = {x: [] for x in _NAMES}
    for doc in arrange(sizes, index.scores, width, at % width):
        body, n, start = ids[doc].astype("<u4").tobytes(), int(sizes[doc]), 0
        while start < n:
            take = min(n - start, width - at % width)
            for name, value in zip(out, (doc_ids[doc], start, take, zlib.crc32(body[4 * start : 4 * (start + take)]), n, at // width, at % width), strict=True):
                out[name].append(value)
            start, at = start + take, at + take
    return out, at


def order_keys(docs: list[np.ndarray], whole: Statistics, keys: int = KEYS) -> np.ndarray:
    """A row of keys for each document: the hash of the term that comes first where a term of weight w waits -log(u) / w**2, u a number from 0 to 1 that the term and the key's number decide. 0 without a term that tells."""
    doc, term, tf = counted(docs, len(whole.idf))
    weight = whole.weights(term, tf, np.array([len(d) for d in docs])[doc] if len(docs) else np.zeros(0)) ** 2
    some = weight > 0
    doc, term, weight = doc[some], term[some].astype(np.uint64), weight[some]
    out = np.zeros((len(docs), keys), np.int64)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    for k in range(keys):
        u = (mixed(term * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        wait = -np.log(u + 2.0**-54) / weight
        if len(first):
            best = np.repeat(np.minimum.reduceat(wait, first), np.diff(np.append(first, len(wait))))
            at = np.flatnonzero(wait == best)
            out[doc[at], k] = mixed(term[at] + np.uint64(7)).view(np.int64)
    return out


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i4") for x in column.to_pylist()]


def tokenised(docs: DataFrame, tokenizer: str, closing: int = 0) -> DataFrame:
    """row, doc_id, did, tkey, n, ids of docs (doc_id, text): a number of its own for each row, with_key()'s keys, the number of its ids with the closing one, and these as 32-bit integers, low byte first; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches):
            ids = [np.append(x, np.int32(closing)).astype("<i4") for x in encode(batch.column("text"))]
            own = [batch.column(c) for c in ("row", "doc_id", "did", "tkey")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["row", "doc_id", "did", "tkey", "n", "ids"])

    rows = with_key(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "did", "tkey", "text")
    return written(rows.mapInArrow(run, "row long, doc_id long, did long, tkey long, n long, ids binary"), "tokens")


def statistics(tokens: DataFrame) -> Statistics:
    """Of all documents of tokenised()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            docs = [x[:-1] for x in _ids(batch.column("ids"))]
            most = max((int(x.max()) for x in docs if len(x)), default=-1) + 1
            df = np.bincount(counted(docs, most)[1], minlength=most) if most else np.zeros(0, np.int64)
            term = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    found = tokens.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # a row for each token of the vocabulary at most
    documents, total = tokens.agg(F.count("*"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()
    df = np.zeros(int(found["term"].max()) + 1 if len(found) else 1, np.int64)
    df[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return Statistics(df, documents, total)


#: What documents are ordered by: their keys, and what tells apart those that have equal ones.
_ORDER = [*(f"k{i}" for i in range(KEYS)), "did", "tkey", "row"]


def _sortable(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of signed 64-bit integers as byte strings in the same order."""
    rows = np.column_stack([c.view(np.uint64) ^ np.uint64(1 << 63) for c in columns]).astype(">u8")
    raw = np.concatenate([np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), 8 * len(columns)), np.ones((len(rows), 1), np.uint8)], axis=1)
    return np.ascontiguousarray(raw).view(f"S{raw.shape[1]}").ravel()  # the last byte keeps zeros before it


def _keyed(whole: Broadcast, bounds: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Without bounds, n and the order's columns; with them, doc_id, ids, the order's columns and the range that a row falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            keys = order_keys([x[:-1] for x in _ids(batch.column("ids"))], whole.value)
            columns = [np.ascontiguousarray(k) for k in keys.T] + [batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tkey", "row")]
            own = ["n"] if bounds is None else ["doc_id", "ids"]
            made = {c: batch.column(c) for c in own} | {c: pa.array(x) for c, x in zip(_ORDER, columns, strict=True)}
            if bounds is not None:
                made["range"] = pa.array(np.searchsorted(bounds.value, _sortable(columns), side="right"))
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return run


def _bounds(keys: DataFrame, tokens: int) -> np.ndarray:
    """The first row of each range but the first in the order of keys (n, _ORDER), a written table, as it is read to find parts and to fill them: ranges begin where the ids before them reach a multiple of `tokens`."""
    ranged = written(keys.repartitionByRange(*_ORDER).withColumn("part", F.spark_partition_id()), "ranges")
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("part").agg(F.sum("n").alias("m")).select("part", before(Window.orderBy("part"), "m").alias("start"))  # a row for each part
    placed = ranged.withColumn("ahead", before(Window.partitionBy("part").orderBy(*_ORDER), "n")).join(starts, "part")
    firsts = placed.groupBy(F.floor((F.col("start") + F.col("ahead")) / F.lit(tokens)).alias("range")).agg(F.min(F.struct(*_ORDER)).alias("first"))
    found = firsts.where("range > 0").select("first.*").toPandas()  # a row for each range
    return np.sort(_sortable([found[c].to_numpy(np.int64) for c in _ORDER]))


def pack(docs: DataFrame, tokenizer: str, width: int = 1024, closing: int = 0, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: the pieces of all rows of docs (doc_id, text), each id of each row in one.

    A null or empty text has the closing id alone; a very long one is cut into as many pieces as it needs, and closes its shard.
    Every row is a document of its own, also one that repeats another or has no doc_id: such rows are told apart by a number that each row
    has, so that any number of equal ones is dealt to as many ranges as it fills. A rerun makes the same pieces. sequence_id is 2**32 * range + the sequence's
    number there. No rows give no rows; other columns are ignored.
    """
    tokens = tokenised(docs, tokenizer, closing)
    context = tokens.sparkSession.sparkContext
    whole = context.broadcast(statistics(tokens))  # two numbers and one for each token of the vocabulary
    longs = ", ".join(f"{x} long" for x in _ORDER)
    keys = written(tokens.select("ids", "did", "tkey", "row", "n").mapInArrow(_keyed(whole, None), f"n long, {longs}"), "keys")
    bounds = context.broadcast(_bounds(keys, range_tokens))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, held, doc_ids, size = -1, 0, [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal at, held, doc_ids, size
            out, at = pack_shard(doc_ids, held, width, whole.value, at)
            out["sequence_id"] = [(number << 32) + x for x in out["sequence_id"]]
            held, doc_ids, size = [], [], 0
            trimmed()
            return pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

        for batch in batches:
            for part, doc_id, ids in zip(batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), _ids(batch.column("ids")), strict=True):
                if part != number:
                    if held:
                        yield shard()
                    number, at = part, 0
                held.append(ids.copy())
                doc_ids.append(doc_id)
                size += len(ids)
                if size >= shard_tokens or len(held) >= shard_rows:
                    yield shard()
        if held:
            yield shard()

    ranged = tokens.select("doc_id", "ids", "did", "tkey", "row").mapInArrow(_keyed(whole, bounds), f"doc_id long, ids binary, {longs}, range long")
    dealt = ranged.repartition(partitions_for(len(bounds.value) + 1, 1), "range").sortWithinPartitions("range", *_ORDER)
    return dealt.select("range", "doc_id", "ids").mapInArrow(packed, _FIELDS)


_SCHEMA = pa.schema([(x, pa.int64()) for x in _NAMES])
