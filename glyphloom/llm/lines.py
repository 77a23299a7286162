"""Operator 12: lines that many documents share, by sharded cuckoo filters over exact reference counts.

An index is a folder of tables: which documents hold which line keys, how many documents hold each key, and for each shard of keys a cuckoo
filter (Fan, Andersen, Kaminsky and Mitzenmacher, 2014) of those that enough documents hold. Documents come and go: the counts of their keys
change, and keys that cross the limit go into their shard's filter or out of it, which a Bloom filter could not do. So a line that was
dropped comes back when the documents that made it common go. A filter also says yes to some keys that it does not hold; as the counts name every
key of the index, each shard lists those beside its filter, and with the list the answer is exact.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphloom.storage import _path, scratch

from .common import bundled, fresh, mixed, own_columns, partitions_for, pieces_for, slices, small_batches, text_buffers, unbundled

#: Keys of a shard, about; a shard's counts, filter and list are one task's group.
SHARD_KEYS = 1 << 14
#: Fingerprints of a bucket, how full a filter may get, and how often one key may push another out before the filter is built larger.
SLOTS, FULL, KICKS = 4, 0.9, 200
#: Bytes of all filters and lists up to which every task gets them; beyond, lines meet the counts in a join.
SENT_BYTES = 32 << 20
#: Bytes of a key: a cryptographic hash of the stripped and lower-cased line, so that no two lines share one.
KEY_BYTES = 16


# ---------------------------------------------------------------- lines of Arrow text

_STRIPPED = np.zeros(256, bool)
_STRIPPED[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_NEWLINE = 0x0A


def line_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): bytes starts[i]:ends[i] are line i, without its newline; lines first[d]:first[d + 1] are those of document d. An empty text is one empty line."""
    breaks = np.flatnonzero(buf == _NEWLINE)
    per = np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    opens, closes = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    opens[first[:-1]], closes[first[1:] - 1] = True, True
    starts[opens], ends[closes] = offs[:-1], offs[1:]
    starts[~opens], ends[~closes] = breaks + 1, breaks
    return starts, ends, first


def key_bounds(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines without the white space at both ends; a white line is empty."""
    solid = np.flatnonzero(~_STRIPPED[buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = a < b
    left, right = starts.copy(), starts.copy()
    if some.any():
        left[some], right[some] = solid[a[some]], solid[b[some] - 1] + 1
    return left, right


def keys_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The key of each line, a row of KEY_BYTES bytes; that of an empty line is zero."""
    left, right = key_bounds(buf, starts, ends)
    low = _LOWER[buf].tobytes()
    none = bytes(KEY_BYTES)
    said = [hashlib.blake2b(low[a:b], digest_size=KEY_BYTES).digest() if a < b else none for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    return np.frombuffer(b"".join(said), np.uint8).reshape(-1, KEY_BYTES)


def halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of each key."""
    both = np.ascontiguousarray(keys).view(">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    """The shard of keys by the leading bits of their first half; shards is a power of two."""
    bits = shards.bit_length() - 1
    return (high >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), np.int64)


# ---------------------------------------------------------------- the filter


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: buckets of SLOTS 16-bit fingerprints, two buckets a hash, each told from the other and the fingerprint."""

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        """For n keys: as many buckets, a power of two, as leave it no more than three quarters full."""
        buckets = 1
        while buckets * SLOTS * 3 < n * 4:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def read(cls, data: bytes) -> Cuckoo:
        made = cls(0)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def bytes(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, never zero; one bucket; the other)"""
        marks = ((hashes >> np.uint64(48)) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
        one = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        return marks, one, self._other(one, marks)

    def _other(self, bucket: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(marks.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        marks, one, two = self._places(hashes)
        return ((self.table[one] == marks[:, None]) | (self.table[two] == marks[:, None])).any(1)

    def add(self, hashes: np.ndarray) -> bool:
        """Insert each hash once; False if one found no place, and the filter is to be built larger."""
        if len(self) + len(hashes) > FULL * self.table.size:
            return False
        for mark, one, two in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            for bucket in (one, two):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                bucket = one
                for turn in range(KICKS):
                    slot = (mark + turn) % SLOTS
                    mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
                    bucket = int(self._other(np.array([bucket]), np.array([mark], np.uint16))[0])
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = mark
                        break
                else:
                    return False
        return True

    def remove(self, hashes: np.ndarray) -> None:
        """Take each hash out once; only what was added may be taken out."""
        for mark, one, two in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == mark)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
            else:
                raise KeyError("a filter was asked to forget what it does not hold")


def changed(old: Cuckoo | None, hashes: np.ndarray, before: np.ndarray, after: np.ndarray, least: int) -> tuple[Cuckoo, np.ndarray]:
    """(filter, hashes that it holds wrongly): a shard's filter after its keys' counts went from before to after, of which least or more make a key common."""
    was, now = before >= least, after >= least
    made = old
    if made is not None:
        made.remove(hashes[was & ~now])
    if made is None or not made.add(hashes[now & ~was]):
        made = Cuckoo.sized(int(now.sum()))
        while not made.add(hashes[now]):
            made = Cuckoo(2 * len(made.table))
    rest = hashes[~now & (after > 0)]
    return made, np.unique(rest[made.has(rest)])


class Common:
    """Exact membership of indexed keys, of all shards' filters and lists."""

    def __init__(self, shards: int, rows: list[tuple[int, bytes, bytes]]):
        self.shards, self.filters = shards, {}
        for shard, table, wrong in rows:
            self.filters[shard] = Cuckoo.read(table), np.frombuffer(wrong, np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        high, low = halves(keys)
        said = np.zeros(len(keys), bool)
        shard = shard_of(high, self.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(order))[: len(edges)], strict=True):
            found = self.filters.get(int(shard[order[a]]))
            if found:
                some = order[a:b]
                some = some[found[0].has(low[some])]
                said[some] = ~np.isin(low[some], found[1])
        return said & ((high != 0) | (low != 0))


# ---------------------------------------------------------------- the index


class LineIndex:
    """Line keys of a changing set of documents, in a folder that the cluster shares.

    `members` has a row a document (doc_id, keys), `counts` a row a key (shard, key, docs), `filters` a row a shard (shard, filter, wrong). A
    change writes new tables and then the file that names them, so one that is broken off leaves the index as it was. Tables that no file names
    any more may be deleted.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, least: int = 10, shard_keys: int = SHARD_KEYS):
        self.spark, self.least, self.shard_keys = spark, int(least), shard_keys
        self.folder = folder or scratch(spark, "lines")
        self.state = self._named()
        if self.state and self.state["least"] != self.least:
            raise ValueError(f"the index in {self.folder} counts keys of {self.state['least']} documents as common")
        small_batches(spark)

    def _named(self) -> dict:
        """What the last change named: the highest number wins, as a change that is broken off has no file."""
        at, store = _path(self.spark, f"{self.folder}/names-*.json")
        found = sorted(str(x.getPath()) for x in store.globStatus(at) or [])
        return json.loads("".join(r[0] for r in self.spark.read.text(found[-1]).collect())) if found else {}

    def _name(self, **state: object) -> None:
        """Name the tables of a change, in a file that is written whole before it gets its name; of two changes at once the later one fails."""
        state["change"] = self.state.get("change", 0) + 1
        new, store = _path(self.spark, f"{self.folder}/new-{uuid.uuid4().hex}")
        out = store.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        at, _ = _path(self.spark, f"{self.folder}/names-{state['change']:012d}.json")
        if store.exists(at) or not store.rename(new, at):
            raise RuntimeError(f"the index in {self.folder} was changed by another writer")
        self.state = state

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.folder}/{kind}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def table(self, kind: str) -> DataFrame:
        """`members`, `counts` or `filters`, as they are now."""
        kinds = {"members": "doc_id long, keys array<binary>", "counts": "shard long, key binary, docs long", "filters": "shard long, filter binary, wrong binary"}
        paths = self.state.get(kind, [])
        return self.spark.read.schema(kinds[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], kinds[kind])

    def add(self, docs: DataFrame) -> None:
        """Count the lines of docs (doc_id, text). Rows that share a doc_id, null too, are one document. A doc_id that is in the index already counts once for what it held and what it gets."""
        made = self.spark.read.schema("doc_id long, keys array<binary>").parquet(path := self._write(document_keys(docs), "members"))
        again = made.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        held = self.table("members")
        known = made.select("doc_id").join(held.select(F.col("doc_id").alias("old")), F.col("doc_id").eqNullSafe(F.col("old")), "left_semi") if self.state else None
        if not again.isEmpty() or known is not None and not known.isEmpty():
            # One row a doc_id: the rare rows that share one are united, with those of the index, before anything is counted.
            apart = made.select("doc_id", F.explode("keys").alias("key")).distinct()
            if self.state:
                old = held.select(F.col("doc_id").alias("old"), F.explode("keys").alias("held"))
                apart = apart.join(old, F.col("doc_id").eqNullSafe(F.col("old")) & (F.col("key") == F.col("held")), "left_anti")
            counted = apart
            path = self._write(apart.groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "members")
        else:
            counted = made.select("doc_id", F.explode("keys").alias("key"))
        self._change(counted.groupBy("key").agg(F.count("*").alias("more")), [*self.state.get("members", []), path])

    def remove(self, ids: DataFrame) -> None:
        """Forget the documents of ids (doc_id): the counts of their keys go down, and keys that are too rare then leave the filters. An id that is not there changes nothing; a null one is that of rows without doc_id."""
        gone = ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        held = self.table("members")
        same = F.col("doc_id").eqNullSafe(F.col("gone"))
        out = held.join(gone, same, "left_semi").select(F.explode("keys").alias("key"))
        kept = self._write(held.join(gone, same, "left_anti"), "members")
        self._change(out.groupBy("key").agg((-F.count("*")).alias("more")), [kept])

    def _change(self, delta: DataFrame, members: list[str]) -> None:
        """Move the counts by delta (key, more) and the filters of shards whose keys crossed the limit."""
        old = self.table("counts").select("key", F.col("docs").alias("before"), F.lit(0).cast("long").alias("more"))
        merged = old.unionByName(delta.select("key", F.lit(0).cast("long").alias("before"), "more")).groupBy("key").agg(F.sum("before").alias("before"), F.sum("more").alias("more"))
        merged = merged.withColumn("docs", F.col("before") + F.col("more")).where("before > 0 or docs > 0")
        moved = self.spark.read.parquet(self._write(merged.select("key", "before", "docs"), "moved"))
        keys = moved.where("docs > 0").count()
        shards = self.state.get("shards", 0)
        fits = shards and keys <= 4 * shards * self.shard_keys
        if not fits:
            shards = 1 << max(0, pieces_for(max(1, keys), self.shard_keys) - 1).bit_length()
        bits = shards.bit_length() - 1
        shard = F.shiftrightunsigned(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0)
        moved = moved.withColumn("shard", shard.cast("long"))
        least = self.least
        filters = self.table("filters") if fits else self.table("filters").limit(0)
        parts = partitions_for(shards, 2)
        schema = "shard long, filter binary, wrong binary"

        def run(counts: pa.Table, had: pa.Table) -> pa.Table:
            if not counts.num_rows:
                return had
            _, low = halves(np.frombuffer(text_buffers(counts.column("key"))[0], np.uint8).reshape(-1, KEY_BYTES))
            before, after = counts.column("before").to_numpy(), counts.column("docs").to_numpy()
            old = Cuckoo.read(had.column("filter")[0].as_py()) if had.num_rows else None
            made, wrong = changed(old, low, before if had.num_rows else np.zeros_like(before), after, least)
            return pa.table({"shard": counts.column("shard")[:1], "filter": pa.array([made.bytes()], pa.binary()), "wrong": pa.array([wrong.tobytes()], pa.binary())})

        made = moved.repartition(parts, "shard").groupBy("shard").cogroup(filters.repartition(parts, "shard").groupBy("shard")).applyInArrow(run, schema)
        filters_at = self._write(made, "filters")
        counts_at = self._write(moved.where("docs > 0").select("shard", "key", "docs"), "counts")
        self._name(least=least, shards=shards, members=members, counts=[counts_at], filters=[filters_at])

    def sent_bytes(self) -> int:
        """Bytes of all filters and lists."""
        return int(self.table("filters").agg(F.sum(F.octet_length("filter") + F.octet_length("wrong"))).first()[0] or 0)

    def common(self) -> DataFrame:
        """key, docs: the keys that enough documents hold, by their counts."""
        return self.table("counts").where(F.col("docs") >= self.least).select("key", "docs")

    def marked(self, docs: DataFrame, most: int = SENT_BYTES) -> DataFrame:
        """docs with all their columns and, after them, n_lines, n_dropped and kept_text: each text without its common lines. The keys of docs have to be in the index.

        Filters and lists of at most `most` bytes go to every task, and no row is shuffled. Where there are more, the lines meet the counts in a
        join, whose hot keys Spark splits, and the places of common lines meet their documents; the result is the same.
        """
        names = fresh(docs, "n_lines", "n_dropped", "kept_text")
        if self.state and self.sent_bytes() > most:
            ready = self._joined(docs)
            common = None
        else:
            rows = [(r.shard, bytes(r.filter), bytes(r.wrong)) for r in self.table("filters").collect()]
            common = self.spark.sparkContext.broadcast((self.state.get("shards", 1), rows))
            ready = docs.select(bundled(docs, "own"), docs["text"].cast("string").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told = Common(*common.value) if common else None
            for batch in slices(batches):
                buf, offs = text_buffers(batch.column("text"))
                starts, ends, first = line_bounds(buf, offs)
                if told:
                    drop = told.has(keys_of(buf, starts, ends))
                else:
                    drop = np.zeros(len(starts), bool)
                    for i, places in enumerate(batch.column("gone").to_pylist()):
                        drop[first[i] + np.array(places or [], np.int64)] = True
                data = buf.tobytes()
                kept = []
                for i in range(batch.num_rows):
                    a, b = first[i], first[i + 1]
                    some = np.flatnonzero(~drop[a:b]) + a
                    kept.append(b"\n".join(data[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)))
                totals = np.concatenate([[0], np.cumsum(drop)])
                made = [pa.array(np.diff(first)), pa.array(totals[first[1:]] - totals[first[:-1]]), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("own"), *made], names=["own", "n_lines", "n_dropped", "kept_text"])

        schema = T.StructType([ready.schema["own"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
        made = ready.mapInArrow(run, schema)
        return made.select(*unbundled(docs, "own"), *(F.col(c).alias(name) for c, name in zip(schema.names[1:], names, strict=True)))

    def _joined(self, docs: DataFrame) -> DataFrame:
        """docs with the places of common lines, by a join with the counts. Rows are named by a hash of their text: equal texts have equal places."""
        rows = docs.select(bundled(docs, "own"), docs["text"].cast("string").alias("text")).withColumn("name", F.md5(F.coalesce("text", F.lit(""))))
        each = rows.select("name", "text").mapInArrow(_line_keys, "name string, place int, key binary").distinct()
        places = each.join(self.common().select("key"), "key", "left_semi").groupBy("name").agg(F.collect_list("place").alias("gone"))
        return rows.join(places.withColumnRenamed("name", "found"), F.col("name") == F.col("found"), "left").select("own", "text", "gone")


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, place, key of each line that is not empty."""
    for batch in slices(batches):
        buf, offs = text_buffers(batch.column("text"))
        starts, ends, first = line_bounds(buf, offs)
        keys = keys_of(buf, starts, ends)
        some = np.flatnonzero(keys.any(1))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))[some]
        yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(doc)), pa.array((some - first[doc]).astype(np.int32)), _binary(keys[some])], names=["name", "place", "key"])


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY_BYTES), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())


def document_keys(docs: DataFrame) -> DataFrame:
    """doc_id, keys: a row's different keys, without that of empty lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offs = text_buffers(batch.column("text"))
            starts, ends, first = line_bounds(buf, offs)
            keys = keys_of(buf, starts, ends)
            high, low = halves(keys)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
            order = np.lexsort((low, high, doc))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(doc[order]) != 0) | (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
            some = order[new & ((high[order] != 0) | (low[order] != 0))]
            edges = np.concatenate([[0], np.cumsum(np.bincount(doc[some], minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges), _binary(keys[some]))], names=["doc_id", "keys"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, keys array<binary>")


def dedup(docs: DataFrame, least: int = 10, folder: str | None = None, most: int = SENT_BYTES) -> DataFrame:
    """docs with all their columns and n_lines, n_dropped, kept_text: lines whose key at least `least` documents hold are gone, from every document. The index is in `folder`, which may hold other documents already.

    A line's key is the line without white space at both ends, in lower case (A to Z). Empty keys are never common. Null and empty texts are one
    empty line; rows that share a doc_id, null too, are one document; lines and texts may be of any length. No rows give no rows.
    """
    index = LineIndex(docs.sparkSession, folder, least)
    index.add(docs)
    return index.marked(docs, most)


def kept(docs: DataFrame, **law: object) -> DataFrame:
    """docs with their columns, texts without common lines."""
    made = dedup(docs, **law)
    return made.select(*(F.col(made.columns[-1]).alias(c) if c == "text" else x for c, x in zip(docs.columns, own_columns(docs), strict=True)))
