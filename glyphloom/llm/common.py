"""What the operators share: keys and columns, and numpy over Arrow text.

A document's words are `[^\\x20\\x09-\\x0D]+` over its UTF-8 bytes everywhere in this package.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphloom.storage import dropped, written  # noqa: F401  the operators take them from here

#: A missing doc_id sorts after every other one.
NO_ID = (1 << 63) - 1
#: Text bytes that a kernel holds at once; its temporaries take some sixty times as much.
SLICE_BYTES = 1 << 19
#: Rows of an Arrow batch on its way to Python, at most.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends texts to Python in small batches: a worker's memory is bounded by BATCH_ROWS texts and a kernel's slice."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as df's own columns call for."""
    taken, made = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        made.append(name)
    return made


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def bundled(df: DataFrame, name: str) -> Column:
    """All columns of df as one struct, which goes through Python whatever their names are."""
    return F.struct(*own_columns(df)).alias(name)


def unbundled(df: DataFrame, name: str) -> list[Column]:
    """The columns of bundled() again."""
    return [F.col(name).getField(c).alias(c) for c in df.columns]


def partitions_for(groups: int, each: int = 8, most: int = 50_000) -> int:
    """Partitions that many groups of bounded size are dealt to, about `each` a task: as many more as the input grows, up to what a driver can keep track of."""
    return min(most, pieces_for(groups, each))


def pieces_for(rows: int, each: int) -> int:
    """How many parts hold rows at about `each` a part."""
    return max(1, -(-int(rows) // int(each)))


#: Copies of a row that one row stands for, at most, when they are dealt out.
CHUNK = 4096


def copies_of(table: DataFrame, many: str, nth: str) -> DataFrame:
    """Each row of a written table as often as its column `many` says, numbered from 0 in `nth`, instead of that column; a row of very many copies is dealt to other tasks in chunks."""
    cols = [x for c, x in zip(table.columns, own_columns(table), strict=True) if c != many]
    chunk = fresh(table, "chunk")[0]
    few = table.where(F.col(many) <= CHUNK).withColumn(chunk, F.lit(0).cast("long"))
    pieces = [few]
    crowd = table.where(F.col(many) > CHUNK)
    if not crowd.isEmpty():
        every = crowd.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(many) - 1) / F.lit(CHUNK)))))
        pieces.append(every.repartition(F.xxhash64(*own_columns(every))))
    at = F.col(chunk) * CHUNK
    made = [p.select(*cols, F.explode(F.sequence(at, F.least(F.col(many) - 1, at + (CHUNK - 1)))).alias(nth)) for p in pieces]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the row's number from 0 in the order of its columns `order`. Ranges are numbered apart; only their counts, one a range, are summed in one task."""
    part, start = fresh(df, "part", "start")
    ranged = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy(part).agg(F.count("*").alias("n")).select(part, before.alias(start))
    row = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    cols = own_columns(df)
    return ranged.withColumn(name, row).join(starts, part).select(*cols, (F.col(start) + F.col(name) - 1).alias(name))


# ---------------------------------------------------------------- Arrow text as numpy


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def trimmed() -> None:
    """Give memory that a worker has freed back to the machine; a worker may sit idle beside others for a while."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` text bytes; a row that is longer comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    trimmed()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): bytes starts[i]:ends[i] are word i; words first[d]:first[d + 1] are those of document d."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


_B = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int = _B) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = int(n) * 5 // 4 + 1024
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int = _B) -> np.ndarray:
    """For span_hash(): sums of values[i] * base**i, of uint64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values), base)[0][: len(values)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _B) -> np.ndarray:
    """A 64-bit hash of each values[start:end], equal for equal spans wherever they are."""
    raw = (sums[ends] - sums[starts]) * _powers(len(sums), base)[1][starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Primes below 2**31, and a number for each whose powers repeat late, for prime_hash().
_FIELDS = ((2**31 - 1, 48271), (2**31 - 19, 69621))
_ROWS: dict[tuple[int, int], np.ndarray] = {}


def _row(n: int, prime: int, base: int) -> np.ndarray:
    """base**i modulo prime for i up to n at least."""
    have = _ROWS.get((prime, base))
    if have is None or len(have) <= n:
        have, step = np.ones(1, np.int64), base
        while len(have) <= n:
            have = np.concatenate([have, have * step % prime])
            step = step * step % prime
        _ROWS[prime, base] = have
    return have


def prime_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 62-bit hash of each values[start:end], uint64 in, int64 out: a polynomial modulo each of two primes, where no pattern of values cancels as it may modulo a power of two."""
    made = np.zeros(len(starts), np.int64)
    for prime, base in _FIELDS:
        up, down = _row(len(values), prime, base), _row(len(values), prime, pow(base, -1, prime))
        sums = np.zeros(len(values) + 1, np.int64)
        np.cumsum((values % np.uint64(prime)).astype(np.int64) * up[: len(values)] % prime, out=sums[1:])
        made = (made << 31) | (sums[ends] - sums[starts]) % prime * down[starts] % prime
    return made


def byte_sums(buf: np.ndarray) -> np.ndarray:
    return prefix_sums(buf.astype(np.uint64) + np.uint64(1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id as it is, `did` for order and joins, `tkey` of the text: rows of equal (did, tkey) are equal documents."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
