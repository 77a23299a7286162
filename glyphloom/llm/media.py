"""Operator 9: telephony audio in columns.

Stored forms are WAV files with mu-law, A-law or IMA ADPCM data. The first two are expanded by lookup tables; ADPCM blocks are
independent, so numpy decodes the n-th sample of all blocks of all files together. Decoded sound goes through a polyphase low-pass filter in
whole numbers to another rate, and is a column of 16-bit PCM beside the file. The way back, from sound to each of the three codes, is here too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_buffers, written

# Fixed values of the WAV format: tags of the codecs.
A_LAW, MU_LAW, IMA_ADPCM = 6, 7, 17
# Fixed values of IMA ADPCM: the quantiser's steps, and how a code's lower three bits move the place among them.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
        1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
        8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Bytes of an ADPCM block: four of them are its head.
BLOCK = 64
#: Samples a second of a stored file, and of the PCM that is made of it.
RATE, RESAMPLED = 8000, 4000
#: Bytes of files that are decoded together.
SOUND_BYTES = 1 << 18
#: The codecs that a table of documents is stored in, by the text's crc32.
CODECS = (MU_LAW, A_LAW, IMA_ADPCM)


def _mu_law() -> np.ndarray:
    code = ~np.arange(256)
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, power = (code & 15) << 4, (code >> 4) & 7
    size = np.where(power == 0, low + 8, (low + 264) << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: _mu_law(), A_LAW: _a_law()}


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples, a row a block: blocks are rows of a head (16-bit first sample, place among the steps, an unused byte) and two codes a byte, the lower first. A place beyond the last step counts as the last."""
    blocks = np.ascontiguousarray(blocks)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    place = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), np.int16)
    out[0] = value
    codes = blocks[:, 4:].T
    for i in range(len(codes)):
        for half, code in enumerate((codes[i] & 15, codes[i] >> 4)):
            step = STEPS[place]
            change = step >> 3
            change = change + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
            place = np.clip(place + MOVES[code & 7], 0, len(STEPS) - 1)
            out[1 + 2 * i + half] = value
    return out.T


def law(samples: np.ndarray, tag: int) -> np.ndarray:
    """The mu-law or A-law byte whose value is nearest to each sample, the smaller value of two as near, the smaller byte of one value."""
    values, codes = np.unique(TABLES[tag], return_index=True)
    values, x = values.astype(np.int32), samples.astype(np.int32)
    up = np.clip(np.searchsorted(values, x), 1, len(values) - 1)
    return codes[np.where(x - values[up - 1] <= values[up] - x, up - 1, up)].astype(np.uint8)


def to_adpcm(samples: np.ndarray) -> np.ndarray:
    """Rows of whole blocks for adpcm(), of rows of as many samples as a block gives: all blocks together, sample by sample. Each block starts with its first sample and the step nearest to its second difference."""
    x = samples.astype(np.int32)
    value = x[:, 0].copy()
    place = np.minimum(np.searchsorted(STEPS, np.abs(x[:, 1] - x[:, 0])), len(STEPS) - 1).astype(np.int32)
    out = np.zeros((len(x), 4 + (x.shape[1] - 1) // 2), np.uint8)
    out[:, :2] = value.astype("<i2")[:, None].view(np.uint8).reshape(-1, 2)
    out[:, 2] = place
    for i in range(1, x.shape[1]):
        step, gap = STEPS[place], x[:, i] - value
        size, code, change = np.abs(gap), np.zeros(len(x), np.int32), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            over = size >= part
            code |= np.where(over, bit, 0)
            size, change = size - np.where(over, part, 0), change + np.where(over, part, 0)
        value = np.clip(value + np.where(gap < 0, -change, change), -32768, 32767)
        place = np.clip(place + MOVES[code], 0, len(STEPS) - 1)
        code |= np.where(gap < 0, 8, 0)
        out[:, 4 + (i - 1) // 2] |= (code << (4 * ((i - 1) % 2))).astype(np.uint8)
    return out


def encode(samples: np.ndarray, tag: int) -> bytes:
    """Coded bytes of int16 samples; for ADPCM the last sample is repeated to fill a block."""
    if tag != IMA_ADPCM:
        return law(samples, tag).tobytes()
    per = 1 + 2 * (BLOCK - 4)
    rows = -(-len(samples) // per)
    full = np.append(samples, np.repeat(samples[-1:], rows * per - len(samples)))
    return to_adpcm(full.reshape(rows, per)).tobytes()


#: Taps on either side of an output sample that keeps the rate, and the pass band's share of the lower of both half rates. Filters have whole coefficients that sum to ONE.
TAPS, PASSED, ONE = 8, 0.92, 1 << 15


@cache
def low_pass(rate: int, to: int) -> tuple[np.ndarray, int, int]:
    """(coefficients, up, down): a windowed sinc for each of `up` phases between two input samples, where the output takes `down` / `up` of an input sample a step. It passes what both rates can hold."""
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    cut = PASSED * min(1.0, up / down)
    half = -(-TAPS * max(up, down) // up)
    t = np.arange(1 - half, half + 1)[None, :] - np.arange(up)[:, None] / up
    h = np.sinc(cut * t) * np.cos(np.pi * t / (2 * half)) ** 2
    whole = np.rint(h / h.sum(1, keepdims=True) * ONE).astype(np.int64)
    whole[np.arange(up), half - 1 + (np.arange(up) * 2 > up)] += ONE - whole.sum(1)
    return whole, up, down


def resample(samples: np.ndarray, cuts: np.ndarray, rate: int = RATE, to: int = RESAMPLED) -> tuple[np.ndarray, np.ndarray]:
    """(samples, cuts): each run of samples between cuts at another rate, through low_pass(), all runs together; beyond its ends a run stays at its first and last sample."""
    if rate == to:
        return samples.astype(np.int16), np.asarray(cuts)
    filters, up, down = low_pass(rate, to)
    half = filters.shape[1] // 2
    length = np.diff(cuts)
    size = length * up // down
    made = np.concatenate([[0], np.cumsum(size)])
    # All runs behind each other, each with room for the filter at both ends.
    some = length > 0
    wide = np.where(some, length + 2 * half, 0)
    first = np.cumsum(wide) - wide
    place = np.arange(int(wide.sum())) - np.repeat(first + half, wide)
    x = samples[np.repeat(np.asarray(cuts)[:-1], wide) + np.clip(place, 0, np.repeat(length - 1, wide))].astype(np.int64)
    at = (np.arange(made[-1]) - np.repeat(made[:-1], size)) * down
    base, phase = np.repeat(first + 1, size) + at // up, at % up
    total = np.full(len(base), ONE // 2)
    for k in range(2 * half):
        total += x[base + k] * (filters[phase, k] if up > 1 else filters[0, k])
    return np.clip(total >> 15, -32768, 32767).astype(np.int16), made


def wav(data: bytes, tag: int = MU_LAW, rate: int = RATE) -> bytes:
    """A mono WAV file of coded bytes."""
    align = BLOCK if tag == IMA_ADPCM else 1
    per = 1 + 2 * (BLOCK - 4) if tag == IMA_ADPCM else 1
    head = struct.pack("<HHIIHH", tag, 1, rate, rate * align // per, align, 4 if tag == IMA_ADPCM else 8)
    head += struct.pack("<HH", 2, per) if tag == IMA_ADPCM else struct.pack("<H", 0)
    fact = struct.pack("<I", len(data) // align * per)
    chunks = b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in ((b"fmt ", head), (b"fact", fact), (b"data", data)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwav(media: bytes) -> tuple[int, int, bytes]:
    """(tag, rate, coded bytes) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the WAV file")


def decode(data: np.ndarray, tag: int) -> np.ndarray:
    """int16 samples of coded bytes; ADPCM bytes come in whole blocks."""
    return adpcm(data.reshape(-1, BLOCK)).reshape(-1) if tag == IMA_ADPCM else TABLES[tag][data]


def sounds(files: list[bytes], to: int = RESAMPLED) -> list[bytes]:
    """Each stored file's sound as 16-bit PCM at the rate `to`: the files of one codec and rate are decoded and resampled together."""
    parts = [unwav(f) for f in files]
    made: list[bytes] = [b""] * len(files)
    for kind in {p[:2] for p in parts}:
        rows = [i for i, p in enumerate(parts) if p[:2] == kind]
        samples = decode(np.frombuffer(b"".join(parts[i][2] for i in rows), np.uint8), kind[0])
        per = (1 + 2 * (BLOCK - 4), BLOCK) if kind[0] == IMA_ADPCM else (1, 1)
        cuts = np.concatenate([[0], np.cumsum([len(parts[i][2]) // per[1] * per[0] for i in rows])])
        sound, ends = resample(samples, cuts, kind[1], to)
        whole = sound.astype("<i2").tobytes()
        for i, a, b in zip(rows, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            made[i] = whole[2 * a : 2 * b]
    return made


def _store(codecs: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offs = text_buffers(batch.column("text"))
            body = buf.tobytes()
            texts = [body[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            files = [wav(t + b"\0" * (max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t)), codecs[zlib.crc32(t) % len(codecs)]) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def stored(docs: DataFrame, codecs: tuple[int, ...] = CODECS) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, as the data of a WAV file: samples of mu-law or A-law, or blocks of ADPCM, as the text's crc32 says.

    Null is empty: 64 zeros. A text of any length is one file.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store(codecs), "doc_id long, n_bytes long, media binary")


def _sound(samples: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int]]:
    """Peak, energy and changes of sign between cuts; a part may be empty."""
    x = samples.astype(np.int64)
    turn = np.zeros(len(x), np.int64)
    turn[1:] = (x[1:] < 0) != (x[:-1] < 0)
    turn[cuts[:-1][np.diff(cuts) > 0]] = 0
    some = np.flatnonzero(np.diff(cuts))
    out = np.zeros((3, len(cuts) - 1), np.int64)
    if len(some):
        for row, f, y in zip(out, (np.maximum, np.add, np.add), (np.abs(x), x * x, turn), strict=True):
            row[some] = f.reduceat(y, cuts[some])
    return list(zip(*out.tolist(), strict=True))


_FIELDS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = {MU_LAW: "mu-law", A_LAW: "a-law", IMA_ADPCM: "ima-adpcm"}


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "pcm"):
        media, pcm = batch.column("media").to_pylist(), batch.column("pcm").to_pylist()
        parts = [unwav(m) for m in media]
        cuts = np.concatenate([[0], np.cumsum([len(p) // 2 for p in pcm])])
        heard = _sound(np.frombuffer(b"".join(pcm), "<i2"), cuts)
        feature = [f"{_NAMES[p[0]]};samples={len(s) // 2},peak={h[0]},energy={h[1]},turns={h[2]},crc32={zlib.crc32(s):08x}" for p, s, h in zip(parts, pcm, heard, strict=True)]
        data = [p[2] for p in parts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array([len(d) for d in data], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data]),
                pa.array([zlib.crc32(d[-64:]) for d in data], pa.int64()), pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(feature),
            ],
            names=[x.split()[0] for x in _FIELDS.split(", ")],
        )


def described(media: DataFrame) -> DataFrame:
    """What a table (doc_id, n_bytes, media, pcm) holds, from its bytes: the payload of each file, and codec, length, peak, energy, changes of sign and crc32 of its PCM."""
    return media.mapInArrow(_describe, _FIELDS)


def with_pcm(media: DataFrame, rate: int = RESAMPLED) -> DataFrame:
    """media (with a binary column `media` of WAV files) with their sound, resampled, in a column `pcm`. Null stays null."""

    @F.arrow_udf("binary")
    def sound(files: pa.Array) -> pa.Array:
        found, out = files.to_pylist(), []
        at = 0
        while at < len(found):  # a few megabytes of sound at once
            end, size = at, 0
            while end < len(found) and (end == at or size + len(found[end] or b"") <= SOUND_BYTES):
                size, end = size + len(found[end] or b""), end + 1
            some = iter(sounds([f for f in found[at:end] if f is not None], rate))
            out += [None if f is None else next(some) for f in found[at:end]]
            at = end
        return pa.array(out, pa.binary())

    return media.withColumn("pcm", sound("media"))


def digest(docs: DataFrame) -> DataFrame:
    """described() of a table that is written with the files of stored() and read back, and of the sound of what is read: one row per row of docs (doc_id, text).

    The sound is made of the files whenever it is needed, and not stored again: filtered samples are twice as large as what they come from, and don't compress.

    Repeated rows and null doc_ids have rows of their own; equal texts have equal values. Null and empty texts are 64 zeros; very long ones are one file, whose sound
    is decoded alone. No rows give no rows. Other columns are ignored.
    """
    return described(with_pcm(written(stored(docs), "media")))
