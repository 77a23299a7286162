"""XXH64 of many byte spans at once: numpy runs the published algorithm over all spans of one length together."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
# The five primes of XXH64.
P1, P2, P3, P4, P5 = map(_U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Longer spans are few; they go to the library one by one.
LONGEST = 256


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _alike(at: np.ndarray, n: int, seed: int, w8: np.ndarray, w4: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Spans of n bytes from each offset in `at`."""
    s, done = _U(seed), 0
    if n >= 32:
        with np.errstate(over="ignore"):
            acc = [np.full(len(at), x, _U) for x in (s + P1 + P2, s + P2, s, s - P1)]
        while done + 32 <= n:
            acc = [_round(a, w8[at + (done + 8 * i)]) for i, a in enumerate(acc)]
            done += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        zero = _U(0)
        for a in acc:
            h = (h ^ _round(zero, a)) * P1 + P4
    else:
        with np.errstate(over="ignore"):
            h = np.full(len(at), s + P5, _U)
    h = h + _U(n)
    while done + 8 <= n:
        h = _rotl(h ^ _round(_U(0), w8[at + done]), 27) * P1 + P4
        done += 8
    if done + 4 <= n:
        h = _rotl(h ^ (w4[at + done].astype(_U) * P1), 23) * P2 + P3
        done += 4
    while done < n:
        h = _rotl(h ^ (buf[at + done].astype(_U) * P5), 11) * P1
        done += 1
    h = (h ^ (h >> _U(33))) * P2
    h = (h ^ (h >> _U(29))) * P3
    return h ^ (h >> _U(32))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each buf[start:end], as uint64."""
    out = np.zeros(len(starts), _U)
    if not len(starts):
        return out
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    w8 = np.ndarray(len(buf) + 1, "<u8", padded.data, 0, (1,))
    w4 = np.ndarray(len(buf) + 5, "<u4", padded.data, 0, (1,))
    size = np.minimum(ends - starts, LONGEST).astype(np.uint16)
    order = np.argsort(size, kind="stable")
    bounds = np.flatnonzero(np.diff(size[order], prepend=-1, append=LONGEST + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        rows = order[a:b]
        n = int(size[rows[0]])
        if n < LONGEST:
            out[rows] = _alike(starts[rows], n, seed, w8, w4, padded)
        else:
            whole = buf.tobytes()
            out[rows] = [xxhash.xxh64_intdigest(whole[i:j], seed=seed) for i, j in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
    return out
