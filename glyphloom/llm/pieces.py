"""Texts cut into a byte-pair vocabulary's pieces by numpy, and the ids of short pieces remembered.

The pieces are those of PATTERN for texts below U+0250, where what is a letter, a number or white space is settled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .common import mixed

#: The pattern that cut() follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_LAST = 0x250
_KIND = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_LAST)], np.uint8)
_KIND[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _SPACE
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Bytes of a piece that is remembered, at most; slots for them; and how many are filled before all are forgotten.
SHORT, SLOTS, FILLED = 15, 1 << 21, 1_200_000
#: Pieces that are looked up at once.
EACH = 1 << 18


def plain(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has no character from U+0250 on."""
    high = buf >= 0xC9
    high[:-1] &= (buf[:-1] > 0xC9) | (buf[1:] >= 0x90)
    return np.add.reduceat(np.append(high, False), offs[:-1], dtype=np.int64) * (np.diff(offs) > 0) == 0 if len(offs) > 1 else np.ones(0, bool)


def cut(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pieces of plain() texts begin, in bytes."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[np.minimum(buf, 0x7F)]
    lead = np.flatnonzero(buf >= 0xC0)
    kind[lead] = kind[lead + 1] = _KIND[((buf[lead] & 0x1F).astype(np.int64) << 6) | (buf[lead + 1] & 0x3F)]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begin = edge[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # A space goes with what follows it; white space before a character that is none ends before its last one.
    solid = np.flatnonzero(begin[1:] & ~edge[1:-1] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    last = solid - 1 - ((buf[solid - 1] & 0xC0) == 0x80)
    begin[solid[buf[solid - 1] == 0x20]] = False
    begin[last] = True
    # An apostrophe that begins a piece takes the letters of a contraction with it.
    tick = np.flatnonzero((buf == 0x27) & begin)
    if len(tick):
        end = offs[np.searchsorted(offs, tick, side="right")]
        at = lambda k: np.where(tick + k < end, buf[np.minimum(tick + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begin[tick[short | long] + 1] = False
        behind = np.concatenate([tick[short] + 2, tick[long] + 3])
        begin[behind[behind < n]] = True
    return np.flatnonzero(begin)


class Memory:
    """The ids of pieces, by `one` of a piece's bytes; those of short ones are kept by all their bytes, up to a number."""

    def __init__(self, one: Callable[[bytes], list[int]], slots: int = SLOTS, filled: int = FILLED) -> None:
        self.one, self.slots, self.filled = one, slots, filled
        self._forget()

    def _forget(self) -> None:
        self.low, self.high, self.value = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.many, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of new pieces."""
        found = [self.one(p) for p in pieces]
        many = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.int32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(found) > len(self.first):
            self.first, self.many = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.many, np.zeros_like(self.many)])
        new = np.arange(self.known, self.known + len(found))
        self.first[new], self.many[new] = self.used + np.cumsum(many) - many, many
        self.ids[self.used : self.used + len(flat)] = flat
        self.used, self.known = self.used + len(flat), self.known + len(found)
        return new

    def _slots(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, held): where each key is, or the free slot where it may go. A key's high half is never 0, as it has the length."""
        slot = (mixed(low ^ mixed(high)) & np.uint64(self.slots - 1)).astype(np.int64)
        held = np.zeros(len(slot), bool)
        open_ = np.arange(len(slot))
        while len(open_):
            at = slot[open_]
            there = self.high[at]
            same = (there == high[open_]) & (self.low[at] == low[open_])
            held[open_[same]] = True
            open_ = open_[~same & (there != 0)]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
        return slot, held

    def encoded(self, buf: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, many): of the pieces of buf one after another, and of each how many; some at a time, so that slots for new ones never run out."""
        ends = [*begin[EACH::EACH].tolist(), len(buf)]
        parts = [self._part(buf[a:b], begin[i * EACH : (i + 1) * EACH] - a) for i, (a, b) in enumerate(zip([0, *ends], ends))]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def _part(self, buf: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.known > self.filled:
            self._forget()
        length = np.diff(begin, append=len(buf))
        wide = np.concatenate([buf, np.zeros(16, np.uint8)])
        words = np.lib.stride_tricks.as_strided(np.frombuffer(wide.data, np.uint64, 1), (len(buf) + 8,), (1,))
        low = words[begin] & _MASK[np.minimum(length, 8)]
        high = words[np.minimum(begin + 8, len(buf))] & _MASK[np.clip(length - 8, 0, 7)] | (length.astype(np.uint64) << np.uint64(56))
        number = np.zeros(len(begin), np.int64)
        small = np.flatnonzero(length <= SHORT)
        slot, held = self._slots(low[small], high[small])
        number[small[held]] = self.value[slot[held]]
        new = small[~held]
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            fresh = np.concatenate([[True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])
            firsts = order[fresh]
            made = self._learn([buf[b : b + n].tobytes() for b, n in zip(begin[firsts].tolist(), length[firsts].tolist())])
            number[order] = made[np.cumsum(fresh) - 1]
            left = np.arange(len(firsts))
            while len(left):
                slot, _ = self._slots(low[firsts[left]], high[firsts[left]])
                _, won = np.unique(slot, return_index=True)  # two keys may ask for one free slot
                self.low[slot[won]], self.high[slot[won]], self.value[slot[won]] = low[firsts[left[won]]], high[firsts[left[won]]], made[left[won]]
                left = np.delete(left, won)
        many, where = self.many[number], self.first[number]
        long = np.flatnonzero(length > SHORT)
        said = [self.one(buf[b : b + n].tobytes()) for b, n in zip(begin[long].tolist(), length[long].tolist())]
        many[long] = [len(x) for x in said]
        ends = np.cumsum(many)
        at = np.repeat(where - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
        if len(long):
            inside = np.repeat(np.isin(np.arange(len(many)), long), many)
            at[inside] = 0
        ids = self.ids[at]
        if len(long):
            ids[inside] = np.concatenate([np.array(x, np.int32) for x in said])
        return ids, many
