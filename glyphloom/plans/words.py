"""Buckwalter words in which all rules of the grammar come to bear; the tables have none in Arabic script."""

from __future__ import annotations

#: Affixes and stems; all combinations are words, with some that have renamed letters, sukuns or no stem.
BEFORE, STEMS, AFTER = ("", "w", "wAl", "Al", "b", "ll", "sy", "y", "t", "fA", "mA"), ("ktb", "drs", "qwl", "mdrs", "Okl", "sAfr"), ("", "h", "hA", "wn", "At", "p", "tm", "k")
ODD = (">kl", "w>klhm", "<lY", "ms&wl", "kotobh", "ktboh", "ooo", "hello", "Allh", "wAllh", "l", "yA", "EtAk", "nwyt", "wsyktbwnh", "", "x", "AlmdrswnA", "mud~o")


def words() -> list[str]:
    return list(dict.fromkeys([a + b + c for a in BEFORE for b in STEMS for c in AFTER] + list(ODD)))
