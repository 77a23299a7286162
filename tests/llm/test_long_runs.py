"""Operator 3's kernel on texts that repeat a few words for very long."""

import subprocess
import sys

import numpy as np
import pytest

from glyphloom.llm import suffixes


def brute(units, lo, hi, window):
    least, most = {}, {}
    for u, a, b in zip(units, lo, hi, strict=True):
        for i in range(len(u) - window + 1):
            key = tuple(u[i : i + window])
            least[key], most[key] = min(a, least.get(key, a)), max(b, most.get(key, b))
    keys = [tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1)]
    return [least[k] for k in keys], [most[k] for k in keys]


@pytest.mark.parametrize("period", [1, 2, 3, 7])
def test_pieces_say_what_whole_units_say(period, monkeypatch):
    rng = np.random.default_rng(period)
    window = 20
    run = np.tile(np.arange(period), 600)
    units = [run, run[3:900], np.concatenate([run[:500], [99], run[:700]]), np.append(run[:321], 98), run[5:40], rng.integers(0, 3, 400)]
    lo = np.array([5, 3, 9, 1, 7, 4])
    lengths = np.array([len(u) for u in units])
    for piece in (16, 64, 1024, 1 << 20):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        low, high = suffixes.windows_by_suffixes(np.concatenate(units), lengths, np.zeros(len(units), int), lo, lo + 10, window, 5)
        assert (low.tolist(), high.tolist()) == brute([u.tolist() for u in units], lo.tolist(), (lo + 10).tolist(), window)


def test_millions_of_equal_words_in_bounded_memory():
    code = """
import resource, numpy as np
from glyphloom.llm import suffixes
n = 3_000_000
words, lengths = np.zeros(2 * n, np.int64), np.array([n, n])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
low, high = suffixes.windows_by_suffixes(words, lengths, np.zeros(2, int), np.array([4, 2]), np.array([4, 2]), 50)
assert (low == 2).all() and (high == 4).all() and len(low) == 2 * (n - 49)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) < 400
