"""The near-duplicate fold over ranges against a plain loop."""

import random

import pytest

from glyphloom.operators import duplicates


def folded(rows, cost=2):
    """{doc_id: (group_id, kept)} by the loop that the definition gives."""
    listed = sorted((t.split(), i) for i, t in rows)
    groups, head, group = {}, None, None
    for tokens, i in listed:
        if head is None or not (tokens == head or duplicates.alignment_cost(head, tokens, cost) == cost):
            head, group = tokens, i
        groups[i] = group
    size = {i: len(set(t.split())) for i, t in rows}
    best = {g: min((i for i in groups if groups[i] == g), key=lambda i: (-size[i], i)) for g in set(groups.values())}
    return {i: (g, best[g] == i) for i, g in groups.items()}


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.group_id, r.kept) for r in duplicates.near(docs).collect()}


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_groups_that_reach_over_ranges(spark, partitions):
    rng = random.Random(5)
    rows = [(i, " ".join(["same", "start", "of", "all", rng.choice("abcdefghijklmnop")])) for i in range(60)]  # all within two edits of the first
    rows += [(100 + i, " ".join(rng.choice("xyz") for _ in range(rng.randrange(1, 5)))) for i in range(150)]
    rows += [(300 + i, "copy of one text") for i in range(40)] + [(400, ""), (401, "copy of one more text now"), (402, "zebra " * 3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark, rows) == folded(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_rows(spark):
    assert got(spark, []) == {}


class Counted(str):
    """A token that counts how often it is compared."""

    times = 0
    __hash__ = str.__hash__

    def __eq__(self, other):
        Counted.times += 1
        return str.__eq__(self, other)

    def __ne__(self, other):
        Counted.times += 1
        return str.__ne__(self, other)


def test_equal_ends_are_compared_once():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(7))] for _ in range(2))
        table = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i, j] = min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] if x == y else i + j)
        want = table[len(a), len(b)]
        got_cost = duplicates.alignment_cost(a, b, 2)
        assert got_cost == want if want <= 2 else got_cost > 2
    words = [Counted(i) for i in range(2000)]
    assert duplicates.alignment_cost(words, [*words[:1000], "x", *words[1001:]], 2) == 2
    assert Counted.times < 2 * len(words)


def test_texts_go_to_the_fold_and_do_not_come_back(spark, monkeypatch):
    """Tokens travel as one string each, and a range's table has the texts at its ends alone; control characters sort as in lists of tokens."""
    tables, real = [], duplicates.written
    monkeypatch.setattr(duplicates, "written", lambda df, name: tables.append(real(df, name)) or tables[-1])
    ends = ["a", "a b", "a\0 b", "a\0\0", "a\1 b", "a\1", "a\2 b c d", "\0", "\1", "\1\1 \0", "\1\2", "", "b \0 c", "b c"]
    rows = [(i, t) for i, t in enumerate(ends * 2)] + [(100 + i, f"long text {i} " + "word " * 50 + str(chr(97 + i))) for i in range(20)]
    want = folded([(i, "".join(c for c in t if not c.isdigit())) for i, t in rows])
    assert got(spark, rows) == want
    assert not any(kind.startswith("array") for t in tables for _, kind in t.dtypes)
    made = next(t for t in tables if "head" in t.columns and "range" in t.columns)
    assert made.where("first IS NOT NULL").count() <= made.select("range").distinct().count() < made.count()
