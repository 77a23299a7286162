"""Operator 13: fill-in-the-middle documents, cut at the offsets of an isolating pre-tokenizer.

A Split pre-tokenizer whose regular expression matches any one code point, with its matches isolated, gives every code point an offset pair;
nothing is trained. The length of the offset array is n, the offset of a rank is where a slice ends. A text goes
through in segments: the lengths of their offset arrays are summed, and the segment where a rank falls gives its offset.
"""

from __future__ import annotations

import gc
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from .common import bundled, fresh, slices, small_batches, unbundled

#: What marks the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents, those that are cut; of a hundred of these, those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Code points of a segment: a piece takes some two hundred bytes.
SEGMENT = 128


class Offsets:
    """Where the code points of a text end."""

    def __init__(self, segment: int = SEGMENT) -> None:
        self.split = pre_tokenizers.Split(Regex(r"(?m:.)"), "isolated").pre_tokenize_str
        self.segment = segment

    def sizes(self, text: str) -> list[int]:
        """The number of offsets in each segment."""
        split, step = self.split, self.segment
        return [len(split(text[at : at + step])) for at in range(0, len(text), step)]

    def ends(self, text: str, sizes: list[int], ranks: tuple[int, ...]) -> list[int]:
        """The offset behind each of some ranks, counted from 1; rank 0 is the start."""
        before, found = [0, *accumulate(sizes)], []
        for rank in ranks:
            i = bisect_left(before, rank) - 1
            at = i * self.segment
            found.append(at + self.split(text[at : at + self.segment])[rank - before[i] - 1][1][1] if rank else 0)
        return found


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of sha256 of the seed and doc_id."""
    said = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[i : i + 8], 16) for i in range(0, 32, 8)]


def infilled(text: str, doc_id: int | None, offsets: Offsets, seed: int = 1, marks: tuple[str, str, str] = MARKS, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, code points of the prefix, of the middle, output)."""
    sizes = offsets.sizes(text)
    n = sum(sizes)
    first, second, kept, turned = draws(doc_id, seed)
    if not n or any(m in text for m in marks) or kept % 100 >= cut:
        return n, "plain", None, None, text
    a, b = sorted((first % (n + 1), second % (n + 1)))
    i, j = offsets.ends(text, sizes, (a, b))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = marks
    if turned % 100 < suffix_first:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transformed(docs: DataFrame, seed: int = 1, marks: tuple[str, str, str] = MARKS, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs (doc_id, text) with all their columns, and n, form, prefix_chars, middle_chars and output; a name that docs have already gets underscores before it.

    Where a document is cut, whether at all and in which order hang on doc_id, seed and its number of code points alone, so that equal rows agree
    and reruns too. A null text is empty; an empty one, and one that holds a mark, stays plain, with null lengths. A null doc_id draws as the word
    null. Texts may be of any length: one longer than a slice goes alone, and of its offsets only a segment's are held at once. No rows give no rows. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    fields = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    ready = docs.select(bundled(docs, "own"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = T.StructType([ready.schema["own"], *(T.StructField(name, kind) for name, kind in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = Offsets()
        gc.disable()  # pieces hold no cycles, and looking for some takes a tenth of the time
        for batch in slices(batches):
            pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            rows = [infilled(t or "", d, offsets, seed, marks, cut, suffix_first) for d, t in pairs]
            made = [pa.array(x, pa.string() if isinstance(kind, T.StringType) else pa.int64()) for x, kind in zip(zip(*rows, strict=True), fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("own"), *made], names=schema.names)

    made = ready.mapInArrow(run, schema)
    return made.select(*unbundled(docs, "own"), *(F.col(c).alias(name) for c, name in zip(fields, fresh(docs, *fields), strict=True)))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of: what stands between its marks, the first of each after the one before. A cut text holds none itself, and no mark begins as another ends, so these are the ones that were put in."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, len(first) + 1, 1 << 30)
        one = F.substring_index(rest, second, 1)
        after = F.substring(rest, F.char_length(one) + F.lit(len(second) + 1), F.lit(1 << 30))
        two = F.substring_index(after, m, 1)
        return one, two, F.substring(after, F.char_length(two) + F.lit(len(m) + 1), F.lit(1 << 30))

    prefix, suffix, middle = parts(p, s)
    turned_suffix, turned_prefix, turned_middle = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(turned_prefix, turned_middle, turned_suffix)).otherwise(output)
