"""Pieces cut by numpy and remembered ids against the tokenizer itself."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from glyphloom.llm import packing, pieces
from glyphloom.llm.common import text_buffers

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_odd_texts_have_the_tokenizers_ids():
    rng = random.Random(3)
    kinds = "aBs t'1 .\n\t!'é\xa0\x85²ªreveldmſɏɐ中\0 ", " 'sa\n\xa0.lrev"
    texts = ["".join(rng.choice(k) for _ in range(rng.randint(0, 30))) for k in kinds for _ in range(5000)]
    texts += [f"{chr(c)}{x}{chr(c)}" for c in range(0x252) for x in ("", "a", "1", " ", "'", "é", "\n", "'s ")]
    texts += ["a<|endoftext|>b's", "", "it's we'll", "'", "x'", "x'r", "'ll", " " * 40, "é" * 40, "long" * 4, "fifteen letters", "a" * 15, "a" * 16]
    rng.shuffle(texts)
    assert public_tokenizers.PATTERN == pieces.PATTERN
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    encode = packing.encoder(PATH)
    got = [x.tolist() for i in range(0, len(texts), 700) for x in encode(texts[i : i + 700])]
    assert got == want
    assert [x.tolist() for x in encode(pa.array(texts[:50]).slice(7, 20))] == want[7:27]


def test_a_text_of_more_new_pieces_than_slots(monkeypatch):
    monkeypatch.setattr(pieces, "EACH", 100)
    memory = pieces.Memory(list, slots=1 << 8, filled=100)
    buf, offs = text_buffers(pa.array([" ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for i in range(1000)), "", "end"]))
    begin = pieces.cut(buf, offs)
    ids, many = memory.encoded(buf, begin)
    assert len(many) == 1001 and np.array_equal(ids, buf) and np.array_equal(many, np.diff(begin, append=len(buf)))


def test_a_piece_is_asked_for_once_and_forgotten_when_there_are_many():
    asked = []
    memory = pieces.Memory(lambda p: asked.append(p) or list(p), slots=1 << 8, filled=100)
    for i in range(40):
        texts = [f"some words {j % 7} again{i // 4}{'abcdefghij'[k]}" for j in range(9) for k in range(10)]
        buf, offs = text_buffers(pa.array(texts))
        begin = pieces.cut(buf, offs)
        ids, many = memory.encoded(buf, begin)
        assert np.array_equal(ids, buf) and np.array_equal(many, np.diff(begin, append=len(buf)))
        assert memory.known < 150
        if i == 3:
            assert len(asked) == len(set(asked))
