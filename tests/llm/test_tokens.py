"""Ids of cut texts against whole texts, by a tokenizer loaded apart."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from rankloom.llm import tokens
from rankloom.llm.queries import tokenizer_path

CHARS = "abcdefgHIJ  \n\n\t.,!?'\u2019\"-_()<>|0123456789\u00e9\u00c0\u0130\u0131\u017f\u00df\u0149\u01c5\u0307\u0301\ufb01\u4e2d\u3093\u3000\xa0\x85\x1c\u200b\U0001f600"
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|end", " don't ", " I'LL ", "  ", " a", " \u0130.", "Prof. \u0130. Demir", "word! ", "x\ny", "'s", "'re"]


def some_text(r):
    out = []
    for _ in range(r.randint(0, 25)):
        kind = r.random()
        if kind < 0.7:
            out.append(r.choice(CHARS))
        elif kind < 0.88:
            out.append(chr(r.choice([r.randrange(1, 0x3100), r.randrange(0x300, 0x370)])))
        elif kind < 0.98:
            out.append(r.choice(PARTS))
        else:
            code = r.randrange(0x110000)
            out.append("q" if 0xD800 <= code < 0xE000 else chr(code))
    return "".join(out)


@pytest.mark.parametrize("ordinary", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts(name, ordinary):
    path, r = tokenizer_path(name), random.Random(1)
    texts = [some_text(r) for _ in range(20_000)]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = ordinary
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    own = tokens.Encoder(path, "<u4", ordinary)
    assert [t for a in range(0, 20_000, 700) for t, got, ids in zip(texts[a : a + 700], own.packed(texts[a : a + 700]), want[a : a + 700], strict=True) if got != ids] == []
    assert "\u0130" not in own.inner.pattern or name.startswith("byte")
