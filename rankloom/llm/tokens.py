"""Token ids of texts, by the tokenizers library, as packed little-endian integers.

Byte-level and word-end BPE merge inside one pre-token only, so a text may be cut before every single space that is
followed by something else than white space, and each unit encoded once and kept. A unit is cut further behind letters
of which the vocabulary's own normalizer and pre-tokenizer say that a pre-token ends there, whichever mark follows.
Units are encoded by the library; a bounded number of them is kept in each worker. A text that holds the string of a
special token is encoded whole, as the library does: the string becomes that token, or, if `ordinary`, plain text.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEEP = 1_600_000
_kept: dict[tuple[str, str, bool], "Encoder"] = {}
_odd = [" " + c for c in map(chr, range(0x3001)) if c.isspace()]
_cut = re.compile(r" (?=\S)")
_MARKS = [chr(c) for c in range(33, 127) if not chr(c).isalnum()] + ["\n"]


def _tokenizer(path: str, ordinary: bool = False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = ordinary
    return t


def id_type(path: str) -> str:
    """The smallest unsigned type that holds every id."""
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def _ends_after(tokenizer, letter: str) -> bool:
    """Whether a pre-token ends between the letter and any mark, and each side is normalized alone as it is together."""
    norm = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
    split, left = tokenizer.pre_tokenizer.pre_tokenize_str, norm("x" + letter)
    for mark in _MARKS:
        both = norm(f"x{letter}{mark}x")
        if both != left + norm(mark + "x") or not any(at[0] == len(left) for _, at in split(both)):
            # A line feed may be white space that is dropped: then the next pre-token begins after it.
            if mark != "\n" or both != left + norm(mark + "x") or len(left) not in {at[1] for _, at in split(both)}:
                return False
    return True


def _inner(tokenizer) -> re.Pattern:
    """Where a pre-token surely ends: between such a letter and a mark or line feed, and after a single line feed."""
    safe = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and _ends_after(tokenizer, c))
    marks = re.escape("".join(_MARKS))
    return re.compile(rf"(?<=[{safe}])(?=[{marks}])|(?<=\S\n)(?=[{safe}])") if safe else re.compile(r"(?!)")


class Encoder:
    """dtype: how ids are packed."""

    def __init__(self, path: str, dtype: str, ordinary: bool = False):
        self.tokenizer, self.code = _tokenizer(path, ordinary), {"<u2": "H", "<u4": "I"}[dtype]
        self.inner = _inner(self.tokenizer)
        self.special = [] if ordinary else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of parts, and of units that have a space before them.
        self.parts: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _encode(self, todo: list[str], into: dict[str, bytes], before: str = "") -> None:
        for at in range(0, len(todo), 4096):
            some = todo[at : at + 4096]
            for text, e in zip(some, self.tokenizer.encode_batch_fast([before + x for x in some] if before else some, add_special_tokens=False), strict=True):
                into[text] = array(self.code, e.ids).tobytes()

    def _learn(self, new: set[str], heads: set[str]) -> None:
        """Keeps the ids of units and of the texts' heads. A part with a space before it is a unit itself."""
        cut = {u: self.inner.split(u) for u in new if not u.isalpha()}
        plain = new.difference(cut)
        plain.update(ps[0] for ps in cut.values())
        self._encode(list(plain.difference(self.units)), self.units, " ")
        parts = {p for ps in cut.values() for p in ps[1:]} | heads
        self._encode(list(parts.difference(self.parts)), self.parts)
        for unit, ps in cut.items():
            if len(ps) > 1:
                self.units[unit] = self.units[ps[0]] + b"".join([self.parts[p] for p in ps[1:]])

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        on = gc.isenabled()
        gc.disable()  # millions of strings that refer to nothing else
        try:
            return self._packed(texts)
        finally:
            if on:
                gc.enable()

    def _packed(self, texts: list[str]) -> list[bytes]:
        whole = {t: b"" for t in texts if any(x in t for x in self.special)}
        if whole:
            self._encode(list(whole), whole)
            others = iter(self._packed([t for t in texts if t not in whole]))
            return [whole[t] if t in whole else next(others) for t in texts]
        if len(self.units) > KEEP or len(self.parts) > KEEP:
            self.units.clear()
            self.parts.clear()
        # A unit that begins with white space, or has nothing of its own, must stay with the space before it.
        cut = [_cut.split(t) if t.endswith(" ") or any(x in t for x in _odd) else t.split(" ") for t in texts]
        found = [list(map(self.units.get, units)) for units in cut]
        gaps = [[k for k, ids in enumerate(ids_of) if ids is None] if None in ids_of else () for ids_of in found]
        self._learn({units[k] for units, ks in zip(cut, gaps, strict=True) for k in ks if k}, {units[0] for units in cut})
        for units, ids_of, ks in zip(cut, found, gaps, strict=True):
            for k in ks:
                ids_of[k] = self.units.get(units[k])
            ids_of[0] = self.parts[units[0]]
        return [b"".join(ids_of) for ids_of in found]


def release() -> None:
    """Lets go of what this worker keeps: workers are reused, and other operators need the memory."""
    _kept.clear()


def encoder(path: str, dtype: str, ordinary: bool = False) -> Encoder:
    """One for each worker and vocabulary."""
    if (path, dtype, ordinary) not in _kept:
        _kept[path, dtype, ordinary] = Encoder(path, dtype, ordinary)
    return _kept[path, dtype, ordinary]
